"""Structured filtering with same-section semantics, keyword ranking and result limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.codes import level
from lectern.functions.credits import points_value, ranges_overlap
from lectern.functions.schedule import meeting_days, time_of_day
from lectern.operators.catalog import quality_score


@dataclass(frozen=True)
class Filters:
    """Wanted values; an empty text or tuple asks nothing, a bound of zero asks."""

    course_codes: tuple[str, ...] = ()
    department: str = ""
    term: str = ""
    days: tuple[str, ...] = ()
    time_of_day: str = ""
    instructor: str = ""
    points_min: float | None = None
    points_max: float | None = None
    keywords: tuple[str, ...] = field(default=())

    @property
    def anchored(self) -> bool:
        """Whether anything at all is asked for."""
        return bool(self.course_codes or self.department or self.schedule or self.points or any(k.strip() for k in self.keywords))

    @property
    def schedule(self) -> bool:
        return bool(self.term or self.days or self.time_of_day or self.instructor)

    @property
    def points(self) -> bool:
        return self.points_min is not None or self.points_max is not None


def instructor_matches(actual: Column, wanted: str) -> Column:
    """Whether the wanted name, or each of its parts of two letters or more, is in the actual one."""
    have, need = F.lower(F.trim(F.coalesce(actual, F.lit("")))), wanted.strip().lower()
    parts = [p for p in need.split() if len(p) > 1]
    every = F.lit(bool(parts))
    for p in parts:
        every &= have.contains(p)
    return (have != "") & F.lit(bool(need)) & (have.contains(need) | every)


def section_matches(s: Column, f: Filters, points: bool = True) -> Column:
    """One predicate over one section: every condition holds on the same offering."""
    test = F.lit(True)
    if f.term:
        test &= F.lower(F.trim(F.coalesce(s["term"], F.lit("")))) == f.term.strip().lower()
    if f.instructor:
        test &= instructor_matches(s["instructor"], f.instructor)
    if points and f.points:
        value = points_value(s["points"])
        test &= F.coalesce(ranges_overlap(value["lo"], value["hi"], f.points_min, f.points_max), F.lit(False))
    raw = F.trim(F.coalesce(s["times"], F.lit("")))
    if f.days:
        days = F.transform(F.when(raw != "", meeting_days(raw)).otherwise(F.coalesce(s["days"], F.array().cast("array<string>"))), F.lower)
        test &= F.size(F.array_except(F.array(*(F.lit(d.strip().lower()) for d in f.days)), days)) == 0
    if f.time_of_day:
        test &= F.when(raw != "", time_of_day(raw)).otherwise(F.lower(F.coalesce(s["time_of_day"], F.lit("")))) == f.time_of_day.strip().lower()
    return F.coalesce(test, F.lit(False))


def visible(index: DataFrame) -> DataFrame:
    """Rows of published courses; a missing status counts as published."""
    status = F.col("catalog_validation_status")
    return index.where(status.isNull() | (status == "published"))


def stage1(index: DataFrame, f: Filters) -> DataFrame:
    """Courses that fit the filters, with ``matched_sections``, null where no section was asked for.

    Points hold on a matching section if all schedule matches have readable
    points, else on the range of the course.
    """
    rows = visible(index)
    if f.course_codes:
        rows = rows.where(F.upper("course_code").isin(*(c.strip().upper() for c in f.course_codes)))
    if f.department:
        # Prefixes are upper-case in the index; a bare column lets the scan skip row groups.
        rows = rows.where(F.col("department_prefix") == f.department.strip().upper())
    fits = F.filter("sections_summary", lambda s: section_matches(s, f, points=False)) if f.schedule else F.col("sections_summary")
    rows = rows.withColumn("matched_sections", fits)
    if f.schedule:
        rows = rows.where(F.size("matched_sections") > 0)
    if f.points:
        exact = (F.size("matched_sections") > 0) & F.forall("matched_sections", lambda s: points_value(s["points"]).isNotNull())
        rows = rows.withColumn("exact", exact).withColumn("matched_sections", F.when(F.col("exact"), F.filter("matched_sections", lambda s: section_matches(s, f))).otherwise(F.col("matched_sections")))
        rows = rows.where(F.when(F.col("exact"), F.size("matched_sections") > 0).otherwise(ranges_overlap(F.col("points_min"), F.col("points_max"), f.points_min, f.points_max))).drop("exact")
    shown = F.lit(f.schedule) | (F.lit(f.points) & (F.size("sections_summary") > 0))
    return rows.withColumn("matched_sections", F.when(shown, F.col("matched_sections")))


def quality() -> Column:
    """Quality of a row, computed; the index holds it as ``quality``."""
    return quality_score(F.col("title"), F.col("course_code"), F.col("has_description"), F.col("sections_summary"))


def with_quality(index: DataFrame) -> DataFrame:
    return index if "quality" in index.columns else index.withColumn("quality", quality())


def retrieve(index: DataFrame, details: DataFrame, f: Filters, limit: int = 5) -> DataFrame:
    """Ranked courses that fit, with their details: filter, rank, look details up, test them again, then limit.

    Filters that ask for nothing find nothing. Keywords rank the courses that
    other filters leave; alone they filter. ``details`` (course_uid and columns
    that replace those of the index, as after an overlay) may lack a course,
    which then is dropped, or show that it doesn't fit any more; so the limit
    comes last. Adds ``place``, from 1.
    """
    if not f.anchored:
        return index.withColumns({"matched_sections": F.col("sections_summary"), "place": F.lit(1)}).limit(0)
    filters = replace(f, keywords=())
    found = stage1(index, filters).drop("matched_sections")
    fresh = [c for c in details.columns if c != "course_uid"]
    found = found.drop(*(c for c in fresh if c in found.columns and c != "quality")).join(details, "course_uid")
    found = stage1(found, filters).withColumn("score", keyword_score(f.keywords))
    if f.keywords and not filters.anchored:
        found = found.where("score > 0")
    order = [F.desc("score"), F.desc("quality"), level(F.col("course_code")), "course_code", "title", "course_uid"]
    best = with_quality(found).orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(W.orderBy(*order)))


def keyword_score(keywords: Sequence[str]) -> Column:
    """5 for a keyword in the code, 3 in the title, 1 in the searchable text, plain containment."""
    score = F.lit(0)
    for k in dict.fromkeys(w.strip().lower() for w in keywords if w and w.strip()):
        for name, weight in (("course_code", 5), ("title", 3), ("searchable_text", 1)):
            score = score + F.when(F.lower(F.coalesce(name, F.lit(""))).contains(k), weight).otherwise(0)
    return score


def keyword_topk(index: DataFrame, keywords: Sequence[str], limit: int | None = 15, min_score: int = 1) -> DataFrame:
    """Best matches, with ``score`` and ``quality``; without keywords the 20 best by quality.

    Equal rows are ordered by quality, level, code, title and uid.
    """
    rows = with_quality(visible(index)).withColumn("score", keyword_score(keywords))
    if any(w and w.strip() for w in keywords):
        rows = rows.where(F.col("score") >= min_score)
    else:
        limit = 20
    order = [F.desc("score"), F.desc("quality"), level(F.col("course_code")), "course_code", "title", "course_uid"]
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def quality_sort(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Courses by quality, level, code and uid."""
    rows = with_quality(visible(index)).orderBy(F.desc("quality"), level(F.col("course_code")), "course_code", "course_uid")
    return rows if limit is None else rows.limit(limit)


def distinct_code_first(rows: DataFrame, order: Sequence, limit: int) -> DataFrame:
    """``limit`` rows in ``order``, the best of every code before any second one; blank codes are all their own.

    Adds ``place``. Only the first ``limit`` rows of a code can be shown, so no
    more of them are sorted together.
    """
    own = F.when(F.trim(F.coalesce("course_code", F.lit(""))) == "", F.concat(F.lit("uid:"), "course_uid")).otherwise(F.upper(F.trim("course_code")))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy(own).orderBy(*order))).where(F.col("nth") <= max(limit, 0))
    best = ranked.orderBy((F.col("nth") > 1).cast("int"), *order).limit(max(limit, 0))
    return best.withColumn("place", F.row_number().over(W.orderBy((F.col("nth") > 1).cast("int"), *order))).drop("nth")


def with_metadata(rows: DataFrame, order: Sequence, limit: int) -> DataFrame:
    """The first ``limit`` rows with total, displayed and truncated."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(*order).limit(limit).join(F.broadcast(total))
    return shown.withColumn("displayed", F.least("total", F.lit(limit).cast("long"))).withColumn("truncated", F.col("total") > F.col("displayed"))


def beginner_order(rows: DataFrame, order: Sequence) -> DataFrame:
    """Courses not known to be unsuitable: positives by priority, then the unknown, each in ``order``."""
    kept = rows.where(F.col("suitability.status") != "negative")
    return kept.orderBy(F.when(F.col("suitability.status") == "positive", F.col("suitability.priority")).otherwise(9), *order)


def extreme_with_ties(rows: DataFrame, value: str, least: bool = True) -> DataFrame:
    """All rows with the smallest (largest) known value; rows of unknown value never win (``unknown_rows`` lists those)."""
    edge = rows.agg((F.min if least else F.max)(value).alias("edge"))
    return rows.join(F.broadcast(edge), F.col(value) == F.col("edge")).drop("edge")


def unknown_rows(rows: DataFrame, value: str) -> DataFrame:
    """The rows that an extreme leaves out because their value isn't known."""
    return rows.where(F.col(value).isNull())


# Fixed value: keywords that ask for more of the same.
GENERIC = ("other", "another", "more", "additional", "else")


def ambiguous_recommendation(intent: Column, generic: Sequence[str] = GENERIC) -> Column:
    """Whether a recommendation names no department, code or topic of its own."""
    words = F.filter(F.transform(F.coalesce(intent["keywords"], F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    named = (F.coalesce(intent["department"], F.lit("")) != "") | (F.size(F.coalesce(intent["course_codes"], F.array().cast("array<string>"))) > 0)
    return (F.lower(F.coalesce(intent["query_type"], F.lit(""))) == "recommend") & ~named & F.forall(words, lambda w: w.isin(*generic))


def at_positions(results: DataFrame, ordinals: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of earlier results that ordinals (key, ordinal, nth: its order in the question) name; an ordinal beyond them names none."""
    return ordinals.join(results, [key]).where(F.col("ordinal") == F.col(position))


def counted_reference(results: DataFrame, key: str, uid: str, wanted: str) -> DataFrame:
    """Results of keys whose number of results is the number asked for (``wanted``), each uid once and none blank; other keys have none."""
    fits = results.groupBy(key).agg(
        (F.count(F.lit(1)) == F.max(wanted)).alias("as_many"), (F.count_distinct(uid) == F.count(F.lit(1))).alias("distinct"), F.bool_and(F.coalesce(F.trim(uid), F.lit("")) != "").alias("named"))
    return results.join(fits.where("as_many and distinct and named").select(key), key, "left_semi")


def codes_of_winners(basis: DataFrame, winners: DataFrame, uid: str = "course_uid", order: str = "position") -> DataFrame:
    """Rows of the basis whose uid is among the winners, in the basis' order."""
    return basis.join(winners.select(uid).distinct(), uid, "left_semi").orderBy(order)
