"""Import assessment: quality score, hard errors, the three-way gate and evidence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.schedule import has_clock_range
from lectern.functions.codes import is_code, normalize_code
from lectern.functions.credits import MAX_POINTS, points_value

#: Fixed value: score from which an import without issues is published.
PUBLISH = 80


def import_issues(code: Column, title: Column, description: Column, points_raw: Column, points_min: Column, known: list[str]) -> Column:
    """Struct (score, issues): what an import lacks and 100 less its price, at least 0.

    ``known`` are the department prefixes in use.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    canonical = normalize_code(code)
    size = F.length(text(title))
    prefix = F.split_part(F.coalesce(canonical, F.lit("")), F.lit(" "), F.lit(1))
    # Prices of what is missing.
    checks = [
        (canonical.isNull(), 40, F.lit("invalid_course_code")),
        (size < 3, 30, F.lit("title_too_short")),
        ((size >= 3) & (size < 8), 10, F.lit("title_suspiciously_short")),
        ((F.coalesce(points_min, F.lit(0.0)) <= 0) & (text(points_raw) == ""), 15, F.lit("missing_points")),
        (text(description) == "", 10, F.lit("missing_description")),
        ((prefix != "") & ~prefix.isin(*known), 20, F.concat(F.lit("unknown_department:"), prefix)),
    ]
    score = F.lit(100)
    for test, price, _ in checks:
        score = score - F.when(test, price).otherwise(0)
    return F.struct(F.greatest(F.lit(0), score).alias("score"), F.array_compact(F.array(*(F.when(t, name) for t, _, name in checks))).alias("issues"))


def hard_errors(code: Column, title: Column, points_raw: Column, points_min: Column, points_max: Column) -> Column:
    """What keeps an import from being stored at all."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    raw = points_value(points_raw)
    beyond = lambda c: (c < 0) | (c > MAX_POINTS)
    checks = [
        (text(code) == "", "missing_course_code"), ((text(code) != "") & ~is_code(code), "invalid_course_code"),
        (text(title) == "", "missing_title"), ((text(title) != "") & (F.length(text(title)) < 3), "title_too_short"),
        ((text(points_raw) != "") & raw.isNull(), "invalid_points_raw"), (beyond(points_min), "invalid_points_min"), (beyond(points_max), "invalid_points_max"),
        (points_min > points_max, "points_min_exceeds_max"), (raw.isNull() & points_min.isNull() & points_max.isNull(), "missing_points"),
        (raw["lo"] != points_min, "points_raw_min_mismatch"), (raw["hi"] != points_max, "points_raw_max_mismatch"),
    ]
    return F.array_compact(F.array(*(F.when(t, name) for t, name in checks)))


def gate(errors: Column, score: Column, issues: Column) -> Column:
    """rejected with a hard error, review below the score or with issues, else published."""
    return F.when(F.size(errors) > 0, "rejected").when((score < PUBLISH) | (F.size(issues) > 0), "review").otherwise("published")


def following_pairs(left: DataFrame, right: DataFrame, key: str, at: str, right_id: str, most: Column) -> DataFrame:
    """Forward as-of join: each left row with the first right row of its key at or after it, at most ``most`` later.

    The key's rows meet once in an equi-join bounded by the gap; the nearest is a
    minimum, so nothing is ordered together.
    """
    right = right.select(F.col(key).alias("k"), F.col(at).alias("right_at"), F.col(right_id).alias("right_id"))
    pairs = left.join(right, (F.col(key) == F.col("k")) & (F.col("right_at") >= F.col(at)) & (F.col("right_at") <= F.col(at) + most))
    keep = [c for c in left.columns]
    return pairs.groupBy(*keep).agg(F.min(F.struct("right_at", "right_id")).alias("m")).select(*keep, "m.right_at", "m.right_id")


def nearest_pairs(left: DataFrame, right: DataFrame, key: str, at: str, right_id: str, most: Column) -> DataFrame:
    """Each left row with the nearest right row of its key on either side, at most ``most`` away; the earlier one of two."""
    right = right.select(F.col(key).alias("k"), F.col(at).alias("right_at"), F.col(right_id).alias("right_id"))
    pairs = left.join(right, (F.col(key) == F.col("k")) & (F.col("right_at") >= F.col(at) - most) & (F.col("right_at") <= F.col(at) + most))
    gap = F.abs(F.unix_micros(F.col("right_at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")))
    keep = [c for c in left.columns]
    return pairs.withColumn("gap", gap).groupBy(*keep).agg(F.min(F.struct("gap", "right_at", "right_id")).alias("m")).select(*keep, "m.right_at", "m.right_id")


def bounded_pairs(left: DataFrame, right: DataFrame, key: str, at: str, end: str, right_at: str, right_id: str, most: int) -> DataFrame:
    """Forward as-of join inside a key: each left span with the first right row from its end on, before the next left row, at most ``most`` further on.

    Both sides are rows of one ordered list, so a window of each key finds the
    next left row and the first right row after each: no pair is built that
    isn't the answer. Left rows without a partner of their own are left out. Of
    right rows at one place the smallest id counts.
    """
    keep = [c for c in left.columns if c != key]
    lefts = left.select(F.col(key).alias("k"), F.col(end).alias("place"), F.lit(0).alias("side"), F.struct(*keep).alias("row"), F.lit(None).cast(right.schema[right_id].dataType).alias("rid"))
    ordered = W.partitionBy("k").orderBy(F.col(f"row.{at}"))
    lefts = lefts.withColumn("until", F.lead(F.col(f"row.{at}")).over(ordered))
    rights = right.select(F.col(key).alias("k"), F.col(right_at).cast(left.schema[end].dataType).alias("place"), F.lit(1).alias("side"), F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), F.col(right_id).alias("rid"), F.lit(None).cast(lefts.schema["until"].dataType).alias("until"))
    ahead = W.partitionBy("k").orderBy("place", "side", "rid").rowsBetween(1, W.unboundedFollowing)
    partner = F.first(F.when(F.col("side") == 1, F.struct(F.col("place").alias("right_at"), F.col("rid").alias("right_id"))), ignorenulls=True).over(ahead)
    found = lefts.unionByName(rights).withColumn("partner", partner).where("side = 0 and partner is not null")
    found = found.where((F.col("until").isNull() | (F.col("partner.right_at") < F.col("until"))) & (F.col("partner.right_at") - F.col("place") <= most))
    return found.select(F.col("k").alias(key), "row.*", "partner.*")


def matching_pairs(claims: DataFrame, pairs: DataFrame, by: list[str], distance: str, kept: list[str]) -> DataFrame:
    """Each claim with the pair that says the same in columns ``by`` (whatever the case) at the least distance; the first of ``kept`` of several."""
    folded = lambda t: [F.lower(F.trim(F.col(f"{t}.{c}"))) for c in by]
    same = [a == b for a, b in zip(folded("c"), folded("p"), strict=True)]
    rows = claims.alias("c").join(pairs.alias("p"), same)
    best = F.min(F.struct(F.col(f"p.{distance}"), *(F.col(f"p.{k}") for k in kept))).alias("best")
    return rows.groupBy(*(F.col(f"c.{c}") for c in claims.columns)).agg(best).select(*claims.columns, "best.*")


def reviewable(problem: Column, times: Column) -> Column:
    """Whether a section's error is worth a review: times that hold a clock range beside something else."""
    return (problem == "invalid_times") & has_clock_range(times)


def points_conflict(section_lo: Column, section_hi: Column, course_lo: Column, course_hi: Column) -> Column:
    """Whether a section's points leave the course's range."""
    return F.coalesce((section_lo < course_lo - 1e-9) | (section_hi > course_hi + 1e-9), F.lit(False))


def overall_status(status: Column) -> Column:
    """Aggregate: published if all are, review if any is in review, else rejected."""
    return F.when(F.bool_and(status == "published"), "published").when(F.bool_or(status == "review"), "review").otherwise("rejected")


def evidence_of(claims: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Each claim with the first span of its value in the source (start, stop), and whether it is verified."""
    first = spans.groupBy(*by).agg(F.min(F.struct("start", "stop")).alias("span"))
    return claims.join(first, by, "left").select(*claims.columns, "span.start", "span.stop", F.col("span").isNotNull().alias("verified"))


def anchors(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """Places in a source that name a term or section: those of patterns and those of claimed values, each once."""
    return found.unionByName(claimed).distinct()
