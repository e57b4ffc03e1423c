"""Completion and normalisation of single course records, and small column rules about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.codes import department, normalize_code
from lectern.functions.credits import points_value
from lectern.functions.text import squash

#: Fixed value: section fields that an overlay may set.
OVERLAY_FIELDS = ("term", "section_id", "catalog_ref", "course_number", "section_call_number", "times", "location", "instructor", "points", "enrollment_raw", "enrollment_current", "enrollment_capacity")


def allowed(payload: Column, fields: tuple[str, ...] = OVERLAY_FIELDS) -> Column:
    """The entries of a payload map that may be set."""
    return F.map_filter(payload, lambda k, v: k.isin(*fields))


def course_uid(code: Column, title: Column) -> Column:
    """SHA-1 that names an imported course."""
    return F.sha1(F.concat_ws("|", F.trim(code), F.trim(title)).cast("binary"))


def with_points(rows: DataFrame) -> DataFrame:
    """points_min and points_max read from points_raw where either is missing or zero."""
    raw = points_value(F.col("points_raw"))
    missing = (F.coalesce("points_min", F.lit(0.0)) == 0) | (F.coalesce("points_max", F.lit(0.0)) == 0)
    keep = lambda c, end: F.when(missing & raw.isNotNull(), raw[end]).otherwise(F.col(c))
    return rows.withColumns({"points_min": keep("points_min", "lo"), "points_max": keep("points_max", "hi")})


def completed(rows: DataFrame, year: str) -> DataFrame:
    """An imported record with code, uid, year and sources filled in."""
    code = F.coalesce(normalize_code(F.col("course_code")), squash(F.col("course_code")))
    told = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", "imported").otherwise("none")
    rows = with_points(rows.withColumn("course_code", code))
    return rows.withColumns({
        "course_uid": course_uid(F.col("course_code"), F.col("title")), "bulletin_year": F.lit(year), "department_or_group": department(F.col("course_code")),
        "description_source": told("description"), "prerequisites_source": told("prerequisites_text"),
    })


def missing_fields(rows: DataFrame, fields: tuple[str, ...] = ("course_code", "title", "description", "points_raw", "prerequisites_text")) -> Column:
    """Names of blank fields."""
    return F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", f) for f in fields)))


def single_department(codes: Column) -> Column:
    """The department of all codes of an array, null if they have several or none."""
    prefixes = F.array_distinct(F.transform(codes, department))
    return F.when(F.size(prefixes) == 1, F.element_at(prefixes, 1))


def filled_down(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """``column`` with blanks replaced by the last value above, within each key."""
    value = F.nullif(F.trim(column), F.lit(""))
    return rows.withColumn(column, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays have the same elements."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def robots_allow(path: Column, disallowed: Column) -> Column:
    """Whether no disallowed prefix (array, null if unknown) begins the path."""
    return ~F.exists(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: (p != "") & path.startswith(p))


def facts(code: Column, points: Column, instructors: Column, description: Column) -> Column:
    """Facts about a course as lines; what is unknown has no line."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    return F.concat_ws("\n", code, line("Credits: ", points), line("Instructors: ", F.array_join(instructors, ", ")), line("Description: ", F.trim(description)))


def suitability_line(place: Column, code: Column, title: Column, found: Column) -> Column:
    """A course with the evidence that it suits beginners."""
    return F.concat(place.cast("string"), F.lit(". "), code, F.lit(" - "), title, F.when(found["evidence"] != "", F.concat(F.lit(" ("), found["evidence"], F.lit(")"))).otherwise(""))


#: Fixed value: fields of a manual import and the names that its first section may have for them.
ALIASES = {
    "term": ("term",), "section_id": ("section_id", "section_call_number"), "points_raw": ("points_raw", "points"), "times": ("times",), "location": ("location",),
    "instructor": ("instructor",), "enrollment_raw": ("enrollment_raw",), "enrollment_current": ("enrollment_current",), "enrollment_capacity": ("enrollment_capacity",),
}


def with_first_section(rows: DataFrame, fields: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Blank fields filled from the first of ``sections``, by any of their names there; ``sections`` is dropped."""
    names = rows.schema["sections"].dataType.elementType.names
    first = F.get("sections", F.lit(0))
    shown = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    known = {f: [first[n] for n in aliases if n in names] for f, aliases in fields.items() if f in rows.columns}
    return rows.withColumns({f: F.coalesce(shown(F.col(f)), *(shown(c) for c in found)).cast(rows.schema[f].dataType) for f, found in known.items() if found}).drop("sections")


def course_identity(uid: Column, code: Column) -> Column:
    """What tells courses apart in a conversation: uid, else code, in upper case; null if both are blank."""
    return F.upper(F.coalesce(F.nullif(F.trim(uid), F.lit("")), F.nullif(F.trim(code), F.lit(""))))


def first_mentions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Courses of each conversation once, at their first mention; rows without an identity stay."""
    who = course_identity(F.col("course_uid"), F.col("course_code"))
    nth = F.row_number().over(W.partitionBy(key, who).orderBy(order))
    return rows.withColumn("nth", nth).where((F.col("nth") == 1) | who.isNull()).drop("nth")


def provider_failure(kind: Column, text: Column) -> Column:
    """Class of a failure of an outside service, by the kind of error (timeout, connection or other) and its text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: F.coalesce(*(F.when(low.contains(w), True) for w in words), F.lit(False))
    return (
        F.when(kind == "timeout", "timeout").when(has("429", "rate limit", "too many requests"), "rate_limited")
        .when(has("truncat", "token limit", "finish_reason=length"), "truncated")
        .when(has("ended before", "malformed", "invalid event", "without answer content", "protocol"), "invalid_stream")
        .when(kind == "connection", "unreachable").when(has("connect", "transport", "network"), "unreachable").otherwise("provider_error")
    )


def canonical_json(*columns: str) -> Column:
    """JSON of named columns in the order of their names, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def response_guard(basis_size: Column, follow_up: Column, answer: Column, empty_text: Column) -> Column:
    """The text shown: without a basis, and not following up, the text for no results instead of an answer."""
    return F.when((basis_size == 0) & ~follow_up, empty_text).otherwise(answer)
