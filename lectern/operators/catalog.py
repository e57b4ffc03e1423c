"""Section and course validation, and the enriched, searchable course index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.codes import department, extract_codes, level
from lectern.functions.credits import enrollment_value, points_value
from lectern.functions.schedule import CLOCK, is_schedule, is_term, meeting_days, time_of_day
from lectern.functions.text import let, squash
from lectern.session import materialised

#: Fixed value: titles of placeholder and research courses.
PLACEHOLDER = (
    r"(?i)\b(tutorial|seminar|projects?|topics?|research|readings?|independent\s+study|special\s+topics?|fieldwork|internship|"
    r"thesis|dissertation|colloquium|practicum|advanced\s+study)\b"
)
#: Fixed value: course warnings that don't keep a course from being searched.
HARMLESS = ("missing_description",)
SECTION = (
    "struct<term:string,section_call_number:string,times:string,location:string,instructor:string,points:string,"
    "enrollment_raw:string,enrollment_current:int,enrollment_capacity:int>"
)


def not_a_name(instructor: Column) -> Column:
    """Whether an instructor cell holds points, an enrollment or a clock range."""
    text = squash(instructor)
    return (text != "") & (points_value(text).isNotNull() | text.rlike(r"^\d+(\s*/\s*\d+)?$") | text.rlike(CLOCK))


def section_errors(s: Column, identity: bool = False) -> Column:
    """Names of what is wrong with a section, in a fixed order."""
    return let(enrollment_value(s["enrollment_raw"]), lambda raw: _errors(s, raw, identity))


def _errors(s: Column, raw: Column, identity: bool) -> Column:
    current, capacity = s["enrollment_current"], s["enrollment_capacity"]
    term, number = squash(s["term"]), squash(s["section_call_number"])
    beyond = lambda n: (n < 0) | (n > 100_000)
    checks = [
        ((term != "") & ~is_term(term), "invalid_term"),
        ((term == "") & F.lit(identity), "missing_term"),
        ((number == "") & F.lit(identity), "missing_section_id"),
        (~is_schedule(s["times"]), "invalid_times"),
        (not_a_name(s["instructor"]), "invalid_instructor"),
        (points_value(s["points"]).isNull(), "invalid_points"),
        (~raw["ok"], "invalid_enrollment_raw"),
        (raw["ok"] & beyond(current), "invalid_enrollment_current"),
        (raw["ok"] & beyond(capacity), "invalid_enrollment_capacity"),
        (raw["ok"] & ~beyond(current) & (raw["current"] != current), "enrollment_current_mismatch"),
        (raw["ok"] & ~beyond(capacity) & (raw["capacity"] != capacity), "enrollment_capacity_mismatch"),
    ]
    return F.array_compact(F.array(*(F.when(c, name) for c, name in checks)))


def section_warnings(s: Column) -> Column:
    """Names of what makes a section worth a look."""
    return let(enrollment_value(s["enrollment_raw"]), lambda raw: _warnings(s, raw))


def _warnings(s: Column, raw: Column) -> Column:
    good = lambda n: F.when(n.between(0, 100_000), n)
    current, capacity = F.coalesce(good(s["enrollment_current"]), raw["current"]), F.coalesce(good(s["enrollment_capacity"]), raw["capacity"])
    return F.array_compact(F.array(
        F.when(raw["ok"] & (current > capacity), "enrollment_exceeds_capacity"),
        F.when(raw["ok"] & capacity.isNull() & current.isNotNull(), "enrollment_capacity_unknown"),
    ))


def section_summary(s: Column) -> Column:
    """A section with squashed texts, derived days and time of day, and its validation."""
    found = F.struct(s.alias("s"), section_errors(s).alias("errors"), section_warnings(s).alias("warnings"))

    def body(v: Column) -> Column:
        s, fine = v["s"], F.size(v["errors"]) == 0
        return F.struct(
            squash(s["section_call_number"]).alias("section_id"), squash(s["term"]).alias("term"), squash(s["times"]).alias("times"),
            F.when(fine, meeting_days(s["times"])).otherwise(F.array().cast("array<string>")).alias("days"),
            F.when(fine, time_of_day(squash(s["times"]))).otherwise("").alias("time_of_day"),
            squash(s["instructor"]).alias("instructor"), squash(s["location"]).alias("location"), squash(s["points"]).alias("points"),
            s["enrollment_current"].alias("enrollment_current"), s["enrollment_capacity"].alias("enrollment_capacity"),
            F.when(fine & (F.size(v["warnings"]) == 0), "published").otherwise("review").alias("status"), v["errors"].alias("errors"), v["warnings"].alias("warnings"),
        )

    return let(found, body)


#: Different cells of a field up to which what was read out of them goes to every task.
BROADCAST_CELLS = 100_000


#: Fields whose cells are texts to be read.
FIELDS = ("times", "term", "instructor", "points", "enrollment_raw")


def different_cells(rows: DataFrame) -> DataFrame:
    """(field, cell): the different cells of the fields that are read, however many sections have them."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in FIELDS))
    return rows.select(F.explode(pairs).alias("p")).select("p.field", "p.cell").distinct()


def read_cell(field: Column, cell: Column) -> Column:
    """What a cell of a field says, and whether it is wrong there."""
    text, raw = squash(cell), enrollment_value(cell)
    of = lambda name, value: F.when(field == name, value)
    wrong = of("term", (text != "") & ~is_term(text)), of("times", ~is_schedule(cell)), of("instructor", not_a_name(cell)), of("points", points_value(cell).isNull()), of("enrollment_raw", ~raw["ok"])
    return F.struct(
        text.alias("text"), F.coalesce(*wrong).alias("wrong"), of("times", meeting_days(cell)).alias("days"), of("times", time_of_day(text)).alias("time_of_day"),
        of("enrollment_raw", raw["current"]).alias("current"), of("enrollment_raw", raw["capacity"]).alias("capacity"),
    )


def validated(rows: DataFrame, identity: bool = False, undealt: DataFrame | None = None) -> DataFrame:
    """Flat sections with ``summary``, as ``section_summary`` gives it for one section.

    Cells are read in a table of the different ones and joined back; all else is
    plain columns, so that fields nobody asks for aren't computed. ``undealt`` are
    the same sections before a shuffle, where their cells are looked up.
    """
    cells = materialised(different_cells(rows if undealt is None else undealt))
    few = {r["field"] for r in cells.groupBy("field").count().where(F.col("count") <= BROADCAST_CELLS).collect()}
    read = cells.where(F.col("field").isin(*few)).select("field", "cell", read_cell(F.col("field"), F.col("cell")).alias("read")) if few else None
    for f in FIELDS:
        if f in few:
            one = read.where(F.col("field") == f).select(F.col("cell").alias(f"_c_{f}"), F.col("read").alias(f"_{f}"))
            rows = rows.join(F.broadcast(one), F.col(f).eqNullSafe(F.col(f"_c_{f}")), "left").drop(f"_c_{f}")
        else:
            # Cells that hardly repeat are read where they are, which costs less than a join of all rows.
            rows = rows.withColumn(f"_{f}", read_cell(F.lit(f), F.col(f)))
    current, capacity, raw = F.col("enrollment_current"), F.col("enrollment_capacity"), F.col("_enrollment_raw")
    fine = ~raw["wrong"]
    beyond = lambda n: F.coalesce((n < 0) | (n > 100_000), F.lit(False))
    number = squash(F.col("section_call_number"))
    checks = [
        (F.col("_term.wrong"), "invalid_term"), ((F.col("_term.text") == "") & F.lit(identity), "missing_term"), ((number == "") & F.lit(identity), "missing_section_id"),
        (F.col("_times.wrong"), "invalid_times"), (F.col("_instructor.wrong"), "invalid_instructor"), (F.col("_points.wrong"), "invalid_points"), (~fine, "invalid_enrollment_raw"),
        (fine & beyond(current), "invalid_enrollment_current"), (fine & beyond(capacity), "invalid_enrollment_capacity"),
        (fine & ~beyond(current) & (raw["current"] != current), "enrollment_current_mismatch"), (fine & ~beyond(capacity) & (raw["capacity"] != capacity), "enrollment_capacity_mismatch"),
    ]
    named = lambda pairs: F.array_compact(F.array(*(F.when(c, name) for c, name in pairs)))
    good = lambda n: F.when(n.between(0, 100_000), n)
    seats, room = F.coalesce(good(current), raw["current"]), F.coalesce(good(capacity), raw["capacity"])
    warnings = [(fine & (seats > room), "enrollment_exceeds_capacity"), (fine & room.isNull() & seats.isNotNull(), "enrollment_capacity_unknown")]
    rows = rows.withColumns({"_errors": named(checks), "_warnings": named(warnings)})
    sound = F.size("_errors") == 0
    summary = F.struct(
        number.alias("section_id"), F.col("_term.text").alias("term"), F.col("_times.text").alias("times"), F.when(sound, F.col("_times.days")).otherwise(F.array().cast("array<string>")).alias("days"),
        F.when(sound, F.col("_times.time_of_day")).otherwise("").alias("time_of_day"), F.col("_instructor.text").alias("instructor"), squash(F.col("location")).alias("location"), F.col("_points.text").alias("points"),
        current.alias("enrollment_current"), capacity.alias("enrollment_capacity"), F.when(sound & (F.size("_warnings") == 0), "published").otherwise("review").alias("status"),
        F.col("_errors").alias("errors"), F.col("_warnings").alias("warnings"),
    )
    return rows.withColumn("summary", summary).drop("_errors", "_warnings", *(f"_{f}" for f in ("times", "term", "instructor", "points", "enrollment_raw")))


def summaries(sections: DataFrame, key: str, order: list[str], undealt: DataFrame | None = None) -> DataFrame:
    """(key, checked): the summaries of each course's sections, in order."""
    rows = validated(sections, undealt=undealt).select(key, F.struct(*order, "summary").alias("s"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select(key, F.col("s.summary").alias("checked"))


def course_warnings(needs_review: Column, review_warnings: Column, parse_warnings: Column) -> Column:
    """Course-level warnings: explicit ones, else those of the parser that are not about sections."""
    parsed = F.filter(F.coalesce(parse_warnings, F.array().cast("array<string>")), lambda w: (w != "enrollment_parse_warning") & ~w.startswith("section_validation:"))
    named = F.array_distinct(F.filter(F.transform(F.coalesce(review_warnings, parsed), squash), lambda w: w != ""))
    return F.when(F.coalesce(needs_review, F.lit(False)) & (F.size(named) == 0), F.array(F.lit("legacy_needs_review"))).otherwise(named)


def course_status(warnings: Column) -> Column:
    return F.when(F.size(F.array_except(warnings, F.array(*map(F.lit, HARMLESS)))) > 0, "review").otherwise("published")


def quality_score(title: Column, code: Column, has_description: Column, sections: Column) -> Column:
    """How choosable a course is: described, offered, with times and teachers, no placeholder, of a low level."""
    number = level(code)
    points = lambda test, n: F.when(test, n).otherwise(0)
    offered = F.size(sections) > 0
    return (
        points(has_description, 30) + points(offered, 25)
        + points(F.exists(sections, lambda s: F.trim(s["times"]) != ""), 10) + points(F.exists(sections, lambda s: F.trim(s["instructor"]) != ""), 5)
        + points(F.coalesce(title, F.lit("")).rlike(PLACEHOLDER), -45) + F.when(number < 6000, 20).when(number >= 9000, -30).otherwise(-10)
    )


def searchable_text(names: dict[str, str]) -> Column:
    """Lower-case text to search a row of the index in; ``names`` expands department prefixes."""
    expand = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    expanded = F.coalesce(expand[F.col("department_prefix")], F.lit("")) if names else F.lit("")
    parts = F.concat(
        F.array("course_code", "title"), F.col("all_instructors"), F.array(expanded), F.col("all_terms"),
        F.flatten(F.transform("sections_summary", lambda s: s["days"])), F.transform("sections_summary", lambda s: s["time_of_day"]),
        F.array(F.substring(F.trim(F.coalesce("description", F.lit(""))), 1, 200)), F.col("prerequisites_codes"),
    )
    return F.lower(squash(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " ")))


def enrich(courses: DataFrame, names: dict[str, str] | None = None, checked: DataFrame | None = None, key: str = "course_uid") -> DataFrame:
    """The index: one row per course with its published sections apart from those to review.

    ``courses`` has the detail columns and ``sections``, an array of SECTION; or
    ``checked`` has the ``summaries`` of flat sections by ``key``, a column of both.
    The index holds what queries rank and filter by, so that they read no more.
    """
    if checked is None:
        rows = courses.withColumn("checked", F.transform(F.coalesce("sections", F.array().cast(f"array<{SECTION}>")), section_summary))
    else:
        rows = courses.join(checked, key, "left")
        rows = rows.withColumn("checked", F.coalesce("checked", F.array().cast(rows.schema["checked"].dataType)))
    rows = rows.withColumns({
        "sections_summary": F.filter("checked", lambda s: s["status"] == "published"),
        "review_sections_summary": F.filter("checked", lambda s: s["status"] != "published"),
    })
    distinct = lambda field: F.array_distinct(F.filter(F.transform("sections_summary", lambda s: s[field]), lambda x: x != ""))
    rows = rows.withColumns({
        "department_prefix": department(F.col("course_code")), "prerequisites_codes": extract_codes(F.col("prerequisites_text")),
        "has_description": F.trim(F.coalesce("description", F.lit(""))) != "", "all_instructors": distinct("instructor"), "all_terms": distinct("term"),
        "catalog_validation_warnings": course_warnings(F.col("needs_review"), F.col("course_review_warnings"), F.col("parse_warnings")),
    })
    rows = rows.withColumn("catalog_validation_status", course_status(F.col("catalog_validation_warnings")))
    rows = rows.withColumn("quality", quality_score(F.col("title"), F.col("course_code"), F.col("has_description"), F.col("sections_summary")))
    return rows.withColumn("searchable_text", searchable_text(names or {})).drop("checked", "sections")


def build_summary(index: DataFrame) -> DataFrame:
    """One row: courses, departments, terms and described courses."""
    terms = index.select(F.explode_outer("all_terms").alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return index.agg(
        F.count(F.lit(1)).alias("n_courses"), F.countDistinct("department_prefix").alias("n_departments"), F.count_if("has_description").alias("n_described"),
    ).join(terms)
