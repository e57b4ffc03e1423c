"""Validation of intents that a model has written, and the choice between several candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.codes import normalize_code
from lectern.functions.text import let
from lectern.plans.language import DEPARTMENT_WORDS

# What the fields of an intent may hold.
QUERY_TYPES = ("search", "compare", "recommend", "detail", "schedule", "general", "stats")
TIMES = ("morning", "afternoon", "evening")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
TERM = r"(?i)^(Spring|Summer|Fall|Winter)\s+\d{4}$"
MOST_POINTS = 30
#: Intents as JSON; a field of another kind makes the whole document unreadable, which is a problem of its own.
SCHEMA = (
    "query_type string, course_codes array<string>, comparison_targets array<string>, keywords array<string>, department string, suitability string, "
    "department_defaulted_from string, instructor string, time_preference string, day_preference array<string>, points_range array<double>, term string, original_question string"
)


def parsed(document: Column) -> Column:
    """An intent's fields from its JSON text; null where it isn't an object with fields of the right kinds."""
    strict = F.from_json(document, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    # Text fields must be texts: numbers would be read as their digits.
    texts = ("query_type", "department", "suitability", "department_defaulted_from", "instructor", "time_preference", "term", "original_question")

    def right(kinds: Column) -> Column:
        wrong = ~F.schema_of_variant(kinds).startswith("OBJECT")
        for name in texts:
            kind = F.schema_of_variant(F.try_variant_get(kinds, f"$.{name}", "variant"))
            wrong |= F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))
        return kinds.isNotNull() & ~wrong

    return F.when(let(F.try_parse_json(document), right), strict)


def problem(intent: Column, departments: Sequence[str] = tuple(DEPARTMENT_WORDS)) -> Column:
    """The first rule that an intent breaks, empty if it is valid; null counts as unreadable."""
    # Read once, not for every rule that names it.
    return let(intent, lambda i: _problem(i, departments))


def _problem(intent: Column, departments: Sequence[str]) -> Column:
    low = lambda name: F.lower(F.trim(intent[name]))
    listed = lambda name: F.coalesce(intent[name], F.array().cast("array<string>"))
    codes, targets = (F.transform(listed(c), normalize_code) for c in ("course_codes", "comparison_targets"))
    lists = ("course_codes", "comparison_targets", "keywords", "day_preference")
    blank = F.lit(False)
    for name in lists:
        blank |= F.exists(listed(name), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    lo, hi = F.get(intent["points_range"], F.lit(0)), F.get(intent["points_range"], F.lit(1))
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), x.isNull())
    days = F.array(*(F.lit(d.lower()) for d in DAYS))
    rules = [
        (intent.isNull(), "not an intent"),
        (~F.coalesce(intent["query_type"].isin(*QUERY_TYPES), F.lit(False)), "query_type"),
        (blank, "blank list item"),
        (F.exists(F.concat(codes, targets), lambda c: c.isNull()), "course code"),
        ((intent["query_type"] == "compare") & (F.size(codes) > 0) & (F.size(targets) > 0) & ((F.size(F.array_except(codes, targets)) > 0) | (F.size(F.array_except(targets, codes)) > 0)), "comparison_targets conflict"),
        ((intent["query_type"] != "compare") & (F.size(targets) > 0), "comparison_targets without compare"),
        (intent["department"].isNotNull() & ~F.upper(F.trim(intent["department"])).isin(*departments), "department"),
        (low("suitability").isNotNull() & (low("suitability") != "beginner"), "suitability"),
        (intent["department_defaulted_from"].isNotNull() & ~((low("department_defaulted_from") == "mathematics") & (F.upper(F.trim(F.coalesce(intent["department"], F.lit("")))) == "APMA")), "department_defaulted_from"),
        (low("time_preference").isNotNull() & ~low("time_preference").isin(*TIMES), "time_preference"),
        (F.exists(listed("day_preference"), lambda d: ~F.array_contains(days, F.lower(F.trim(d)))), "day_preference"),
        (intent["points_range"].isNotNull() & (F.size(intent["points_range"]) != 2), "points_range size"),
        (intent["points_range"].isNotNull() & lo.isNull() & hi.isNull(), "points_range without a bound"),
        (intent["points_range"].isNotNull() & ~(finite(lo) & finite(hi) & F.coalesce(lo >= 0, F.lit(True)) & F.coalesce(hi <= MOST_POINTS, F.lit(True)) & F.coalesce(lo <= hi, F.lit(True))), "points_range bounds"),
        (intent["term"].isNotNull() & ~(F.trim(intent["term"]).rlike(TERM) & (F.length(F.trim(intent["term"])) <= 64)), "term"),
    ]
    out = F.when(*rules[0][:1], rules[0][1])
    for broken, name in rules[1:]:
        out = out.when(F.coalesce(broken, F.lit(False)), name)
    return out.otherwise("")


def normalised(intent: Column) -> Column:
    """A valid intent in its normal form: codes normalised, each once; a comparison's targets are its codes; days and terms in their spelling."""
    codes, targets = (F.array_distinct(F.transform(F.coalesce(intent[c], F.array().cast("array<string>")), normalize_code)) for c in ("course_codes", "comparison_targets"))
    compared = (intent["query_type"] == "compare") & (F.size(codes) == 0)
    clean = lambda name: F.transform(F.coalesce(intent[name], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.struct(
        intent["query_type"].alias("query_type"), F.when(compared, targets).otherwise(codes).alias("course_codes"), targets.alias("comparison_targets"),
        clean("keywords").alias("keywords"), F.upper(F.trim(intent["department"])).alias("department"), F.lower(F.trim(intent["suitability"])).alias("suitability"),
        F.lower(F.trim(intent["department_defaulted_from"])).alias("department_defaulted_from"), F.nullif(F.trim(intent["instructor"]), F.lit("")).alias("instructor"),
        F.lower(F.trim(intent["time_preference"])).alias("time_preference"), F.array_distinct(F.transform(clean("day_preference"), F.initcap)).alias("day_preference"),
        F.get(intent["points_range"], F.lit(0)).alias("points_min"), F.get(intent["points_range"], F.lit(1)).alias("points_max"), F.trim(intent["term"]).alias("term"),
        F.coalesce(intent["original_question"], F.lit("")).alias("original_question"),
    )


def chosen(candidates: Sequence[tuple[str, Column]], minimal: Column) -> Column:
    """Struct of intent and source: the first candidate that there is, by its label, else ``minimal``."""
    source = F.lit("minimal")
    intent = minimal
    for label, candidate in reversed(list(candidates)):
        source = F.when(candidate.isNotNull(), label).otherwise(source)
        intent = F.coalesce(candidate, intent)
    return F.struct(intent.alias("intent"), source.alias("source"))
