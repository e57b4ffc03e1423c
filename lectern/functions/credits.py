"""Credit constraints in free text, and points and enrollment cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import fold, let, squash

MAX_POINTS, MAX_ENROLLMENT = 30.0, 100_000

# The phrases of the four languages, accents folded.
NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"(?:credits?|creditos?|points?|puntos?|units?|unidades?|学分)"
LOWER_BEFORE = (
    r"(?:at\s+least|no\s+less\s+than|not\s+less\s+than|minimum(?:\s+of)?|al\s+menos|como\s+minimo|no\s+menos\s+de|"
    r"au\s+moins|minimum(?:\s+de)?|至少|最少|不低于)\s*"
)
UPPER_BEFORE = (
    r"(?:at\s+most|no\s+more\s+than|not\s+more\s+than|maximum(?:\s+of)?|up\s+to|como\s+maximo|a\s+lo\s+sumo|"
    r"no\s+mas\s+de|au\s+plus|maximum(?:\s+de)?|最多|至多|不超过)\s*"
)
LOWER_AFTER = r"(?:or\s+more|and\s+above|o\s+mas|ou\s+plus|以上|起)"
UPPER_AFTER = r"(?:or\s+less|or\s+fewer|o\s+menos|ou\s+moins|以下|以内)"
BETWEEN = rf"(?:between|entre)\s*({NUMBER})\s*(?:and|y|et)\s*({NUMBER})"
RANGE = rf"({NUMBER})\s*(?:-|~|to|through|a|hasta|au|到|至)\s*({NUMBER})"


def _double(c: Column) -> Column:
    """A number's text as double; a group that didn't match is null before the cast, which is dear to fail."""
    return F.nullif(c, F.lit("")).try_cast("double")


def credit_constraint(text: Column) -> Column:
    """Struct (min, max) of the credits that a phrase asks for, either side open, else null.

    Bounds come before ranges and ranges before an exact number, which alone
    needs a unit; bounds that contradict each other give null.
    """
    plain = F.regexp_replace(F.regexp_replace(fold(text), "[–—−]", "-"), r"(?<=\d),(?=\d)", ".")
    return let(plain, _constraint)


def _constraint(t: Column) -> Column:
    number = lambda pattern, group=1: _double(F.regexp_extract(t, pattern, group))
    low = F.coalesce(number(rf"{LOWER_BEFORE}({NUMBER})"), number(rf"({NUMBER})\s*(?:{UNIT}\s*)?{LOWER_AFTER}"))
    high = F.coalesce(number(rf"{UPPER_BEFORE}({NUMBER})"), number(rf"({NUMBER})\s*(?:{UNIT}\s*)?{UPPER_AFTER}"))
    made = lambda a, b: F.struct(a.alias("min"), b.alias("max"))
    ends = lambda p: F.when(number(p).isNotNull(), made(F.least(number(p), number(p, 2)), F.greatest(number(p), number(p, 2))))
    exact = number(rf"({NUMBER})\s*{UNIT}(?U:\b)")
    bounded = low.isNotNull() | high.isNotNull()
    return F.when(bounded & ~F.coalesce(low > high, F.lit(False)), made(low, high)).when(
        ~bounded, F.coalesce(ends(BETWEEN), ends(RANGE), F.when(exact.isNotNull(), made(exact, exact)))
    )


def points_value(c: Column) -> Column:
    """Struct (lo, hi) of a complete points cell with 0 <= lo <= hi <= 30, else null."""
    pattern = rf"(?i)^\s*({NUMBER})(?:\s*(?:-|–|—|to)\s*({NUMBER}))?(?:\s*(?:points?|credits?|pts?))?\s*$"
    lo = lambda t: _double(F.regexp_extract(t, pattern, 1))
    ends = let(squash(c), lambda t: F.struct(lo(t).alias("lo"), F.coalesce(_double(F.regexp_extract(t, pattern, 2)), lo(t)).alias("hi")))
    return let(ends, lambda e: F.when((e["lo"] <= e["hi"]) & (e["hi"] <= MAX_POINTS), e))


def enrollment_value(c: Column) -> Column:
    """Struct (ok, current, capacity) of an enrollment cell; an empty cell is fine and unknown."""
    pair, single = r"^(\d{1,9})\s*/\s*(\d{1,9})$", r"^(\d{1,9})$"
    number = lambda t, pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("int")
    read = let(squash(c), lambda t: F.struct((t == "").alias("empty"), F.coalesce(number(t, pair, 1), number(t, single, 1)).alias("current"), number(t, pair, 2).alias("capacity")))
    fits = lambda v: v["empty"] | F.coalesce((v["current"] <= MAX_ENROLLMENT) & (F.coalesce(v["capacity"], F.lit(0)) <= MAX_ENROLLMENT), F.lit(False))
    return let(read, lambda v: F.struct(fits(v).alias("ok"), F.when(fits(v), v["current"]).alias("current"), F.when(fits(v), v["capacity"]).alias("capacity")))


def ranges_overlap(actual_min: Column, actual_max: Column, wanted_min: float | None, wanted_max: float | None) -> Column:
    """Whether a range of credits meets the wanted one; one known end stands for both, none is no match."""
    if wanted_min is None and wanted_max is None:
        return F.lit(True)
    a, b = F.coalesce(actual_min, actual_max), F.coalesce(actual_max, actual_min)
    fits = F.lit(True)
    if wanted_min is not None:
        fits &= F.greatest(a, b) >= F.lit(float(wanted_min))
    if wanted_max is not None:
        fits &= F.least(a, b) <= F.lit(float(wanted_max))
    return F.coalesce(fits, F.lit(False))


def answer_budget(rows: Column) -> Column:
    """Tokens allowed for an answer about ``rows`` courses."""
    return F.greatest(F.lit(768), F.least(F.lit(4096), F.lit(512) + 120 * rows))


def crawled_points(text: Column) -> Column:
    """Struct lo, hi of a crawler's points cell: a number or two joined by a hyphen, after the word points is taken out; null otherwise."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "points|point", ""), r"^[.\s]+|[.\s]+$", ""))
    number = lambda x: F.nullif(F.trim(x), F.lit("")).try_cast("double")
    left, right = F.regexp_extract(clean, "(?s)^([^-]*)-(.*)$", 1), F.regexp_extract(clean, "(?s)^([^-]*)-(.*)$", 2)
    lo = F.when(clean.contains("-"), number(left)).otherwise(number(clean))
    hi = F.when(clean.contains("-"), number(right)).otherwise(number(clean))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))
