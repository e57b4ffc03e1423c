"""Course codes: a department of 2 to 4 letters, a level and a four-digit number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import squash

# Levels in use and the form of a code.
LEVELS = ("B", "C", "E", "W", "UN", "GU", "GR")
BODY = r"(?:[A-Z]{2,4}[\s_-]+(?:UN|GU|GR|[A-Z])[\s_-]*\d{4}|[A-Z]{2,4}(?:UN|GU|GR|[A-Z])\d{4})"
SEPARATED = r"(?i)^\s*([A-Z]{2,4})[\s_-]+(UN|GU|GR|[A-Z])[\s_-]*(\d{4})\s*$"
COMPACT_TWO = r"(?i)^\s*([A-Z]{2,4})(UN|GU|GR)(\d{4})\s*$"
#: A crawled title line: a code of a looser form, then the title.
TITLE_LINE = (r"^([A-Z]{2,6}\s+[A-Z]{0,3}\d{4}[A-Z]?)\s+(.*)$", r"^([A-Z]{2,6}\s+\d{4}[A-Z]?)\s+(.*)$")
TITLE_POINTS = r"(?i)(\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?\s+points?)\s*\.?\s*$"
COMPACT_ONE = r"(?i)^\s*([A-Z]{2,4})([A-Z])(\d{4})\s*$"


def _parts(c: Column, pattern: str) -> Column:
    dept, level, number = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(number != "", F.struct(F.upper(dept).alias("department"), F.upper(level).alias("level"), number.alias("number")))


def parse_code(c: Column) -> Column:
    """Struct of department, level and number of one complete code, else null."""
    return F.coalesce(_parts(c, SEPARATED), _parts(c, COMPACT_TWO), _parts(c, COMPACT_ONE))


def normalize_code(c: Column) -> Column:
    """``DEPT LEVEL1234`` or null."""
    p = parse_code(c)
    return F.when(p.isNotNull(), F.concat(p["department"], F.lit(" "), p["level"], p["number"]))


def is_code(c: Column) -> Column:
    return F.coalesce(normalize_code(c).isNotNull(), F.lit(False))


def is_current_level(c: Column) -> Column:
    return parse_code(c)["level"].isin(*LEVELS)


def extract_codes(text: Column, distinct: bool = True) -> Column:
    """Normalised codes of a text in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(?<![A-Z0-9])({BODY})(?![A-Z0-9])"), F.lit(1))
    codes = F.array_compact(F.transform(found, lambda x: normalize_code(x)))
    return F.array_distinct(codes) if distinct else codes


def department(code: Column) -> Column:
    """First word of a code in upper case, empty for null."""
    return F.upper(F.coalesce(F.regexp_extract(F.trim(code), r"^([^ ]*)", 1), F.lit("")))


def level(code: Column) -> Column:
    """The four digits that end a code, 9999 without."""
    return F.coalesce(F.regexp_extract(F.coalesce(code, F.lit("")), r"(\d{4})\s*$", 1).try_cast("int"), F.lit(9999))


def title_line(line: Column) -> Column:
    """Struct code, title, points and issues of a crawled title line such as ``COMS W1004 Introduction. 3 points``."""
    raw = squash(line)
    points = squash(F.regexp_extract(raw, TITLE_POINTS, 1))
    head = F.when(points != "", F.regexp_replace(squash(F.regexp_replace(raw, TITLE_POINTS, "")), r"[.\s]+$", "")).otherwise(raw)
    found = [(F.regexp_extract(head, p, 1), F.regexp_extract(head, p, 2)) for p in TITLE_LINE]
    code = F.when(found[0][0] != "", found[0][0]).otherwise(found[1][0])
    rest = F.when(found[0][0] != "", found[0][1]).when(found[1][0] != "", found[1][1]).otherwise(head)
    title = F.regexp_replace(rest, r"^[ .]+|[ .]+$", "")
    issues = F.array_compact(F.array(F.when(points == "", "missing_points_in_title"), F.when(code == "", "missing_course_code_or_title"), F.when(title == "", "empty_title")))
    return F.struct(squash(code).alias("code"), title.alias("title"), points.alias("points"), issues.alias("issues"))
