"""Text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def folding_table() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended whose decomposition is one ASCII letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = folding_table()


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column) -> Column:
    """Runs of white space, no-break space included, as one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\u00a0]+", " "))


def unaccent(c: Column) -> Column:
    """Letters without their accents."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def fold(c: Column) -> Column:
    """Lower case without accents, white space squashed."""
    return squash(F.lower(unaccent(F.coalesce(c, F.lit("")))))


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def contains_alias(text: Column, alias: str) -> Column:
    """Whether an ASCII alias stands alone, also between characters of other scripts."""
    quoted = r"\Q" + alias + r"\E"
    return text.rlike(f"(?i)(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")


def escape_markdown(c: Column) -> Column:
    """Markdown's special characters with a backslash."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")


def clip(c: Column, limit: int, marker: str = "\n...\n") -> Column:
    """At most ``limit`` characters: two thirds from the head, the rest from the tail, a marker between."""
    room = max(limit - len(marker), 0)
    head = room * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(room - head)))
    return F.when(F.length(c) <= limit, c).otherwise(F.substring(cut, 1, limit))


def first_sentence(c: Column) -> Column:
    """Struct of the first sentence and the rest."""
    head = F.regexp_extract(c, r"(?s)^(.*?[.?!])\s+(.*)$", 1)
    return F.struct(F.when(head != "", head).otherwise(c).alias("first"), F.regexp_extract(c, r"(?s)^(.*?[.?!])\s+(.*)$", 2).alias("rest"))


def sentence_around(text: Column, pattern: str, limit: int = 500) -> Column:
    """The sentence around the first match of ``pattern``, empty without one."""
    return F.substring(squash(F.regexp_extract(text, rf"(?i)([^.。]*(?:{pattern})[^.。]*[.。]?)", 1)), 1, limit)


# Headings that a description follows, in the order of trust.
DESCRIPTION_HEADS = ("course\\s+description|description", "module|topics?|outline|syllabus")


def description_in(c: Column) -> Column:
    """A description taken from a text: the paragraph after a heading, else the whole text if it is long enough, 1,200 characters at most; else empty."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    after = lambda heads: squash(F.regexp_extract(text, rf"(?is)(?:{heads})\s*[:：]?\s*(.{{80,2000}}?)(?:\n\s*\n|$)", 1))
    first, second = (after(heads) for heads in DESCRIPTION_HEADS)
    whole = squash(text)
    found = F.when(F.length(first) >= 20, first).when(F.length(second) >= 20, second).when(F.length(whole) >= 120, whole).otherwise("")
    return F.substring(found, 1, 1200)


def without_thoughts(c: Column) -> Column:
    """Text without <think> blocks, closed or not."""
    return F.regexp_replace(c, r"(?is)<think>.*?(</think>|$)", "")


def embedded_json(c: Column) -> Column:
    """The first candidate of a reply that is JSON: all of it, a fenced block, the outermost braces; thoughts taken out last."""
    fenced = lambda x: F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = lambda x: F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    plain = without_thoughts(c)
    tries = [F.trim(c), fenced(c), braces(c), F.trim(plain), fenced(plain), braces(plain)]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & t.startswith("{") & t.endswith("}"), t) for t in tries))


def strict_count(c: Column, most: int = 100_000) -> Column:
    """A whole number from 0 to ``most`` written in digits, else null."""
    n = F.when(F.trim(c).rlike(r"^\d{1,9}$"), F.trim(c)).try_cast("int")
    return F.when(n <= most, n)


def running(lengths: Column) -> Column:
    """Sums of an array up to each of its elements, by pieces of about the square root of its size."""

    def pieces(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(step, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda k: F.slice(v, k * n + 1, n)))

    total = lambda v: F.aggregate(v, F.lit(0), lambda a, b: a + b)
    within = lambda c, before: F.transform(c, lambda x, i: before + total(F.slice(c, 1, i + 1)))
    summed = lambda p, sums: F.flatten(F.transform(p, lambda c, k: let(total(F.slice(sums, 1, k)), lambda before: within(c, before))))
    sums = let(lengths, lambda v: let(pieces(v), lambda p: let(F.transform(p, total), lambda sums: summed(p, sums))))
    return F.when(F.size(lengths) > 0, sums).otherwise(lengths)


def spans_of(text: Column, needle: Column) -> Column:
    """Start and end of every non-overlapping occurrence, upper and lower case alike."""
    low, sought = F.lower(text), F.lower(needle)
    gaps = F.transform(F.split(low, F.concat(F.lit(r"\Q"), sought, F.lit(r"\E")), -1), lambda x: F.length(x))
    # A value that a lambda names is computed once; an expression in it, once for each element.
    starts = let(gaps, lambda g: running(F.slice(g, 1, F.size(g) - 1)))
    size = F.length(sought)
    found = F.transform(starts, lambda s, i: F.struct((s + i * size).alias("start"), (s + (i + 1) * size).alias("end")))
    return F.when((F.length(sought) > 0) & (F.length(low) > 0), found).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0))


def span_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two spans, 0 if they meet."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)
