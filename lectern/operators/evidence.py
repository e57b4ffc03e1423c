"""Evidence bundle of an import: where a source text says what was read out of it.

Claims (doc_id, section, field, value) are looked up in their document's text:
values as they are, whatever the case; points by number, so that 3, 3.0 and
3 points are one. A section is tied to a place by a term and the section id that
follows it; its other fields count only near that place and before the next
one. Claims of a course as a whole (section null) take the first place found.

A document's text meets its claims once; what comes after are joins and windows
over spans. Offsets are code points of the text with white space squashed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.text import span_distance
from lectern.operators.importing import bounded_pairs
from lectern.session import packed

# How a source writes terms, section ids and points, and how far apart what belongs together may be.
TERM = r"(?<![A-Za-z])(?:Fall|Spring|Summer|Winter)\s+\d{4}(?!\d)"
SECTION_ID = r"(?<![A-Za-z0-9])\d{1,4}/\d{3,8}(?![A-Za-z0-9])"
POINTS = r"(?<![A-Za-z0-9./:])(\d+(?:\.\d+)?(?:\s*(?:-|–|—|to)\s*\d+(?:\.\d+)?)?(?:\s*(?:points?|credits?|pts?))?)(?![A-Za-z0-9./:])"
IDENTITY_GAP = FIELD_GAP = 240
MOST_POINTS = 30.0
CELL = re.compile(r"(\d+(?:\.\d+)?)(?:\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?))?(?:\s*(?:points?|credits?|pts?))?", re.I)
#: Numbers in words that stand for points.
WORDS = {w: float(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
SPANS = {"kind": "string", "section": "long", "field": "string", "value": "string", "start": "int", "stop": "int", "said": "string"}
SPACE = re.compile(r"\s+")


def points_of(text: str) -> tuple[float, float] | None:
    """Least and most points of a complete expression, digits or a word."""
    text = SPACE.sub(" ", text).strip()
    words = text.lower().split()
    if words and words[0] in WORDS and (len(words) == 1 or re.fullmatch(r"points?|credits?|pts?", words[1])) and len(words) < 3:
        return WORDS[words[0]], WORDS[words[0]]
    met = CELL.fullmatch(text)
    if not met:
        return None
    low, high = float(met[1]), float(met[2] or met[1])
    return (low, high) if low <= high <= MOST_POINTS else None


def occurrences(source: str, value: str) -> Iterator[tuple[int, int]]:
    """Non-overlapping places of a value, letters in either case."""
    for met in re.finditer(re.escape(value), source, re.I) if value else ():
        yield met.span()


SPELLED = re.compile(r"(?<![A-Za-z0-9])((?:" + "|".join(WORDS) + r")\s+(?:points?|credits?|pts?))(?![A-Za-z0-9])", re.I)
TERMS, SECTION_IDS, NUMBERS = re.compile(TERM, re.I), re.compile(SECTION_ID), re.compile(POINTS, re.I)


def numbers_said(source: str) -> list[tuple[int, int, tuple[float, float]]]:
    """Places of a text that say points, and what they say."""
    found = sorted(m.span(1) for pattern in (NUMBERS, SPELLED) for m in pattern.finditer(source))
    return [(a, b, said) for a, b in found if (said := points_of(source[a:b]))]


def number_spans(source: str, value: str, said: list | None = None) -> Iterator[tuple[int, int]]:
    """Places of points that are the same numbers as ``value``; ``said`` is what the text says, if it is known."""
    wanted = points_of(value)
    if wanted is not None:
        yield from ((a, b) for a, b, n in (numbers_said(source) if said is None else said) if abs(n[0] - wanted[0]) <= 1e-9 and abs(n[1] - wanted[1]) <= 1e-9)


def spans_of_claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, source, asked) of squashed texts and their claims to one row for each place of patterns and of claimed values."""
    for batch in batches:
        out = []
        for doc, source, asked in zip(batch["doc_id"], batch["source"], batch["asked"], strict=True):
            found = [("term", None, None, None, *m.span()) for m in TERMS.finditer(source)]
            found += [("section_id", None, None, None, *m.span()) for m in SECTION_IDS.finditer(source)]
            said = None
            for c in asked if asked is not None else ():
                if c["field"] == "points" and said is None:
                    said = numbers_said(source)
                places = number_spans(source, c["value"], said) if c["field"] == "points" else occurrences(source, c["value"])
                found += [("claim", c["section"], c["field"], c["value"], a, b) for a, b in places]
            out += [(doc, *f, source[f[-2] : f[-1]].lower()) for f in found]
        rows = pd.DataFrame(out, columns=["doc_id", *SPANS])
        yield rows.astype({"section": "Int64"})


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def spans(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """doc_id and one place each: kind (term, section_id, claim), section, field, value, start, stop and what is said there in lower case."""
    asked = claims.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("section").cast("long").alias("section"), "field", squashed(F.col("value")).alias("value"))).alias("asked"))
    rows = sources.select("doc_id", squashed(F.col("text")).alias("source")).join(asked, "doc_id")
    kind = ", ".join(f"{name} {of}" for name, of in SPANS.items())
    return rows.select("doc_id", "source", "asked").mapInPandas(spans_of_claims, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kind}")


def hulls(rows: DataFrame, key: str, gap: int) -> DataFrame:
    """Spans of a key merged where no more than ``gap`` lies between them: key, start, stop and the spans in each."""
    order = W.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = rows.withColumn("new", (F.coalesce(F.col("start") - reach > gap, F.lit(True))).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("spans")).drop("island")


def identity_pairs(found: DataFrame) -> DataFrame:
    """doc_id, place (numbered), term and id spans and texts, and the hull of both: each term with the first id after it, before the next term."""
    anchor = lambda kind: found.where((F.col("kind") == kind) | ((F.col("kind") == "claim") & (F.col("field") == kind))).select("doc_id", "start", "stop", "said").distinct()
    terms = anchor("term").select("doc_id", "start", "stop", F.col("said").alias("term"))
    ids = anchor("section_id").select("doc_id", F.col("start").alias("at"), F.struct("stop", "said").alias("id"))
    pairs = bounded_pairs(terms, ids, "doc_id", "start", "stop", "at", "id", IDENTITY_GAP)
    return pairs.select(
        "doc_id", "term", F.col("right_id.said").alias("section_id"), F.col("start").alias("term_start"), F.col("stop").alias("term_stop"),
        F.col("right_at").alias("id_start"), F.col("right_id.stop").alias("id_stop"),
    )


def bundle(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Each claim with verified, start, stop and quote, and whether its section is tied to a place.

    Defined results: equal claims are one; null or blank values are never
    verified; claims of documents without a text neither; a document without
    claims gives no rows.
    """
    claims = claims.select("doc_id", F.col("section").cast("long").alias("section"), "field", squashed(F.col("value")).alias("value")).distinct()
    # A checkpoint of these rows is many times the size of the texts.
    found = packed(spans(sources, claims))
    pairs = identity_pairs(found)
    # Where the context of a place ends: at the next one, else some way on.
    following = F.lead("from").over(W.partitionBy("doc_id").orderBy("from", "to"))
    hull = pairs.select("doc_id", F.col("term_start").alias("from"), F.greatest("term_stop", "id_stop").alias("to")).distinct().withColumn("until", following)
    pairs = pairs.join(hull, (pairs["doc_id"] == hull["doc_id"]) & (pairs["term_start"] == hull["from"]) & (F.greatest("term_stop", "id_stop") == hull["to"])).drop(hull["doc_id"])
    # A section's place is the pair that says its term and id, the closest of several.
    said = lambda field: F.max(F.when(F.col("field") == field, F.lower("value")))
    sections = claims.where("section is not null").groupBy("doc_id", "section").agg(said("term").alias("term"), said("section_id").alias("section_id"))
    gap = span_distance(F.col("term_start"), F.col("term_stop"), F.col("id_start"), F.col("id_stop"))
    place = F.struct(gap.alias("gap"), "term_start", "term_stop", "id_start", "id_stop", "from", "to", "until")
    tied = sections.join(pairs, ["doc_id", "term", "section_id"]).groupBy("doc_id", "section").agg(F.min(place).alias("at"))
    spots = found.where("kind = 'claim'").select("doc_id", "section", "field", "value", "start", "stop")
    local = spots.where("section is not null and field not in ('term', 'section_id')").join(tied, ["doc_id", "section"])
    away = span_distance(F.col("start"), F.col("stop"), F.col("at.from"), F.col("at.to"))
    local = local.where((F.col("start") >= F.col("at.from")) & (F.col("stop") <= F.coalesce("at.until", F.col("at.to") + FIELD_GAP)) & (away <= FIELD_GAP))
    key = ["doc_id", "section", "field", "value"]
    best = lambda rows, *order: rows.groupBy(*key).agg(F.min(F.struct(*order, "start", "stop")).alias("b")).select(*key, "b.start", "b.stop")
    names = [("term", "at.term_start", "at.term_stop"), ("section_id", "at.id_start", "at.id_stop")]
    named = [claims.where(F.col("field") == f).join(tied, ["doc_id", "section"]).select(*key, F.col(a).alias("start"), F.col(b).alias("stop")) for f, a, b in names]
    loose = spots.where("section is null or field in ('term', 'section_id')").join(tied.select("doc_id", "section"), ["doc_id", "section"], "left_anti")
    spans_found = reduce(DataFrame.unionByName, [*named, best(local, away.alias("away")), best(loose)])
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    rows = claims.alias("c").join(spans_found.alias("f"), same, "left").select("c.*", "f.start", "f.stop")
    texts = sources.select("doc_id", squashed(F.col("text")).alias("source"))
    rows = rows.join(texts, "doc_id", "left").join(tied.select("doc_id", "section", F.lit(True).alias("tied")), ["doc_id", "section"], "left")
    quote = F.expr("substring(source, greatest(start - 30, 0) + 1, least(stop + 30, length(source)) - greatest(start - 30, 0))")
    return rows.select(*key, F.col("start").isNotNull().alias("verified"), "start", "stop", F.when(F.col("start").isNotNull(), quote).otherwise("").alias("quote"), F.coalesce("tied", F.lit(False)).alias("identity_associated"))
