"""Fill-in-middle transformation: texts cut in three and written prefix, suffix, middle or suffix, prefix, middle.

Where a text may be cut is a set of byte offsets in its UTF-8 form, one more
than it has units (code points, or what a regular expression matches). The set
is kept as Roaring bitmaps are: offsets that agree in all but their low 16 bits
share a container, which is a sorted array, a bitmap or a list of runs,
whichever is smallest, and containers carry cumulative cardinalities. The offset
of a rank is found by a search over the cumulative cardinalities and a select
inside one container, so plain ASCII, one run for 65,536 offsets, costs
next to nothing, and a text of any length takes at most an eighth of its bytes.
Only offsets come back from Python; the parts are cut and joined by Spark.

Defined results: null text is empty, and an empty text is plain; a text that
holds one of the marks is plain; a missing doc_id counts as an empty one; a text
without units is all suffix; repeated rows are transformed each, alike; other
columns are kept by ``transformed`` (those named like its own results give way) and ignored by ``digests``; an empty table gives no
rows. Texts must be shorter than 2 GB, as Spark's strings are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import named

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = "1"
#: Of 100 texts, those from this number on stay plain; of 100 others, those below the second have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
CHUNK = 1 << 16
#: Bytes of a container as a bitmap, and for each value of an array and each run.
BITMAP, VALUE, RUN = 8192, 2, 4
CUT = "n long, first long, second long, head long, mid long"


class Container:
    """Some of the numbers below 65,536, in the smallest of three forms."""

    def __init__(self, member: np.ndarray):
        self.size = int(np.count_nonzero(member))
        edges = np.flatnonzero(np.diff(member.view(np.int8), prepend=0, append=0))
        runs = len(edges) // 2
        cost, self.kind = min((RUN * runs, "run"), (VALUE * self.size, "array"), (BITMAP, "bitmap"))
        self.bytes = cost
        if self.kind == "run":
            self.starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
            self.before = np.cumsum(lengths) - lengths
        elif self.kind == "array":
            self.values = np.flatnonzero(member).astype(np.uint16)
        else:
            self.words = np.packbits(np.pad(member, (0, CHUNK - len(member))), bitorder="little").view("<u8")
            counts = np.bitwise_count(self.words).astype(np.int64)
            self.before = np.cumsum(counts) - counts

    def select(self, rank: int) -> int:
        """The member that ``rank`` others precede."""
        if self.kind == "array":
            return int(self.values[rank])
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        rest = rank - int(self.before[at])
        if self.kind == "run":
            return int(self.starts[at]) + rest
        bits = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return 64 * at + int(np.flatnonzero(bits)[rest])


class Boundaries:
    """A set of byte offsets; containers by the offsets' high bits."""

    def __init__(self, chunks: Iterator[tuple[int, np.ndarray]]):
        """``chunks``: high bits in rising order, each with flags of the offsets it holds."""
        self.keys, self.containers, counts = [], [], []
        for key, member in chunks:
            held = Container(member)
            if held.size:
                self.keys.append(key)
                self.containers.append(held)
                counts.append(held.size)
        self.cumulative = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if self.containers else 0

    def select(self, rank: int) -> int:
        """The offset that ``rank`` smaller ones precede."""
        at = int(np.searchsorted(self.cumulative, rank, side="right"))
        return self.keys[at] * CHUNK + self.containers[at].select(rank - (int(self.cumulative[at - 1]) if at else 0))


def code_points(text: bytes) -> Boundaries:
    """Where code points begin, and the end."""
    data = np.frombuffer(text, dtype=np.uint8)

    def chunks() -> Iterator[tuple[int, np.ndarray]]:
        for key in range(len(data) // CHUNK + 1):
            part = data[key * CHUNK : (key + 1) * CHUNK]
            begins = (part & 0xC0) != 0x80
            yield key, np.append(begins, True) if len(part) < CHUNK else begins

    return Boundaries(chunks())


def matches(text: bytes, unit: regex.Pattern) -> Boundaries:
    """Where a text may be cut between units: its beginning, the end of each match, its end for the last one's."""
    points = code_points(text)
    ends = [points.select(m.end()) for m in unit.finditer(text.decode(errors="replace")) if m.end() > m.start()]
    offsets = np.array([0, *ends[:-1], *([len(text)] if ends else [])], dtype=np.int64)

    def chunks() -> Iterator[tuple[int, np.ndarray]]:
        for key in np.unique(offsets // CHUNK).tolist():
            member = np.zeros(CHUNK, dtype=bool)
            member[offsets[offsets // CHUNK == key] % CHUNK] = True
            yield key, member

    return Boundaries(chunks())


def cut_of(unit: str | None):
    """A column function of text (binary) and two hashes: units, both cut offsets in bytes, units before the first and between."""

    @F.pandas_udf(CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = regex.compile(unit) if unit else None
        for texts, one, two in batches:
            out = []
            for text, a, b in zip(texts, one, two, strict=True):
                at = matches(text, found) if found else code_points(text)
                low, high = sorted((a % len(at), b % len(at)))
                out.append((len(at) - 1, at.select(low), at.select(high), low, high - low))
            yield pd.DataFrame(out, columns=["n", "first", "second", "head", "mid"], dtype="int64")

    return cut


def hashes(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def written(prefix: Column, middle: Column, suffix: Column, form: Column, text: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The output of a form; parts and text are binary."""
    p, s, m = (F.lit(x).cast("binary") for x in marks)
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm).cast("string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Parts hold no mark, so the first mark after a part ends it."""
    p, s, m = marks

    def parts(begin: str, inner: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(begin) + 1, 2**31 - 1)
        one = F.substring_index(body, inner, 1)
        rest = F.substr(body, F.length(one) + len(inner) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def unambiguous(marks: tuple[str, ...]) -> bool:
    """Whether marks can be found again: no mark is empty, in another, or begins as another or itself ends."""
    ends_as = lambda a, b: any(b[-k:] == a[:k] for k in range(1, min(len(a), len(b))))
    return len(set(marks)) == len(marks) and all(marks) and not any((a != b and a in b) or ends_as(a, b) for a in marks for b in marks)


def transformed(docs: DataFrame, unit: str | None = None, marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: str = SEED) -> DataFrame:
    """``docs`` with n, form, prefix_units, middle_units and output; ``unit`` is a regular expression, None for code points."""
    if not unambiguous(marks):
        raise ValueError("marks must be three, none inside another and none beginning as one ends")
    own = [named(c) for c in docs.columns if c not in ("n", "form", "prefix_units", "middle_units", "output", "_fim")]
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    body = F.col("_fim.body")
    rows = docs.select(*own, F.struct(text.cast("binary").alias("body"), form.alias("form"), cut_of(unit)(text.cast("binary"), h1, h2).alias("cut")).alias("_fim"))
    first, second = F.col("_fim.cut.first").cast("int"), F.col("_fim.cut.second").cast("int")
    prefix, middle, suffix = F.substr(body, F.lit(1), first), F.substr(body, first + 1, second - first), F.substr(body, second + 1)
    split = F.col("_fim.form") != "plain"
    output = written(prefix, middle, suffix, F.col("_fim.form"), body, marks)
    return rows.select(*own, F.col("_fim.cut.n").alias("n"), F.col("_fim.form").alias("form"), F.when(split, F.col("_fim.cut.head")).alias("prefix_units"), F.when(split, F.col("_fim.cut.mid")).alias("middle_units"), output.alias("output"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of each output and of the text rebuilt from it."""
    rows = transformed(docs.select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
