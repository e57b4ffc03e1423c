"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of a file is named by the SHA-256 of its text. The ledger has a
row per blob and scan: the rule versions that were applied and the spans that
each of them found. A scan takes the distinct blobs of the given versions, drops the rule
versions that the ledger already has for a blob, searches only what is left,
appends to the ledger, and joins what the rule versions now in force have found
back to every path; findings of versions that no longer are stay in the ledger.

Positions come from built-in functions alone: for a pattern without look-around
the pieces that ``split`` leaves and the matches that ``regexp_extract_all``
returns alternate, so the running sum of their lengths is each match's place.

Defined results: null text is the empty text; repeated rows are reported each;
other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import shared_path


class Rule(NamedTuple):
    """A pattern without look-around; a match counts if ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the contract.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Public token formats that the base patterns do not name.
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", 1, r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0, 27),
)
SPANS = "array<struct<start:long,rule:int,kind:string,end:long>>"
#: In the ledger a span names the rule and version that found it.
LEDGER = "blob binary, rules array<string>, spans array<struct<start:long,rule:string,kind:string,end:long>>"


def blob_of(text: str) -> F.Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def search(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows for ``blobs`` (blob, text, due): the due rules and their spans in each."""
    due = lambda r: F.array_contains("due", r.key)
    hit = blobs.select("blob", "text", "due", F.array_compact(F.array(*(
        F.when(due(r) & F.col("text").rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)))).alias("hits"))
    at = []
    for i, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        pieces = F.transform(F.split("text", r.pattern, -1), F.length)
        found = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
        group = F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), F.length)
        at.append(F.when(F.array_contains("hits", F.lit(i)), F.arrays_zip(pieces.alias("gap"), found.alias("len"), group.alias("val"))))
    # One row per match; what has no match stays as a single row.
    per_rule = F.filter(F.transform(F.array(*(F.struct(F.lit(i).alias("rule"), a.alias("at")) for i, a in enumerate(at))), lambda x: x), lambda x: x["at"].isNotNull())
    rows = hit.select("blob", "due", F.explode_outer(per_rule).alias("r")).select("blob", "due", "r.rule", F.posexplode_outer("r.at").alias("pos", "m"))
    run = W.partitionBy("blob", "rule").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    size = F.coalesce("m.len", F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + size).over(run))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rule") + 1)
    key = F.element_at(F.array(*(F.lit(r.key) for r in rules)), F.col("rule") + 1)
    span = F.when(F.col("m.val") >= least, F.struct((F.col("end") - size).cast("long").alias("start"), key.alias("rule"), kind.alias("kind"), F.col("end").cast("long").alias("end")))
    return rows.groupBy("blob").agg(F.first("due").alias("rules"), F.array_sort(F.collect_list(span)).alias("spans"))


def scan(versions: DataFrame, ledger_path: str, path: str = "path", text: str = "text", rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Findings of every version under ``rules``: ``path`` and spans, sorted by start and then by rule.

    ``versions`` has a row per path and historical version. The ledger is a
    Parquet folder that grows by what had not been scanned before.
    """
    spark = versions.sparkSession
    named = versions.select(F.col(path), F.coalesce(F.col(text), F.lit("")).alias("text"), blob_of(text).alias("blob"))
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    if has_ledger(spark, ledger_path):
        seen = spark.read.schema(LEDGER).parquet(ledger_path).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("due") > 0).drop("seen")
    else:
        blobs = blobs.withColumn("due", keys)
    search(blobs, rules).write.mode("append").parquet(ledger_path)
    # A rule's place in the list orders spans of one start; spans of other versions have none.
    place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
    current = F.filter(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.try_element_at(place, s["rule"]).alias("rule"), s["kind"].alias("kind"), s["end"].alias("end"))), lambda s: s["rule"].isNotNull())
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.size("spans") > 0).withColumn("spans", current)
    known = known.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = named.select(path, "blob").join(known, "blob", "left")
    return found.select(path, F.hex("blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def has_ledger(spark, path: str) -> bool:
    """Whether a ledger was begun at ``path``, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def digest(findings: DataFrame) -> DataFrame:
    """The contract's columns from findings by doc_id."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE_RULES)))
    return findings.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as the versions of a first scan, with a ledger of their own in the shared folder."""
    return digest(scan(docs, shared_path(docs.sparkSession, "ledger"), path="doc_id"))


def rescan_documents(docs: DataFrame) -> DataFrame:
    """Documents scanned as a first commit, then a second commit in which every third one has a new last line.

    doc_id, commit, n_spans of every version of both commits, and scanned, the
    number of blobs that the second scan had to search: those that the ledger
    didn't know yet.
    """
    spark, ledger = docs.sparkSession, shared_path(docs.sparkSession, "ledger")
    scan(docs, ledger, path="doc_id")
    before = spark.read.schema(LEDGER).parquet(ledger).count()
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\ntoken=rotated-"), F.col("doc_id").cast("string"))
    changed = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, line).otherwise(F.col("text")).alias("text"))
    commits = docs.select("doc_id", "text", F.lit(1).alias("commit")).union(changed.withColumn("commit", F.lit(2)))
    found = scan(commits.select(F.struct("doc_id", "commit").alias("path"), "text"), ledger)
    scanned = spark.read.schema(LEDGER).parquet(ledger).count() - before
    return found.select("path.doc_id", "path.commit", F.size("spans").alias("n_spans"), F.lit(scanned).alias("scanned"))
