"""Crawl upkeep: merging of repeated records, registry compaction and upsert, run reports, link traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.text import squash
from lectern.functions.web import url_path
from lectern.session import materialised

PREREQUISITE_START = r"(?i)^(pre-?requisites?|co-?requisites?)\b"


def distinct_lines(texts: Column) -> Column:
    """Squashed lines of an array of texts, each once, in order."""
    lines = F.flatten(F.transform(texts, lambda t: F.split(F.coalesce(t, F.lit("")), r"\r?\n")))
    return F.array_join(F.array_distinct(F.filter(F.transform(lines, squash), lambda x: x != "")), "\n")


def merge_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key: the best description, distinct prerequisite and note lines, distinct sections and warnings.

    A description that isn't a prerequisite text wins over one that is, then the
    longer, then the earlier. ``prerequisites_source`` is the common source, or
    ``merged``.
    """
    text = squash(F.col("description"))
    rank = F.struct(((text != "") & ~text.rlike(PREREQUISITE_START)).cast("int").alias("a"), F.length(text).alias("b"), (-F.col(order)).alias("c"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c])
    rows = records.groupBy(key).agg(
        F.max_by("description", rank).alias("description"), listed("prerequisites_text").alias("pre"), listed("notes_text").alias("notes"),
        F.collect_set(F.when(~F.col("prerequisites_source").isin("none", ""), F.col("prerequisites_source"))).alias("sources"),
        listed("sections").alias("sections"), F.collect_set("parse_warnings").alias("warnings"), F.count(F.lit(1)).alias("records"),
    )
    source = F.when(F.size("sources") == 0, "none").when(F.size("sources") == 1, F.element_at("sources", 1)).otherwise("merged")
    return rows.select(
        key, "description", distinct_lines(F.col("pre")).alias("prerequisites_text"), source.alias("prerequisites_source"), distinct_lines(F.col("notes")).alias("notes_text"),
        F.array_distinct(F.flatten(F.filter("sections", lambda s: s.isNotNull()))).alias("sections"),
        F.array_sort(F.array_distinct(F.flatten("warnings"))).alias("parse_warnings"), "records",
    )


def identity(year: Column, code: Column, url: Column) -> list[Column]:
    """Columns that name a course across crawls."""
    return [squash(year).alias("i_year"), F.upper(squash(code)).alias("i_code"), url_path(F.coalesce(url, F.lit(""))).alias("i_path")]


def compact_registry(registry: DataFrame, current: DataFrame) -> DataFrame:
    """One registry row per identity: the current crawl's key, else the key last and most often seen; counts summed, first and last times kept."""
    ids = ["i_year", "i_code", "i_path"]
    key = identity(F.col("bulletin_year"), F.col("course_code"), F.col("source_page_url"))
    old = registry.select("*", *key).groupBy(*ids).agg(
        F.max_by("dedup_key", F.struct("last_seen_at", "seen_count", "dedup_key")).alias("old_key"), F.greatest(F.lit(1), F.sum("seen_count")).alias("seen_count"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    now = current.select(*key, F.col("dedup_key").alias("new_key")).groupBy(*ids).agg(F.max("new_key").alias("new_key"))
    return old.join(now, ids, "left").select(F.coalesce("new_key", "old_key").alias("dedup_key"), *ids, "seen_count", "first_seen_at", "last_seen_at")


def upsert_registry(registry: DataFrame, seen: DataFrame, at: Column) -> DataFrame:
    """The registry after a crawl: keys seen again count one more, new ones begin."""
    hits = seen.select("dedup_key").distinct().withColumn("hit", F.lit(1))
    rows = registry.join(hits, "dedup_key", "full_outer")
    return rows.select(
        "dedup_key", (F.coalesce("seen_count", F.lit(0)) + F.coalesce("hit", F.lit(0))).alias("seen_count"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(F.col("hit") == 1, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def run_report(rows: DataFrame, problems: dict[str, Column]) -> DataFrame:
    """One row: records, how many have each problem, and the percentage without any, to two places."""
    any_of = F.lit(False)
    for test in problems.values():
        any_of |= F.coalesce(test, F.lit(False))
    share = F.when(F.count(F.lit(1)) > 0, F.round(100.0 * F.count_if(~any_of) / F.count(F.lit(1)), 2)).otherwise(F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n_records"), *(F.count_if(t).alias(n) for n, t in problems.items()), share.alias("success_pct"))


def reachable(links: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Pages (url, depth) reached from the seeds over links (source, target) in at most ``rounds`` steps."""
    seen = frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, rounds + 1):
        step = frontier.join(links, frontier["url"] == links["source"]).select(F.col("target").alias("url")).distinct()
        # Kept, so that no round computes those before it again.
        frontier = materialised(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return seen


def save_registry(registry: DataFrame, path: str) -> None:
    """The registry as JSON lines in the order of keys, and the keys alone as text beside it; files follow each other in order."""
    rows = registry.orderBy("dedup_key")
    rows.write.mode("overwrite").json(f"{path}/registry")
    rows.select("dedup_key").write.mode("overwrite").text(f"{path}/keys")


def snapshot_order(rows: DataFrame) -> DataFrame:
    """Courses of a crawl by code and title, a missing one as an empty one; courses that agree in both by uid, so that reruns agree."""
    return rows.orderBy(F.coalesce("course_code", F.lit("")), F.coalesce("title", F.lit("")), "course_uid")


def snapshot_places(rows: DataFrame) -> DataFrame:
    """All courses (course_uid) of a crawl with their place, from 1, in ``snapshot_order``.

    Courses are sorted over many tasks; a course's place is that in its task's
    part after the courses of all parts before it.
    """
    ordered = materialised(snapshot_order(rows.select("course_uid", "course_code", "title")).select("course_uid", F.monotonically_increasing_id().alias("at")))
    # An id is the number of the part, then that within it in the last 33 bits.
    ordered = ordered.select("course_uid", F.shiftright("at", 33).alias("part"), F.expr("at & ((1L << 33) - 1)").alias("at"))
    parts = ordered.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("course_uid", (F.col("before") + F.col("at") + 1).cast("int").alias("place"))


def pass_counts(results: DataFrame, prefix: Column, passed: Column, seconds: Column) -> DataFrame:
    """Runs of each prefix: how many, how many passed, and their mean time to three places."""
    return results.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"), F.round(F.avg(seconds), 3).alias("seconds"))
