"""Versioned overlays: latest versions, revisions, and the merge of published ones into courses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.operators.repair import digest_sums

VERSION = ["created_at_ns", "revision", "version_id"]


def latest_wins(overlays: DataFrame, key: list[str]) -> DataFrame:
    """The row of the greatest (created_at_ns, revision, version_id) of each key, whatever the input order."""
    rest = [c for c in overlays.columns if c not in key]
    best = overlays.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*VERSION)).alias("best"))
    return best.select(*key, *(F.col(f"best.{c}").alias(c) for c in rest))


def with_revisions(versions: DataFrame, key: list[str]) -> DataFrame:
    """Versions numbered from 1 within their identity, by creation."""
    return versions.withColumn("revision", F.row_number().over(W.partitionBy(*key).orderBy("created_at_ns", "version_id")))


def new_versions(stored: DataFrame | None, versions: DataFrame, key: list[str], version: str = "version_id") -> DataFrame:
    """Versions whose id isn't stored, each once, with revisions that go on from those of their identity, by creation."""
    rows = versions.drop("revision")
    rest = [c for c in rows.columns if c != version]
    rows = rows.groupBy(version).agg(F.min_by(F.struct(*rest), "created_at_ns").alias("r")).select(version, "r.*")
    last = None
    if stored is not None:
        rows = rows.join(stored.select(version), version, "left_anti")
        last = stored.groupBy(*key).agg(F.max("revision").alias("_last"))
        rows = rows.join(last, key, "left")
    place = F.row_number().over(W.partitionBy(*key).orderBy("created_at_ns", version))
    rows = rows.withColumn("revision", place if last is None else place + F.coalesce("_last", F.lit(0)))
    return rows.drop("_last").select(*(stored.columns if stored is not None else [*versions.drop("revision").columns, "revision"]))


def effective(versions: DataFrame, key: list[str], *, published: bool = True) -> DataFrame:
    """What readers see: the last published version of each identity; without ``published`` the last of any status, as administrators do."""
    rest = [c for c in versions.columns if c not in key]
    counts = (F.col("status") == "published") if published else F.lit(True)
    best = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.when(counts, F.struct("revision", "version_id"))).alias("v"))
    return best.where("v is not null").select(*key, *(F.col("v").getField(c).alias(c) for c in rest))


def active_versions(versions: DataFrame, key: list[str]) -> DataFrame:
    """The last published version of each identity."""
    return versions.groupBy(*key).agg(F.max_by("version_id", F.when(F.col("status") == "published", F.col("revision"))).alias("active")).where("active is not null")


def manifest(versions: DataFrame, key: list[str]) -> DataFrame:
    """One row: identities, versions, versions by status, identities with a published version, and a digest of all rows."""
    status = lambda s: F.count_if(F.col("status") == s)
    statuses = ("published", "review", "rejected")
    each = versions.groupBy(*key).agg(F.count(F.lit(1)).alias("versions"), *(status(s).alias(s) for s in statuses), *digest_sums(sorted(versions.columns)))
    return each.agg(
        F.count(F.lit(1)).alias("identities"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("versions", *statuses)),
        F.count_if(F.col("published") > 0).alias("effective"), *(F.sum(c).cast("string").alias(c) for c in ("digest_a", "digest_b")),
    )


def bind(overlays: DataFrame, courses: DataFrame) -> DataFrame:
    """(course_uid, version_id): courses that an overlay names by uid, else all of its course code."""
    named = overlays.select("version_id", F.explode_outer("seed_course_uids").alias("course_uid"))
    by_uid = named.join(courses.select("course_uid"), "course_uid").select("course_uid", "version_id")
    rest = overlays.join(by_uid.select("version_id").distinct(), "version_id", "left_anti")
    by_code = rest.join(courses.select("course_uid", "course_code"), "course_code").select("course_uid", "version_id")
    return by_uid.union(by_code).distinct()


def merge_sections(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """Sections of courses after keyed replace-or-append.

    Both have course_uid, term, section_id and a struct ``section``; overlays
    have VERSION columns too. Terms and ids compare without case.
    """
    key = ["course_uid", F.lower("term").alias("k_term"), F.lower("section_id").alias("k_id")]
    old = base.select(*key, "section", F.lit(False).alias("overlaid"), *(F.lit(None).cast(overlays.schema[c].dataType).alias(c) for c in VERSION))
    new = overlays.select(*key, "section", F.lit(True).alias("overlaid"), *VERSION)
    best = old.union(new).groupBy("course_uid", "k_term", "k_id").agg(F.max_by(F.struct("section", "overlaid"), F.struct("overlaid", *VERSION)).alias("best"))
    return best.select("course_uid", "k_term", "k_id", "best.section", "best.overlaid")


def merge_fields(base: DataFrame, overlays: DataFrame, fields: list[str]) -> DataFrame:
    """Course fields with those an overlay's ``payload`` map has a key for, a present empty value included."""
    best = latest_wins(overlays.select("course_uid", "payload", *VERSION), ["course_uid"])
    rows = base.join(best.select("course_uid", "payload"), "course_uid", "left")
    merged = {f: F.when(F.coalesce(F.map_contains_key("payload", F.lit(f)), F.lit(False)), F.col("payload")[f]).otherwise(F.col(f)) for f in fields}
    return rows.withColumns(merged).drop("payload")


def widen_points(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """points_min and points_max over a course and all its overlays."""
    return base.select("course_uid", "points_min", "points_max").union(overlays.select("course_uid", "points_min", "points_max")).groupBy("course_uid").agg(
        F.min("points_min").alias("points_min"), F.max("points_max").alias("points_max")
    )


def effective_order(rows: DataFrame) -> DataFrame:
    """Effective overlays by code, term and section."""
    return rows.orderBy("course_code", "term", "section_id")


def without_fields(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows without some fields: what a repair must leave as it is."""
    return rows.drop(*fields)
