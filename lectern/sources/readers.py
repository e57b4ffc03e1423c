"""Readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.web import file_name, visible_text
from lectern.schemas import COURSE, REGISTRY


def course_dir(spark: SparkSession, path: str) -> DataFrame:
    """One course per JSON file, with file_name; unreadable files and files without an object are left out."""
    rows = spark.read.schema(f"{COURSE}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return rows.where(F.col("_corrupt_record").isNull() & F.col("course_uid").isNotNull()).drop("_corrupt_record")


def with_integrity(rows: DataFrame) -> DataFrame:
    """Adds ``problem``: a uid of the wrong form, or a file not named after it."""
    wrong = F.when(~F.col("course_uid").rlike("^[0-9a-f]{40}$"), "invalid_uid").when(F.col("file_name") != F.concat("course_uid", F.lit(".json")), "file_name_mismatch")
    return rows.withColumn("problem", wrong)


def quarantined(spark: SparkSession, path: str, schema: str = COURSE, key: str = "course_uid", form: str = "^[0-9a-f]{40}$") -> DataFrame:
    """A row for every JSON file below ``path``: its columns, file_name, the text that couldn't be read, and ``problem``.

    ``problem`` is unreadable (no JSON object of the schema, or not all of it),
    invalid_uid, file_name_mismatch or null. Each file is in one class, so the
    classes add up to the files.
    """
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumns({"file_name": F.col("_metadata.file_name"), "file_path": F.col("_metadata.file_path")})
    unreadable = F.col("_corrupt_record").isNotNull() | F.col(key).isNull()
    wrong = F.when(unreadable, "unreadable").when(~F.col(key).rlike(form), "invalid_uid").when(F.col("file_name") != F.concat(key, F.lit(".json")), "file_name_mismatch")
    return rows.withColumn("problem", wrong)


def split_sinks(rows: DataFrame, path: str) -> DataFrame:
    """Write good, unreadable and mismatched rows of ``quarantined`` to folders of ``path`` in one pass; (sink, rows) of what was written."""
    sink = F.when(F.col("problem").isNull(), "good").when(F.col("problem") == "unreadable", "unreadable").otherwise("mismatched")
    rows.withColumn("sink", sink).write.partitionBy("sink").mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("sink").agg(F.count(F.lit(1)).alias("rows"))


def snapshot_pages(pages: DataFrame, files: DataFrame, run_id: str) -> DataFrame:
    """Course pages of a crawl (source_page_url, is_course_page) with the raw file of each: file, html, sha256 and problem (no_url, no_file, null)."""
    named = F.concat(F.lit(f"{run_id}__"), file_name(F.col("source_page_url")), F.lit(".html"))
    rows = pages.where("is_course_page").withColumn("file", F.when(F.trim("source_page_url") != "", named))
    rows = rows.join(files.select(F.col("name").alias("file"), "html"), "file", "left")
    problem = F.when(F.col("file").isNull(), "no_url").when(F.col("html").isNull(), "no_file")
    return rows.select("source_page_url", "file", "html", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), problem.alias("problem"))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array; anything else gives none."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines registry, the last line of each key, of the last file in name order; malformed lines are skipped."""
    rows = spark.read.schema(REGISTRY).option("mode", "DROPMALFORMED").json(path).where("dedup_key is not null")
    rest = [c for c in rows.columns if c != "dedup_key"]
    rows = rows.withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    return rows.groupBy("dedup_key").agg(F.max_by(F.struct(*rest), "line").alias("r")).select("dedup_key", "r.*")


def pages_with_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Crawled pages (url) with the saved file (name, html) of each."""
    return pages.join(files, file_name(F.col("url")) == F.col("name"), "left")


def text_files(spark: SparkSession, path: str, limit_bytes: int, limit_chars: int) -> DataFrame:
    """Path and visible text of HTML and plain files of at most ``limit_bytes``, at most ``limit_chars`` of each text."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit_bytes)
    raw = F.decode("content", F.lit("UTF-8"))
    html = F.lower("path").rlike(r"\.html?$")
    return rows.select("path", F.substring(F.when(html, visible_text(raw)).otherwise(raw), 1, limit_chars).alias("text"))


def first_of(*candidates: Column) -> Column:
    """The first candidate that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))
