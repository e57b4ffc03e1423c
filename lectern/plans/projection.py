"""A course catalogue made from the star-schema tables, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import dealt

#: The same catalogue in SQL, for checks against another engine.
SQL = """
course AS (
 SELECT sha1(cast(p_partkey AS varchar)) AS course_uid, p_partkey, upper(substr(p_type,1,4)) AS department_prefix,
  upper(substr(p_type,1,4)) || ' ' || CASE p_partkey % 6 WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'UN' WHEN 3 THEN 'GU' WHEN 4 THEN 'GR' ELSE 'B' END
   || cast(1000 + (p_partkey % 360) * 25 AS varchar) AS course_code,
  upper(p_name) || CASE p_partkey % 5 WHEN 0 THEN ' SEMINAR' WHEN 1 THEN ' PROJECTS' ELSE '' END AS title,
  cast(p_size % 5 AS double) AS points_min, cast(p_size % 5 + p_size % 3 AS double) AS points_max,
  1000 + (p_partkey % 360) * 25 AS level, text AS description
 FROM part LEFT JOIN documents ON doc_id = p_partkey),
section AS (
 SELECT sha1(cast(l_partkey AS varchar)) AS course_uid, l_orderkey, l_linenumber, l_suppkey,
  lpad(cast(l_linenumber AS varchar),3,'0') || '/' || lpad(cast(l_orderkey % 100000 AS varchar),5,'0') AS section_id,
  CASE WHEN month(l_shipdate) <= 5 THEN 'Spring ' WHEN month(l_shipdate) <= 8 THEN 'Summer ' ELSE 'Fall ' END || cast(year(l_shipdate) AS varchar) AS term,
  CASE l_linenumber WHEN 1 THEN 'M W 10:10am - 11:25am' WHEN 2 THEN 'T Th 1:10pm - 2:25pm' WHEN 3 THEN 'F Sa S 9:00am - 5:00pm'
   WHEN 4 THEN 'W 6:10pm - 8:00pm' WHEN 5 THEN 'TBA' WHEN 6 THEN 'Imelda Quarrie' ELSE '' END AS times,
  CASE l_linenumber WHEN 1 THEN 'Monday,Wednesday' WHEN 2 THEN 'Tuesday,Thursday' WHEN 3 THEN 'Friday,Saturday,Sunday' WHEN 4 THEN 'Wednesday' ELSE '' END AS days,
  CASE l_linenumber WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' WHEN 3 THEN 'morning' WHEN 4 THEN 'evening' ELSE '' END AS tod,
  s_name AS instructor, cast(cast(l_quantity AS int) % 7 AS double) AS points,
  cast(l_quantity AS int) AS current_n, cast(20 + l_suppkey % 30 AS int) AS capacity_n,
  l_linenumber <> 6 AND cast(l_quantity AS int) <= 20 + l_suppkey % 30 AS published
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""
NAMES = {"SMAL": "small", "LARG": "large goods", "MEDI": "medium", "ECON": "economy", "STAN": "standard", "PROM": "promotion"}


def _code(key: Column, dept: Column) -> Column:
    level = F.element_at(F.array(*map(F.lit, ("E", "W", "UN", "GU", "GR", "B"))), (key % 6 + 1).cast("int"))
    return F.concat(dept, F.lit(" "), level, (1000 + (key % 360) * 25).cast("string"))


def courses(spark: SparkSession, d: str) -> DataFrame:
    """Course details without sections."""
    part, docs = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    key, dept = F.col("p_partkey"), F.upper(F.substring("p_type", 1, 4))
    a, b, c = (_code(key + i, dept) for i in (1, 2, 3))
    prereq = F.element_at(F.array(
        F.lit(""), F.lit("No prerequisites."), F.concat_ws(" and ", a, b), F.concat_ws(" or ", a, b),
        F.concat(F.lit("("), a, F.lit(" or "), b, F.lit(") and "), c), F.concat(F.lit("Recommended: "), a, F.lit(" or "), b, F.lit(".")), F.lit("Permission of the instructor."),
    ), (key % 7 + 1).cast("int"))
    return part.join(docs, part["p_partkey"] == docs["doc_id"], "left").select(
        F.sha1(key.cast("string").cast("binary")).alias("course_uid"), "p_partkey", _code(key, dept).alias("course_code"),
        F.concat(F.upper("p_name"), F.when(key % 5 == 0, " SEMINAR").when(key % 5 == 1, " PROJECTS").otherwise("")).alias("title"),
        (F.col("p_size") % 5).cast("double").alias("points_min"), (F.col("p_size") % 5 + F.col("p_size") % 3).cast("double").alias("points_max"),
        F.col("text").alias("description"), prereq.alias("prerequisites_text"), (key % 11 == 0).alias("needs_review"),
        F.lit(None).cast("array<string>").alias("course_review_warnings"),
        F.when(key % 11 == 0, F.array(F.when(key % 2 == 0, "missing_description").otherwise("title_parse_warning"))).otherwise(F.array().cast("array<string>")).alias("parse_warnings"),
    )


def sections(spark: SparkSession, d: str, by_part: bool = False) -> DataFrame:
    """Sections by course_uid, flat; ``by_part``: those of a part in one partition, shuffled as lines before texts are made of them."""
    line, supplier = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    n, quantity, month = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.month("l_shipdate")
    times = F.when(n == 1, "M W 10:10am - 11:25am").when(n == 2, "T Th 1:10pm - 2:25pm").when(n == 3, "F Sa S 9:00am - 5:00pm").when(n == 4, "W 6:10pm - 8:00pm").when(n == 5, "TBA").when(n == 6, "Imelda Quarrie").otherwise("")
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    if by_part:
        rows = dealt(rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "s_name"), "l_partkey")
    return rows.select(
        F.sha1(F.col("l_partkey").cast("string").cast("binary")).alias("course_uid"), *(["l_partkey"] if by_part else []), "l_orderkey", "l_linenumber", "l_suppkey",
        F.concat(F.when(month <= 5, "Spring ").when(month <= 8, "Summer ").otherwise("Fall "), F.year("l_shipdate").cast("string")).alias("term"),
        F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("/"), F.lpad((F.col("l_orderkey") % 100000).cast("string"), 5, "0")).alias("section_call_number"),
        times.alias("times"), F.lit("").alias("location"), F.col("s_name").alias("instructor"), F.concat((quantity % 7).cast("string"), F.lit(".00")).alias("points"),
        F.lit("").alias("enrollment_raw"), quantity.alias("enrollment_current"), (20 + F.col("l_suppkey") % 30).cast("int").alias("enrollment_capacity"),
    )


SECTION_FIELDS = ["term", "section_call_number", "times", "location", "instructor", "points", "enrollment_raw", "enrollment_current", "enrollment_capacity"]


def details(spark: SparkSession, d: str) -> DataFrame:
    """Courses with their nested sections, ordered by line."""
    nested = sections(spark, d, by_part=True).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", *SECTION_FIELDS))).alias("s"))
    nested = nested.select("p_partkey", F.transform("s", lambda s: F.struct(*(s[f].alias(f) for f in SECTION_FIELDS))).alias("sections"))
    return courses(spark, d).join(nested, "p_partkey", "left")
