"""Queries of the catalogue engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import codes, credits, prerequisites, schedule, suitability, text, web
from lectern.operators import analytics, answers, catalog, conversation, crawl, digests, importing, overlays, repair, retrieval
from lectern.plans import intent, language, projection, validation
from lectern.session import dealt
from lectern.sources import indexes
from lectern.streaming import protocol, rate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, catalogue: bool = False):
    """Register a query; ``catalogue`` puts the projected course and section tables before the SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (f"WITH {projection.SQL} {sql}" if catalogue else sql).strip()
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def index(spark: SparkSession, d: str) -> DataFrame:
    """The index, built once from these tables and then read: filters reach its scan."""
    inputs = [f"{d}/{t}.parquet" for t in ("part", "documents", "lineitem", "supplier")]
    return indexes.built(spark, "courses", inputs, lambda: enriched(spark, d), ["department_prefix", "course_uid"])


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The index of these tables; sections are dealt by part once and stay there, grouped and joined with their courses."""
    sections = projection.sections(spark, d, by_part=True).withColumnRenamed("l_partkey", "p_partkey")
    checked = catalog.summaries(sections, "p_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"], projection.sections(spark, d))
    return catalog.enrich(projection.courses(spark, d), projection.NAMES, checked, "p_partkey")


def values(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    """A small table of fixed rows."""
    return spark.createDataFrame(rows, names)


# Projection and index

@query("catalog_projection", "SELECT course_uid, course_code, title, department_prefix, points_min, points_max, level FROM course", True)
def _(spark, d):
    rows = projection.courses(spark, d)
    return rows.select("course_uid", "course_code", "title", codes.department(F.col("course_code")).alias("department_prefix"), "points_min", "points_max", codes.level(F.col("course_code")).alias("level"))


@query("raw_index", "SELECT course_uid, course_code, title, course_uid || '.json' AS file_name, 'courses_flat/' || course_uid || '.json' AS path FROM course", True)
def _(spark, d):
    name = F.concat("course_uid", F.lit(".json"))
    return projection.courses(spark, d).select("course_uid", "course_code", "title", name.alias("file_name"), F.concat(F.lit("courses_flat/"), name).alias("path"))


@query("enriched_index", """
SELECT c.course_uid, min(c.course_code) AS course_code, count(s.course_uid) FILTER (s.published) AS n_published, count(s.course_uid) FILTER (NOT s.published) AS n_review,
 count(DISTINCT s.term) FILTER (s.published) AS n_terms, count(DISTINCT s.instructor) FILTER (s.published) AS n_instructors,
 bool_or(c.description IS NOT NULL AND trim(c.description) <> '') AS has_description
FROM course c LEFT JOIN section s USING (course_uid) GROUP BY c.course_uid""", True)
def _(spark, d):
    n = lambda c: F.size(c).cast("long")
    return index(spark, d).select("course_uid", "course_code", n("sections_summary").alias("n_published"), n("review_sections_summary").alias("n_review"), n("all_terms").alias("n_terms"), n("all_instructors").alias("n_instructors"), "has_description")


@query("ordered_distinct_terms", """
SELECT course_uid, coalesce(string_agg(DISTINCT term, ',' ORDER BY term), '') AS terms FROM section WHERE published GROUP BY course_uid""", True)
def _(spark, d):
    return index(spark, d).where(F.size("all_terms") > 0).select("course_uid", F.array_join(F.sort_array("all_terms"), ",").alias("terms"))


@query("searchable_text", """
SELECT c.course_uid, length(lower(trim(regexp_replace(concat_ws(' ', c.course_code, c.title), '\\s+', ' ', 'g')))) AS head_length,
 count(DISTINCT s.instructor) FILTER (s.published) AS n_names FROM course c LEFT JOIN section s USING (course_uid) GROUP BY ALL""", True)
def _(spark, d):
    rows = index(spark, d)
    head = text.squash(F.concat_ws(" ", "course_code", "title"))
    named = F.size(F.filter("all_instructors", lambda n: F.col("searchable_text").contains(F.lower(n))))
    return rows.where(F.col("searchable_text").startswith(F.lower(head))).select("course_uid", F.length(head).cast("long").alias("head_length"), named.cast("long").alias("n_names"))


@query("section_validation", """
SELECT course_uid, section_id, l_orderkey, l_suppkey, CASE WHEN published THEN 'published' ELSE 'review' END AS status,
 CASE WHEN l_linenumber = 6 THEN 'invalid_times' ELSE '' END AS errors, CASE WHEN current_n > capacity_n THEN 'enrollment_exceeds_capacity' ELSE '' END AS warnings FROM section""", True)
def _(spark, d):
    rows = projection.sections(spark, d)
    return catalog.validated(rows).withColumnRenamed("summary", "s").select("course_uid", F.col("s.section_id").alias("section_id"), "l_orderkey", "l_suppkey", F.col("s.status").alias("status"), F.array_join("s.errors", ",").alias("errors"), F.array_join("s.warnings", ",").alias("warnings"))


@query("validation_error_counts", """
SELECT problem, count(*) AS n FROM (SELECT 'invalid_times' AS problem FROM section WHERE l_linenumber = 6
 UNION ALL SELECT 'enrollment_exceeds_capacity' FROM section WHERE current_n > capacity_n) GROUP BY problem""", True)
def _(spark, d):
    s = F.struct(*projection.SECTION_FIELDS)
    found = projection.sections(spark, d).select(F.explode(F.concat(catalog.section_errors(s), catalog.section_warnings(s))).alias("problem"))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_validation", """
SELECT course_uid, CASE WHEN p_partkey % 11 <> 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'missing_description' ELSE 'title_parse_warning' END AS warnings,
 CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 1 THEN 'review' ELSE 'published' END AS status FROM course""", True)
def _(spark, d):
    warned = catalog.course_warnings(F.col("needs_review"), F.col("course_review_warnings"), F.col("parse_warnings"))
    return projection.courses(spark, d).withColumn("w", warned).select("course_uid", F.array_join("w", ",").alias("warnings"), catalog.course_status(F.col("w")).alias("status"))


@query("build_summary", """
SELECT (SELECT count(*) FROM course) AS n_courses, (SELECT count(DISTINCT department_prefix) FROM course) AS n_departments,
 (SELECT count(*) FROM course WHERE description IS NOT NULL AND trim(description) <> '') AS n_described,
 (SELECT count(DISTINCT term) FROM section WHERE published) AS n_terms""", True)
def _(spark, d):
    return catalog.build_summary(index(spark, d))


# Filters

VISIBLE = "NOT (p_partkey % 11 = 0 AND p_partkey % 2 = 1)"
SLICE = retrieval.Filters(department="SMAL", term="Spring 1998", days=("Monday", "Wednesday"), points_min=2, points_max=4)


@query("stage1_filter", f"""
SELECT c.course_uid, min(c.course_code) AS course_code, count(*) AS n_matched FROM course c JOIN section s USING (course_uid)
WHERE {VISIBLE} AND department_prefix = 'SMAL' AND published AND term = 'Spring 1998' AND l_linenumber = 1 AND points BETWEEN 2 AND 4 GROUP BY c.course_uid""", True)
def stage1_filter(spark, d):
    rows = retrieval.stage1(index(spark, d).where("department_prefix = 'SMAL'"), SLICE)
    return rows.select("course_uid", "course_code", F.size("matched_sections").cast("long").alias("n_matched"))


@query("same_section_exists", f"""
SELECT DISTINCT c.course_uid FROM course c JOIN section s USING (course_uid) WHERE {VISIBLE} AND published AND days LIKE '%Wednesday%' AND tod = 'evening' AND instructor LIKE '%1%'""", True)
def _(spark, d):
    return retrieval.stage1(index(spark, d), retrieval.Filters(days=("Wednesday",), time_of_day="evening", instructor="1")).select("course_uid")


@query("matched_sections", f"""
SELECT c.course_uid, s.section_id, s.term FROM course c JOIN section s USING (course_uid) WHERE {VISIBLE} AND published AND tod = 'afternoon' AND term = 'Fall 1996'""", True)
def _(spark, d):
    rows = retrieval.stage1(index(spark, d), retrieval.Filters(time_of_day="afternoon", term="fall 1996"))
    return rows.select("course_uid", F.explode("matched_sections").alias("s")).select("course_uid", "s.section_id", "s.term")


@query("points_overlap", "SELECT course_uid FROM course WHERE NOT (points_max < 3 OR points_min > 4)", True)
def _(spark, d):
    return projection.courses(spark, d).where(credits.ranges_overlap(F.col("points_min"), F.col("points_max"), 3, 4)).select("course_uid")


@query("points_two_level", f"""
SELECT c.course_uid, count(s.course_uid) AS n_matched FROM course c LEFT JOIN section s ON c.course_uid = s.course_uid AND published AND points = 5
WHERE {VISIBLE} AND (s.course_uid IS NOT NULL OR (NOT EXISTS (SELECT 1 FROM section x WHERE x.course_uid = c.course_uid AND x.published) AND points_min <= 5 AND points_max >= 5)) GROUP BY c.course_uid""", True)
def _(spark, d):
    rows = retrieval.stage1(index(spark, d), retrieval.Filters(points_min=5, points_max=5))
    return rows.select("course_uid", F.coalesce(F.size("matched_sections"), F.lit(0)).cast("long").alias("n_matched"))


@query("instructor_match", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '00001') AND contains(lower(s_name), 'supplier')")
def _(spark, d):
    return read(spark, d, "supplier").where(retrieval.instructor_matches(F.col("s_name"), "00001 supplier")).select("s_suppkey")


@query("day_superset", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM section WHERE days LIKE '%Saturday%' AND days LIKE '%Friday%' GROUP BY ALL", True)
def _(spark, d):
    rows = projection.sections(spark, d)
    wanted = F.array(F.lit("Friday"), F.lit("Saturday"))
    return rows.where(F.size(F.array_except(wanted, schedule.meeting_days(F.col("times")))) == 0).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("time_bucket", "SELECT tod, days, count(*) AS n FROM section GROUP BY ALL", True)
def _(spark, d):
    rows = projection.sections(spark, d)
    return rows.groupBy(schedule.time_of_day(F.col("times")).alias("tod"), F.array_join(schedule.meeting_days(F.col("times")), ",").alias("days")).agg(F.count(F.lit(1)).alias("n"))


# Ranking

QUALITY = """quality AS (
 SELECT c.*, s.n, CASE WHEN c.description IS NOT NULL AND trim(c.description) <> '' THEN 30 ELSE 0 END + CASE WHEN coalesce(s.n, 0) > 0 THEN 25 ELSE 0 END
  + CASE WHEN coalesce(s.timed, 0) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(s.n, 0) > 0 THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(lower(title), '\\b(tutorial|seminar|projects?|topics?|research|readings?|thesis)\\b') THEN -45 ELSE 0 END
  + CASE WHEN level < 6000 THEN 20 WHEN level >= 9000 THEN -30 ELSE -10 END AS quality
 FROM course c LEFT JOIN (SELECT course_uid, count(*) AS n, count(*) FILTER (times <> '') AS timed FROM section WHERE published GROUP BY 1) s USING (course_uid))"""


@query("quality_score", f", {QUALITY} SELECT course_uid, quality FROM quality", True)
def _(spark, d):
    return index(spark, d).select("course_uid", retrieval.quality().alias("quality"))


@query("quality_topk", f", {QUALITY} SELECT course_uid, quality FROM quality WHERE {VISIBLE} ORDER BY quality DESC, level, course_code, course_uid LIMIT 20", True)
def _(spark, d):
    return retrieval.quality_sort(index(spark, d), 20).select("course_uid", "quality")


def scored(word: str) -> str:
    """SQL: what a word adds to a course's score; besides code and title the text holds the department's name and the beginning of the description."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in projection.NAMES.items())
    told = f"lower(course_code || ' ' || title || ' ' || CASE department_prefix {names} ELSE '' END || ' ' || substr(trim(coalesce(description, '')), 1, 200))"
    return f"CASE WHEN contains(lower(course_code), '{word}') THEN 5 ELSE 0 END + CASE WHEN contains(lower(title), '{word}') THEN 3 ELSE 0 END + contains({told}, '{word}')::int"


@query("keyword_topk", f""", {QUALITY}, scored AS (SELECT *, {scored('smal')} + {scored('seminar')} + {scored('tion')} AS score FROM quality WHERE {VISIBLE})
SELECT course_uid, score, quality FROM scored WHERE score >= 3 ORDER BY score DESC, quality DESC, level, course_code, title, course_uid LIMIT 15""", True)
def _(spark, d):
    return retrieval.keyword_topk(index(spark, d), ["smal", "seminar", "tion"], 15, 3).select("course_uid", F.col("score").cast("int").alias("score"), "quality")


@query("keyword_topk_docs", """
SELECT doc_id, score FROM (SELECT doc_id, contains(lower(text), 'the')::int + contains(lower(text), 'tion')::int + contains(lower(text), 'license')::int AS score FROM documents) WHERE score >= 1 ORDER BY score DESC, doc_id LIMIT 50""")
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.lit("").alias("course_code"), F.lit("").alias("title"), F.col("text").alias("searchable_text"))
    return rows.select("doc_id", retrieval.keyword_score(["the", "tion", "license"]).cast("int").alias("score")).where("score >= 1").orderBy(F.desc("score"), "doc_id").limit(50)


@query("distinct_code_first", """
SELECT course_uid, row_number() OVER (ORDER BY (nth > 1)::int, level, course_uid)::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY course_code ORDER BY level, course_uid) AS nth FROM course)
QUALIFY place <= 700 ORDER BY place""", True)
def _(spark, d):
    rows = projection.courses(spark, d).withColumn("level", codes.level(F.col("course_code")))
    return retrieval.distinct_code_first(rows, ["level", "course_uid"], 700).select("course_uid", "place")


@query("result_metadata", "SELECT course_uid, (SELECT count(*) FROM course) AS total, least((SELECT count(*) FROM course), 5) AS displayed, (SELECT count(*) FROM course) > 5 AS truncated FROM course ORDER BY course_code, course_uid LIMIT 5", True)
def _(spark, d):
    return retrieval.with_metadata(projection.courses(spark, d).select("course_uid", "course_code"), ["course_code", "course_uid"], 5).drop("course_code")


@query("index_build", "SELECT department_prefix, count(*) AS n, sum(CASE WHEN description IS NOT NULL AND trim(description) <> '' THEN 1 ELSE 0 END)::bigint AS described FROM course GROUP BY 1", True)
def _(spark, d):
    return index(spark, d).groupBy("department_prefix").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_description").alias("described"))


@query("retrieve_details", f""", {QUALITY} SELECT q.course_uid, row_number() OVER (ORDER BY score DESC, quality DESC, level, course_code, title, q.course_uid)::int AS place, score::int AS score FROM (
 SELECT *, CASE WHEN contains(lower(title), 'seminar') THEN 4 ELSE 0 END AS score FROM quality WHERE {VISIBLE} AND department_prefix = 'SMAL' AND p_partkey % 10 <> 0 AND points_min <= 2 AND points_max >= 1) q
 WHERE EXISTS (SELECT 1 FROM section s WHERE s.course_uid = q.course_uid AND published AND tod = 'morning') QUALIFY place <= 8""", True)
def _(spark, d):
    # Every tenth course has no details; details say that points are those of the catalogue, whatever sections say.
    details = projection.courses(spark, d).where("p_partkey % 10 <> 0").select("course_uid", "points_min", "points_max")
    rows = index(spark, d).withColumn("sections_summary", F.transform("sections_summary", lambda s: s.withField("points", F.lit(""))))
    wanted = retrieval.Filters(department="SMAL", time_of_day="morning", points_min=1, points_max=2, keywords=("seminar",))
    return retrieval.retrieve(rows, details, wanted, 8).select("course_uid", "place", "score")


@query("no_anchor_guard", "SELECT course_uid FROM course WHERE false", True)
def _(spark, d):
    details = projection.courses(spark, d).select("course_uid")
    return retrieval.retrieve(index(spark, d), details, retrieval.Filters(keywords=(" ",))).select("course_uid")


@query("ordinal_lookup", """SELECT a.o_custkey AS conv, a.n AS nth, b.o_orderkey AS uid FROM (SELECT DISTINCT o_custkey, unnest([3, 1, 9]) AS k, unnest([1, 2, 3]) AS n FROM orders) a
 JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders) b ON a.o_custkey = b.o_custkey AND a.k = b.position""")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("conv"), F.col("o_orderkey").alias("uid"))
    results = o.withColumn("position", F.row_number().over(W.partitionBy("conv").orderBy("uid")))
    asked = o.select("conv").distinct().select("conv", F.posexplode(conversation.ordinals(F.lit("compare the third one with the first, then the 9th"))).alias("nth", "ordinal"))
    return retrieval.at_positions(results, asked.withColumn("nth", F.col("nth") + 1), "conv").select("conv", "nth", "uid")


@query("counted_reference", "SELECT o_custkey AS conv, o_orderkey AS uid FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 2 + o_custkey % 9)")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("conv"), F.col("o_orderkey").cast("string").alias("uid"), (2 + F.col("o_custkey") % 9).alias("wanted"))
    return retrieval.counted_reference(o, "conv", "uid", "wanted").select("conv", F.col("uid").cast("long").alias("uid"))


@query("winner_codes", f"SELECT course_code, p_partkey AS position FROM course WHERE {{LEAST}} = (SELECT max({{LEAST}}) FROM course)".replace("{LEAST}", "CASE p_partkey % 7 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 0 END"), True)
def _(spark, d):
    rows = parsed_courses(spark, d).select("course_uid", "course_code", F.col("p_partkey").alias("position"), F.col("p.min_count").alias("n"))
    return retrieval.codes_of_winners(rows, retrieval.extreme_with_ties(rows, "n", least=False)).select("course_code", "position")


@query("extreme_unknown", "SELECT course_uid FROM course WHERE p_partkey % 7 IN (0, 6)", True)
def _(spark, d):
    return retrieval.unknown_rows(parsed_courses(spark, d).select("course_uid", F.col("p.min_count").alias("n")), "n").select("course_uid")


@query("ambiguous_recommendation", "SELECT p_partkey, p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 4 <> 1 AS ambiguous FROM part")
def _(spark, d):
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    i = F.struct(
        F.when(F.col("p_size") % 2 == 0, "Recommend").otherwise("search").alias("query_type"), F.when(key % 3 == 0, "COMS").alias("department"), none.alias("course_codes"),
        F.when(key % 4 == 0, none).when(key % 4 == 1, F.array(F.lit("more"), F.col("p_name"))).otherwise(F.array(F.lit(" More"), F.lit("else"))).alias("keywords"))
    return read(spark, d, "part").select("p_partkey", retrieval.ambiguous_recommendation(i).alias("ambiguous"))


# Statistics

@query("dept_stats", "SELECT department_prefix AS name, count(*) AS n FROM course GROUP BY 1 ORDER BY n DESC, name LIMIT 20", True)
def _(spark, d):
    return analytics.counts_by(projection.courses(spark, d), codes.department(F.col("course_code")))


@query("catalog_stats", "SELECT count(DISTINCT c.department_prefix) AS n_departments, count(DISTINCT s.term) AS n_terms, count(DISTINCT c.course_uid) AS n_courses FROM course c LEFT JOIN section s USING (course_uid)", True)
def _(spark, d):
    rows = projection.courses(spark, d).agg(F.countDistinct(codes.department(F.col("course_code"))).alias("n_departments"), F.count(F.lit(1)).alias("n_courses"))
    return rows.join(projection.sections(spark, d).agg(F.countDistinct("term").alias("n_terms")))


@query("dup_code_histogram", "SELECT copies, count(*) AS n_keys FROM (SELECT course_code, count(*) AS copies FROM course GROUP BY 1 HAVING count(*) > 1) GROUP BY 1", True)
def _(spark, d):
    return repair.duplicate_histogram(projection.courses(spark, d), F.col("course_code"))


# Prerequisites and suitability

STATUS = "CASE p_partkey % 7 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'EXPLICIT_NONE' ELSE 'LISTED' END"
LEAST = "CASE p_partkey % 7 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 0 END"


def parsed_courses(spark, d):
    return projection.courses(spark, d).withColumn("p", prerequisites.parse_prerequisites(F.col("prerequisites_text")))


@query("prereq_status", f"""
SELECT {STATUS} AS status, CASE p_partkey % 7 WHEN 2 THEN 'AND' WHEN 3 THEN 'OR' WHEN 4 THEN 'MIXED' WHEN 5 THEN 'OR' ELSE 'UNKNOWN' END AS relationship,
 p_partkey % 7 = 5 AS recommended_only, count(*) AS n FROM course GROUP BY ALL""", True)
def _(spark, d):
    return parsed_courses(spark, d).groupBy(F.col("p.status").alias("status"), F.col("p.relationship").alias("relationship"), F.col("p.recommended_only").alias("recommended_only")).agg(F.count(F.lit(1)).alias("n"))


@query("prereq_min_count", f"SELECT course_uid, cast({LEAST} AS int) AS min_count FROM course", True)
def _(spark, d):
    return parsed_courses(spark, d).select("course_uid", F.col("p.min_count").alias("min_count"))


@query("argmin_prereq_ties", f"SELECT course_uid FROM course WHERE {LEAST} = (SELECT min({LEAST}) FROM course)", True)
def _(spark, d):
    return retrieval.extreme_with_ties(parsed_courses(spark, d).select("course_uid", F.col("p.min_count").alias("n")), "n").select("course_uid")


@query("argmax_prereq_ties", f"SELECT course_uid FROM course WHERE {LEAST} = (SELECT max({LEAST}) FROM course)", True)
def _(spark, d):
    return retrieval.extreme_with_ties(parsed_courses(spark, d).select("course_uid", F.col("p.min_count").alias("n")), "n", least=False).select("course_uid")


@query("beginner_suitability", f"""
SELECT course_uid, CASE WHEN {STATUS} = 'EXPLICIT_NONE' THEN 'positive' WHEN {STATUS} = 'LISTED' THEN 'negative' WHEN level >= 3000 THEN 'negative' ELSE 'unknown' END AS status FROM course""", True)
def _(spark, d):
    s = suitability.beginner_suitability(F.col("course_code"), F.col("title"), F.col("description"), F.col("p"), F.col("prerequisites_text"))
    return parsed_courses(spark, d).select("course_uid", s["status"].alias("status"))


# Scalar functions

def _next_code(n: int) -> str:
    """SQL of the code ``n`` parts further on."""
    return (f"department_prefix || ' ' || CASE (p_partkey + {n}) % 6 WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'UN' WHEN 3 THEN 'GU' WHEN 4 THEN 'GR' ELSE 'B' END"
            f" || cast(1000 + ((p_partkey + {n}) % 360) * 25 AS varchar)")


@query("code_extract", f"""SELECT course_uid, CASE WHEN p_partkey % 7 IN (2, 3, 5) THEN {_next_code(1)} || ',' || {_next_code(2)}
 WHEN p_partkey % 7 = 4 THEN {_next_code(1)} || ',' || {_next_code(2)} || ',' || {_next_code(3)} ELSE '' END AS codes FROM course""", True)
def _(spark, d):
    return projection.courses(spark, d).select("course_uid", F.array_join(codes.extract_codes(F.col("prerequisites_text")), ",").alias("codes"))


@query("code_normalize", "SELECT course_uid, course_code AS normal FROM course", True)
def _(spark, d):
    loose = F.lower(F.replace(F.col("course_code"), F.lit(" "), F.lit("_")))
    return projection.courses(spark, d).select("course_uid", codes.normalize_code(loose).alias("normal"))


@query("code_level", "SELECT level, count(*) AS n FROM course GROUP BY 1", True)
def _(spark, d):
    return projection.courses(spark, d).groupBy(codes.level(F.col("course_code")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


#: Phrases about credits, N a whole number of the table, with the bounds that each means.
CREDIT_PHRASES = [
    ("N.5 credits", "N + 0.5", "N + 0.5"), ("N-8 credits", "N", "8"), ("between N and 8 credits", "N", "8"), ("at least N credits", "N", "NULL"), ("at most N credits", "NULL", "N"),
    ("N credits or more", "N", "NULL"), ("N,5 créditos", "N + 0.5", "N + 0.5"), ("N到8学分", "N", "8"), ("至少N学分", "N", "NULL"), ("entre N et 8 crédits", "N", "8"),
    ("au plus N crédits", "NULL", "N"), ("no number here", "NULL", "NULL"),
]


def nth(choices: list[str], key: F.Column) -> F.Column:
    """One of ``choices`` by a number of the table."""
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def by_number(key: str, results: list[str]) -> str:
    """SQL: the result of the choice that ``nth`` makes."""
    return f"CASE {key} % {len(results)} " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(results)) + " END"


@query("credit_parse", f"""SELECT p_partkey, CAST({by_number('p_partkey', [lo.replace('N ', 'n ') if lo != 'N' else 'n' for _, lo, _ in CREDIT_PHRASES])} AS DOUBLE) AS lo,
 CAST({by_number('p_partkey', [hi.replace('N ', 'n ') if hi != 'N' else 'n' for _, _, hi in CREDIT_PHRASES])} AS DOUBLE) AS hi FROM (SELECT p_partkey, p_size % 6 + 1 AS n FROM part)""")
def _(spark, d):
    phrase = F.replace(nth([p for p, _, _ in CREDIT_PHRASES], F.col("p_partkey")), F.lit("N"), (F.col("p_size") % 6 + 1).cast("string"))
    c = credits.credit_constraint(phrase)
    return read(spark, d, "part").select("p_partkey", c["min"].alias("lo"), c["max"].alias("hi"))


@query("points_parse", "SELECT points AS lo, points AS hi, count(*) AS n FROM section GROUP BY ALL", True)
def _(spark, d):
    v = credits.points_value(F.col("points"))
    return projection.sections(spark, d).groupBy(v["lo"].alias("lo"), v["hi"].alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("enrollment_parse", "SELECT current_n AS current, capacity_n AS capacity, count(*) AS n FROM section GROUP BY ALL", True)
def _(spark, d):
    cell = F.concat_ws(" / ", F.col("enrollment_current").cast("string"), F.col("enrollment_capacity").cast("string"))
    v = credits.enrollment_value(cell)
    return projection.sections(spark, d).groupBy(v["current"].alias("current"), v["capacity"].alias("capacity")).agg(F.count(F.lit(1)).alias("n"))


@query("accent_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.lower(text.unaccent(F.col("text"))).cast("binary")).alias("folded"))


@query("whitespace_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s ]+', ' ', 'g'))) AS squashed FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.squash(F.col("text")).cast("binary")).alias("squashed"))


@query("clip_text", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 63) || chr(10) || '...' || chr(10) || right(text, 32) END AS clipped FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 100).alias("clipped"))


@query("markdown_escape", "SELECT doc_id, md5(regexp_replace(text, '([\\\\`*_{}\\[\\]()#+!|<>-])', '\\\\\\1', 'g')) AS escaped FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.escape_markdown(F.col("text")).cast("binary")).alias("escaped"))


@query("html_visible_text", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav\\s*>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', ' ', 'g'), '(?is)<header\\b[^>]*>.*?</header\\s*>', ' ', 'g'),
 '(?s)<[^>]+>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\\s ]+', ' ', 'g'))) AS visible FROM pages""")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(web.visible_text(F.col("html")).cast("binary")).alias("visible"))


@query("page_links", """SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1), ' ') AS links FROM pages""")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(web.links(F.col("html")), " ").alias("links"))


@query("url_canonical", """SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z]+)://([^/]+)', '') AS path FROM pages""")
def _(spark, d):
    c = web.canonical_url(F.regexp_replace("url", r"[?#].*$", ""))
    path = F.regexp_extract(c, r"^[a-zA-Z]+://[^/]+(.*)/$", 1)
    given = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]+", "")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(c, r"^[a-zA-Z]+://([^/]+)", 1).alias("host"), F.when(given.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path).alias("path"))


@query("link_scope", "SELECT regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages WHERE url LIKE '%://%/%' AND NOT regexp_matches(url, '(?i)\\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|svg)(/*)$') GROUP BY 1")
def _(spark, d):
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)
    rows = read(spark, d, "pages").withColumn("host", host)
    return rows.where(web.in_scope(F.col("url"), F.lower("host"))).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT event_id, coalesce(json_valid(props), false) AS ok FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", text.embedded_json(F.col("props")).isNotNull().alias("ok"))


@query("identity_key", "SELECT l_orderkey, l_linenumber, l_suppkey, sha256(concat_ws(chr(31), course_uid, term, section_id)) AS key FROM section", True)
def _(spark, d):
    return projection.sections(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", schedule.identity_key(F.col("course_uid"), F.col("term"), F.col("section_call_number")).alias("key"))


@query("content_hash", "SELECT doc_id, sha1('2025|' || upper(lang) || '|' || upper(source) || '|/x') AS key FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", web.dedup_key(F.lit("2025"), F.col("lang"), F.col("source"), F.lit("https://h/x")).alias("key"))


# Overlays and versions; orders are the log of overlay versions

LOG = """log AS (SELECT o_custkey % 500 AS uid, o_orderkey AS version_id, cast(epoch_us(o_orderdate) AS bigint) AS created_at_ns, o_totalprice AS price,
 CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review' ELSE 'rejected' END AS status FROM orders)"""


def version_log(spark, d):
    rows = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "review").otherwise("rejected")
    return rows.select((F.col("o_custkey") % 500).alias("uid"), F.col("o_orderkey").alias("version_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at_ns"), F.col("o_totalprice").alias("price"), status.alias("status"))


@query("overlay_latest_wins", f"WITH {LOG} SELECT uid, version_id, price FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY created_at_ns DESC, version_id DESC) AS rn FROM log WHERE status = 'published') WHERE rn = 1")
def _(spark, d):
    rows = version_log(spark, d).where("status = 'published'").withColumn("revision", F.lit(1))
    return overlays.latest_wins(rows, ["uid"]).select("uid", "version_id", "price")


@query("version_revision", f"WITH {LOG} SELECT uid, version_id, row_number() OVER (PARTITION BY uid ORDER BY created_at_ns, version_id)::int AS revision FROM log")
def _(spark, d):
    return overlays.with_revisions(version_log(spark, d), ["uid"]).select("uid", "version_id", "revision")


@query("active_version", f"WITH {LOG} SELECT uid, arg_max(version_id, (created_at_ns, version_id)) AS active FROM log WHERE status = 'published' GROUP BY uid")
def _(spark, d):
    return overlays.active_versions(overlays.with_revisions(version_log(spark, d), ["uid"]), ["uid"])


@query("store_manifest", f"""WITH {LOG}, hashed AS (SELECT *, sha256(concat_ws('|', created_at_ns, status, uid, version_id)) AS h FROM log)
SELECT count(DISTINCT uid) AS identities, count(*) AS versions, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected,
 count(DISTINCT uid) FILTER (status = 'published') AS effective, sum(('0x' || substr(h, 1, 15))::bigint)::varchar AS digest_a, sum(('0x' || substr(h, 16, 15))::bigint)::varchar AS digest_b FROM hashed""")
def _(spark, d):
    return overlays.manifest(version_log(spark, d).drop("price"), ["uid"])


@query("version_append", f"""WITH {LOG}, stored AS (SELECT uid, version_id, row_number() OVER (PARTITION BY uid ORDER BY created_at_ns, version_id) AS revision FROM log WHERE version_id % 3 = 0),
last AS (SELECT uid, max(revision) AS n FROM stored GROUP BY uid)
SELECT l.uid, version_id, (coalesce(n, 0) + row_number() OVER (PARTITION BY l.uid ORDER BY created_at_ns, version_id))::int AS revision FROM log l LEFT JOIN last ON last.uid = l.uid WHERE version_id % 2 = 0 AND version_id % 3 <> 0""")
def _(spark, d):
    log = version_log(spark, d)
    stored = overlays.with_revisions(log.where("version_id % 3 = 0"), ["uid"])
    # Each version comes twice.
    fresh = log.where("version_id % 2 = 0")
    return overlays.new_versions(stored, fresh.union(fresh), ["uid"]).select("uid", "version_id", "revision")


@query("effective_snapshot", f"""WITH {LOG}, seen AS (SELECT uid, arg_max(version_id, (created_at_ns, version_id)) AS last, arg_max(version_id, (created_at_ns, version_id)) FILTER (status = 'published') AS active FROM log GROUP BY uid)
SELECT uid, last, active FROM seen""")
def _(spark, d):
    log = overlays.with_revisions(version_log(spark, d), ["uid"])
    seen = overlays.effective(log, ["uid"]).select("uid", F.col("version_id").alias("active"))
    return overlays.effective(log, ["uid"], published=False).select("uid", F.col("version_id").alias("last")).join(seen, "uid", "left")


@query("digest_levels", """WITH leaves AS (SELECT c_nationkey::varchar AS a, c_mktsegment AS b, c_custkey::varchar AS c, sha256(c_custkey || '|' || c_name || '|' || c_nationkey) AS digest FROM customer),
b AS (SELECT a, b, count(*) AS children, sum(('0x' || substr(h, 1, 15))::bigint)::varchar AS x, sum(('0x' || substr(h, 16, 15))::bigint)::varchar AS y FROM (SELECT *, sha256(c || ':' || digest) AS h FROM leaves) GROUP BY ALL),
bd AS (SELECT a, b, children, sha256(children || '|' || x || '|' || y) AS digest FROM b),
a AS (SELECT a, count(*) AS children, sum(('0x' || substr(h, 1, 15))::bigint)::varchar AS x, sum(('0x' || substr(h, 16, 15))::bigint)::varchar AS y FROM (SELECT *, sha256(b || ':' || digest) AS h FROM bd) GROUP BY ALL),
ad AS (SELECT a, children, sha256(children || '|' || x || '|' || y) AS digest FROM a),
r AS (SELECT count(*) AS children, sum(('0x' || substr(h, 1, 15))::bigint)::varchar AS x, sum(('0x' || substr(h, 16, 15))::bigint)::varchar AS y FROM (SELECT sha256(a || ':' || digest) AS h FROM ad))
SELECT a || '/' || b || '/' || c AS path, 0 AS children, digest FROM leaves UNION ALL SELECT a || '/' || b, children, digest FROM bd UNION ALL SELECT a, children, digest FROM ad
UNION ALL SELECT '', children, sha256(children || '|' || x || '|' || y) FROM r""")
def _(spark, d):
    path = F.array(F.col("c_nationkey").cast("string"), "c_mktsegment", F.col("c_custkey").cast("string"))
    leaves = read(spark, d, "customer").select(path.alias("path"), digests.row_digest(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("digest"))
    return digests.tree(leaves, 3).select(F.array_join("path", "/").alias("path"), "children", "digest")


@query("points_widen", """SELECT c.course_uid, least(min(c.points_min), min(cast(l_quantity AS int) % 7)) AS points_min, greatest(max(c.points_max), max(cast(l_quantity AS int) % 7)) AS points_max
FROM course c LEFT JOIN lineitem l ON l.l_partkey = c.p_partkey GROUP BY 1""", True)
def _(spark, d):
    points = credits.points_value(F.col("points"))
    more = projection.sections(spark, d).select("course_uid", points["lo"].alias("points_min"), points["hi"].alias("points_max"))
    return overlays.widen_points(projection.courses(spark, d), more)


@query("overlay_merge", """SELECT course_uid, count(DISTINCT (lower(term), section_id)) AS n_sections, count(DISTINCT (lower(term), section_id)) FILTER (l_linenumber <= 2) AS n_overlaid FROM section GROUP BY 1""", True)
def _(spark, d):
    rows = projection.sections(spark, d).withColumn("section_id", F.col("section_call_number")).withColumn("section", F.struct("term", "section_id", "times"))
    new = rows.where("l_linenumber <= 2").withColumns({"created_at_ns": F.col("l_orderkey"), "revision": F.lit(1), "version_id": F.col("l_suppkey")})
    merged = overlays.merge_sections(rows, new)
    return merged.groupBy("course_uid").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if("overlaid").alias("n_overlaid"))


# Imports

@query("import_quality_score", """SELECT course_uid, greatest(0, 100 - CASE WHEN length(trim(title)) < 3 THEN 30 WHEN length(trim(title)) < 8 THEN 10 ELSE 0 END - CASE WHEN points_min <= 0 THEN 15 ELSE 0 END
 - CASE WHEN trim(coalesce(description, '')) = '' THEN 10 ELSE 0 END - CASE WHEN department_prefix IN ('SMAL', 'LARG') THEN 0 ELSE 20 END) AS score FROM course""", True)
def _(spark, d):
    found = importing.import_issues(F.col("course_code"), F.col("title"), F.col("description"), F.lit(""), F.col("points_min"), ["SMAL", "LARG"])
    return projection.courses(spark, d).select("course_uid", found["score"].alias("score"))


@query("import_gate", """SELECT CASE WHEN length(trim(title)) < 3 THEN 'rejected' WHEN points_min <= 0 OR trim(coalesce(description, '')) = '' OR length(trim(title)) < 8 OR department_prefix NOT IN ('SMAL', 'LARG') THEN 'review' ELSE 'published' END AS status, count(*) AS n FROM course GROUP BY 1""", True)
def _(spark, d):
    found = importing.import_issues(F.col("course_code"), F.col("title"), F.col("description"), F.lit(""), F.col("points_min"), ["SMAL", "LARG"])
    errors = importing.hard_errors(F.col("course_code"), F.col("title"), F.lit(""), F.col("points_min"), F.col("points_max"))
    return projection.courses(spark, d).groupBy(importing.gate(errors, found["score"], found["issues"]).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("evidence_asof_pairs", """SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY
WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY a.event_id""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return importing.following_pairs(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", F.expr("interval 2 days")).select("event_id", "right_id")


@query("evidence_nearest", """SELECT a.event_id, arg_min(b.event_id, (abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id)) AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 2 DAY AND b.ts <= a.ts + INTERVAL 2 DAY
WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY a.event_id""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return importing.nearest_pairs(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", F.expr("interval 2 days")).select("event_id", "right_id")


# Crawl and repair

@query("merge_duplicates", """SELECT md5(lower(trim(text))) AS k, count(*) AS records, count(DISTINCT source) AS n_warnings, arg_max(doc_id, (length(trim(regexp_replace(text || chr(1) || doc_id, '[\\s\xa0]+', ' ', 'g'))), -doc_id)) AS best FROM documents GROUP BY 1""")
def _(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.md5(F.lower(F.trim("text")).cast("binary")).alias("k"), "doc_id", F.concat_ws("\u0001", F.col("text"), F.col("doc_id").cast("string")).alias("described"), "text", "source")
    rows = rows.select("k", "doc_id", F.col("described").alias("description"), F.lit("").alias("prerequisites_text"), F.lit("none").alias("prerequisites_source"), F.lit("").alias("notes_text"), F.lit(None).cast("array<string>").alias("sections"), F.array("source").alias("parse_warnings"))
    merged = crawl.merge_records(rows, "k", "doc_id")
    best = F.regexp_extract("description", "\u0001(\\d+)$", 1).cast("long")
    return merged.select("k", "records", F.size("parse_warnings").cast("long").alias("n_warnings"), best.alias("best"))


@query("registry_compaction", """SELECT user_id::varchar AS i_code, CASE WHEN user_id % 2 = 0 THEN user_id || '-new' ELSE arg_max(user_id || '-' || event_type, (last_at, n, user_id || '-' || event_type)) END AS dedup_key,
 sum(n)::bigint AS seen_count, min(first_at) AS first_seen_at, max(last_at) AS last_seen_at FROM
 (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY 1, 2) GROUP BY user_id""")
def _(spark, d):
    rows = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("seen_count"), F.min("event_id").alias("first_seen_at"), F.max("event_id").alias("last_seen_at"))
    named = [F.lit("2025").alias("bulletin_year"), F.col("user_id").cast("string").alias("course_code"), F.lit("https://h/a/").alias("source_page_url")]
    registry = rows.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("dedup_key"), *named, "seen_count", "first_seen_at", "last_seen_at")
    current = rows.where("user_id % 2 = 0").select("user_id").distinct().select(F.concat(F.col("user_id").cast("string"), F.lit("-new")).alias("dedup_key"), *named)
    return crawl.compact_registry(registry, current).select("i_code", "dedup_key", "seen_count", "first_seen_at", "last_seen_at")


@query("registry_upsert", """SELECT user_id::varchar AS dedup_key, (bool_or(event_id % 2 = 0)::int + bool_or(event_id % 2 = 1)::int)::bigint AS seen_count FROM events GROUP BY 1""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("dedup_key", F.col("user_id").cast("string"))
    old = e.where("event_id % 2 = 0").select("dedup_key").distinct().select("dedup_key", F.lit(1).cast("long").alias("seen_count"), F.lit("a").alias("first_seen_at"), F.lit("a").alias("last_seen_at"))
    return crawl.upsert_registry(old, e.where("event_id % 2 = 1"), F.lit("b")).select("dedup_key", F.col("seen_count").cast("long").alias("seen_count"))


@query("run_report", """SELECT count(*) AS n_records, count(*) FILTER (length(text) < 300) AS short, count(*) FILTER (lang <> 'en') AS foreign_text,
 round(100.0 * count(*) FILTER (NOT (length(text) < 300 OR lang <> 'en')) / count(*), 2) AS success_pct FROM documents""")
def _(spark, d):
    return crawl.run_report(read(spark, d, "documents"), {"short": F.length("text") < 300, "foreign_text": F.col("lang") != "en"})


@query("snapshot_diff", """WITH a AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE source END AS source, lang, n_chars + (doc_id % 3 = 0)::int AS n_chars FROM documents WHERE doc_id % 4 <> 0)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' WHEN a.source <> b.source THEN 'mismatch' WHEN a.n_chars <> b.n_chars THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id) GROUP BY 1""")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    after = docs.where("doc_id % 4 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("source"))).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 3 == 0).cast("int"))
    return repair.snapshot_diff(docs.where("doc_id % 5 <> 0"), after, "doc_id", ["source"], ["lang", "n_chars"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("set_digest", """SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 15))::bigint)::varchar AS digest_a, sum(('0x' || substr(h, 16, 15))::bigint)::varchar AS digest_b
 FROM (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority) AS h FROM orders)""")
def _(spark, d):
    return repair.set_digest(read(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("duplicate_excess", "SELECT count(*) AS n_keys, coalesce(sum(copies - 1), 0)::bigint AS excess FROM (SELECT course_code, count(*) AS copies FROM course GROUP BY 1 HAVING count(*) > 1)", True)
def _(spark, d):
    return repair.duplicate_excess(projection.courses(spark, d), F.col("course_code"))


@query("repair_summary", """SELECT (SELECT count(*) FROM lineitem) AS sections_before, (SELECT count(*) FROM lineitem WHERE l_linenumber = 3) AS shifted_before, (SELECT count(*) FROM lineitem WHERE l_quantity > 2) AS sections_after,
 0::bigint AS shifted_after, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 3 OR l_quantity <= 2))) AS changed""")
def _(spark, d):
    line = read(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", F.col("l_orderkey").alias("o"))
    wrong = F.when(F.col("l_linenumber") == 3, F.array(F.lit("invalid_points"))).otherwise(F.array().cast("array<string>"))
    before = line.select("l_partkey", wrong.alias("errors"), F.struct("o", "l_linenumber", F.size(wrong).alias("n")).alias("payload"))
    after = line.where("l_quantity > 2").select("l_partkey", F.array().cast("array<string>").alias("errors"), F.struct("o", "l_linenumber", F.lit(0).alias("n")).alias("payload"))
    return repair.repair_summary(before, after, "l_partkey")


@query("index_rebuilt", "SELECT course_uid, title, points_min + 1 AS points_min, level FROM course", True)
def _(spark, d):
    rows = projection.courses(spark, d).select("course_uid", "title", "points_min", codes.level(F.col("course_code")).alias("level"))
    return repair.rebuilt(rows, rows.select("course_uid", (F.col("points_min") + 1).alias("points_min")), ["points_min"])


@query("page_reach", """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS source, o_orderkey % 1500 AS target FROM orders), r AS (SELECT 1::bigint AS url, 0 AS depth UNION SELECT l.target, depth + 1 FROM r JOIN l ON l.source = r.url WHERE depth < 3) SELECT url, min(depth)::int AS depth FROM r GROUP BY url""")
def _(spark, d):
    links = read(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 1500).alias("target")).distinct()
    return crawl.reachable(links, values(spark, [(1,)], ["url"]), 3)


# Joins and sets

@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join_fk", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("full_outer_classify", """SELECT CASE WHEN o_custkey IS NULL THEN 'unmatched' WHEN c_custkey IS NULL THEN 'extra' ELSE 'matched' END AS kind, count(*) AS n FROM customer FULL JOIN (SELECT DISTINCT o_custkey + 100 AS o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1""")
def _(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") + 100).alias("o_custkey")).distinct()
    kind = F.when(F.col("o_custkey").isNull(), "unmatched").when(F.col("c_custkey").isNull(), "extra").otherwise("matched")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


for _name, _word, _method in (("set_union", "UNION", lambda a, b: a.union(b).distinct()), ("set_intersect", "INTERSECT", DataFrame.intersect), ("set_except", "EXCEPT", DataFrame.subtract)):
    query(_name, f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 {_word} SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000")(
        lambda spark, d, f=_method: f(read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").where("s_acctbal < 3000").select("s_nationkey"))
    )


# Answers, citations and conversations

@query("render_course_list", """SELECT string_agg(place || '. ' || course_code || ' - ' || title, chr(10) ORDER BY place) AS text FROM (SELECT *, row_number() OVER (ORDER BY course_code, course_uid) AS place FROM course QUALIFY place <= 5)""", True)
def _(spark, d):
    rows = projection.courses(spark, d).orderBy("course_code", "course_uid").limit(5)
    return answers.course_list(rows.withColumn("place", F.row_number().over(W.orderBy("course_code", "course_uid"))))


@query("render_schedule", """SELECT course_uid, n, CASE WHEN n > 4 THEN '(+' || (n - 4) || ' more)' ELSE '' END AS tail FROM (SELECT course_uid, count(*) AS n FROM section WHERE published GROUP BY 1)""", True)
def _(spark, d):
    rows = index(spark, d).where(F.size("sections_summary") > 0)
    shown = answers.schedule_text(F.col("sections_summary"))
    return rows.select("course_uid", F.size("sections_summary").cast("long").alias("n"), F.regexp_extract(shown, r"(\(\+\d+ more\))$", 1).alias("tail"))


@query("citation_extract", """SELECT answer_id, uid, row_number() OVER (PARTITION BY answer_id ORDER BY place)::int AS mention FROM (
 SELECT o_orderkey AS answer_id, 'u' || (1 + o_orderkey % 3) AS uid, 1 AS place FROM orders UNION ALL SELECT o_orderkey, 'u4', 2 FROM orders)""")
def _(spark, d):
    o = dealt(read(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id")), "answer_id").distinct()
    words = F.format_string("See [S%d], or COMS W4111 and [S%d] and [S9].", 1 + F.col("answer_id") % 3, 1 + F.col("answer_id") % 3)
    basis = o.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    code = F.when(F.col("n") == 4, "COMS W4111").otherwise("COMS W1004")
    basis = basis.select("answer_id", F.concat(F.lit("u"), F.col("n").cast("string")).alias("uid"), F.concat(F.lit("S"), F.col("n").cast("string")).alias("label"), code.alias("course_code"))
    return answers.cited(o.withColumn("text", words), basis)


@query("export_markdown", """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**User**: ' ELSE '**Assistant**: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def _(spark, d):
    return answers.markdown_export(read(spark, d, "conversations"), "conv_id", "turn")


@query("history_budget", "SELECT conv_id, turn, used FROM (SELECT *, (sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))::bigint AS used FROM conversations) WHERE used <= 600")
def _(spark, d):
    return conversation.within_budget(read(spark, d, "conversations"), "conv_id", "turn", 600).select("conv_id", "turn", "used")


@query("last_n_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def _(spark, d):
    return conversation.last_turns(read(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


#: Follow-up questions, with scope and operation after some results.
FOLLOW_UPS = [
    ("Tell me about COMS W4111", "'new_search'", "'detail'"), ("Compare these", "'previous_results'", "'compare'"), ("What about the second one?", "'current_course'", "'detail'"),
    ("Which of these has the fewest prerequisites?", "'previous_results'", "'argmin'"), ("How many credits is it?", "'current_course'", "'detail'"), ("robotics courses", "'new_search'", "'detail'"),
    ("List the results", "'previous_results'", "'list'"), ("这两门课怎么样", "'previous_results'", "'detail'"),
]


@query("scope_parse", f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'new_search' ELSE {by_number('(conv_id * 3 + turn)', [s for _, s, _ in FOLLOW_UPS])} END AS scope,
 {by_number('(conv_id * 3 + turn)', [o for _, _, o in FOLLOW_UPS])} AS operation FROM conversations""")
def _(spark, d):
    rows = read(spark, d, "conversations").withColumn("n", F.col("conv_id") * 3 + F.col("turn"))
    # Every fourth turn has no results before it.
    before = F.when(F.col("turn") % 4 == 3, 0).otherwise(5)
    s = conversation.scope(nth([q for q, _, _ in FOLLOW_UPS], F.col("n")), before, F.lit(True), F.col("n") % 8 == 5, F.lit(False))
    return rows.select("conv_id", "turn", s["scope"].alias("scope"), s["operation"].alias("operation"))


#: Questions, Y a year of the table, with kind, department, teacher, term, days and the first keyword.
QUESTIONS = [
    ("Recommend computer science courses in Spring Y", "'recommend'", "'COMS'", "NULL", "'Spring ' || y", 0, "'computer'"), ("What is COMS W4111 about?", "'detail'", "'COMS'", "NULL", "NULL", 0, "'coms'"),
    ("How many departments are there?", "'stats'", "NULL", "NULL", "NULL", 0, "NULL"), ("What does Professor Quarrie teach in mechanical engineering", "'search'", "'MECE'", "'Quarrie'", "NULL", 0, "'professor'"),
    ("structural design on Tuesdays and Thursdays", "'search'", "NULL", "NULL", "NULL", 2, "'structural'"), ("How do I register late", "'general'", "NULL", "NULL", "NULL", 0, "'register'"),
    ("anything on robots taught by ada lovelace, fall Y", "'search'", "NULL", "'ada lovelace'", "'Fall ' || y", 0, "'anything'"), ("Who is teaching Lovelace's optimisation seminar?", "'search'", "NULL", "'Lovelace''s'", "NULL", 0, "'teaching'"),
    ("Which course codes have you mentioned so far?", "'search'", "NULL", "NULL", "NULL", 0, "NULL"), ("some math on a Monday", "'search'", "'APMA'", "NULL", "NULL", 1, "'math'"),
]


@query("intent_parse", f"""SELECT p_partkey, {by_number('p_partkey', [q[1] for q in QUESTIONS])} AS query_type, {by_number('p_partkey', [q[2] for q in QUESTIONS])} AS department, {by_number('p_partkey', [q[3] for q in QUESTIONS])} AS instructor,
 {by_number('p_partkey', [q[4] for q in QUESTIONS])} AS term, {by_number('p_partkey', [str(q[5]) for q in QUESTIONS])} AS n_days, {by_number('p_partkey', [q[6] for q in QUESTIONS])} AS keyword FROM (SELECT p_partkey, 2000 + p_size AS y FROM part)""")
def _(spark, d):
    question = F.replace(nth([q[0] for q in QUESTIONS], F.col("p_partkey")), F.lit("Y"), (2000 + F.col("p_size")).cast("string"))
    rows = read(spark, d, "part").select("p_partkey", intent.intent_of(question).alias("i"))
    return rows.select("p_partkey", "i.query_type", "i.department", "i.instructor", "i.term", F.size("i.day_preference").alias("n_days"), F.get("i.keywords", F.lit(0)).alias("keyword"))


@query("question_english", """SELECT p_partkey, q || CASE p_partkey % 4 WHEN 0 THEN ' computer science recommend courses' WHEN 1 THEN ' Monday morning' WHEN 2 THEN ' what courses Monday' ELSE '' END AS english FROM (
 SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' 推荐计算机课程' WHEN 1 THEN ' el Lunes por la mañana' WHEN 2 THEN ' quels cours lundi' ELSE '' END AS q FROM part)""".replace("' Monday morning'", "' Monday morning morning'").replace("' computer science recommend courses'", "' computer science recommend courses'"))
def _(spark, d):
    tail = F.element_at(F.array(F.lit(" 推荐计算机课程"), F.lit(" el Lunes por la mañana"), F.lit(" quels cours lundi"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return dealt(read(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", language.with_english(F.concat("p_name", tail)).alias("english"))


#: Questions with the department that they name.
NAMING = [
    ("structural work in civil engineering", "'CIEN'"), ("operations research this spring", "'IEOR'"), ("cs课", "'COMS'"), ("what does CS offer", "'COMS'"), ("scs课", "NULL"),
    ("robotics labs", "NULL"), ("computer课", "NULL"), ("cs50课", "NULL"), ("courses in APMA", "'APMA'"),
]


@query("department_named", f"SELECT p_partkey, {by_number('p_partkey', [n for _, n in NAMING])} AS department FROM part")
def _(spark, d):
    # A number of the table goes with each question and changes nothing.
    asked = F.concat_ws(" ", nth([q for q, _ in NAMING], F.col("p_partkey")), F.col("p_size").cast("string"))
    return dealt(read(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", language.department_named(asked).alias("department"))


@query("intent_validation", """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'query_type' WHEN 2 THEN 'course code' WHEN 3 THEN 'comparison_targets conflict' WHEN 4 THEN 'comparison_targets without compare'
 WHEN 5 THEN 'department' WHEN 6 THEN 'points_range bounds' WHEN 7 THEN 'term' WHEN 8 THEN 'day_preference' ELSE 'not an intent' END AS problem FROM part""")
def _(spark, d):
    documents = [
        '{"query_type": "search", "course_codes": ["coms-w4111"], "department": "coms", "points_range": [3, null], "day_preference": ["monday"], "term": "Fall 2025"}',
        '{"query_type": "poem"}', '{"query_type": "detail", "course_codes": ["COMS 4111"]}',
        '{"query_type": "compare", "course_codes": ["COMS W4111", "COMS W3134"], "comparison_targets": ["COMS W4111"]}', '{"query_type": "search", "comparison_targets": ["COMS W4111"]}',
        '{"query_type": "search", "department": "XXXX"}', '{"query_type": "search", "points_range": [5, 2]}', '{"query_type": "search", "term": "2025 Fall"}', '{"query_type": "search", "day_preference": ["noday"]}', '["search"]']
    document = F.element_at(F.array(*map(F.lit, documents)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return dealt(read(spark, d, "part").select("p_partkey")).select("p_partkey", validation.problem(validation.parsed(document)).alias("problem"))


@query("intent_choice", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'rules' WHEN p_partkey % 3 = 0 THEN 'model' ELSE 'minimal' END AS source, CASE WHEN p_partkey % 2 = 0 THEN 'detail' WHEN p_partkey % 3 = 0 THEN 'search' ELSE 'general' END AS query_type FROM part")
def _(spark, d):
    key = F.col("p_partkey")
    rows = read(spark, d, "part").select("p_partkey", validation.chosen([("rules", F.when(key % 2 == 0, "detail")), ("model", F.when(key % 3 == 0, "search"))], F.lit("general")).alias("c"))
    return rows.select("p_partkey", "c.source", F.col("c.intent").alias("query_type"))


@query("localised_text", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Nada' WHEN 1 THEN 'Nothing' ELSE 'Nothing' END AS text FROM nation")
def _(spark, d):
    lang = F.element_at(F.array(F.lit("es"), F.lit("en"), F.lit("pt")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return read(spark, d, "nation").select("n_nationkey", language.localised({"en": {"none": "Nothing"}, "es": {"none": "Nada"}}, F.lit("none"), lang).alias("text"))


@query("title_line", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE course_code END AS code, title, CASE WHEN p_partkey % 2 = 0 THEN '3-4.5 points' ELSE '' END AS points,
 concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'missing_points_in_title' END, CASE WHEN p_partkey % 3 = 2 THEN 'missing_course_code_or_title' END) AS issues,
 CASE WHEN p_partkey % 2 = 0 THEN 3.0::double END AS lo, CASE WHEN p_partkey % 2 = 0 THEN 4.5::double END AS hi FROM course""", True)
def _(spark, d):
    key = F.col("p_partkey")
    line = F.concat(F.when(key % 3 == 2, "").otherwise(F.concat("course_code", F.lit("  "))), "title", F.when(key % 2 == 0, ".  3-4.5 Points.").otherwise("."))
    rows = projection.courses(spark, d).select("p_partkey", codes.title_line(line).alias("t"))
    points = credits.crawled_points(F.col("t.points"))
    return rows.select("p_partkey", "t.code", "t.title", F.lower("t.points").alias("points"), F.array_join("t.issues", ",").alias("issues"), points["lo"].alias("lo"), points["hi"].alias("hi"))


@query("evidence_bounded_pairs", """SELECT a.event_id, arg_min(b.event_id, (b.t, b.event_id)) AS right_id FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS until FROM (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type = 'signup')) a
 JOIN (SELECT *, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.t >= a.t AND (a.until IS NULL OR b.t < a.until) AND b.t - a.t <= 172800000000 GROUP BY 1""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    left = e.where("event_type = 'signup'").select("event_id", "user_id", "t", F.col("t").alias("end"))
    right = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("id"))
    return importing.bounded_pairs(left, right, "user_id", "t", "end", "t", "id", 172_800_000_000).select("event_id", "right_id")


@query("evidence_matching_pair", """SELECT flag, status, min(l_quantity)::double AS distance, arg_min(l_orderkey, (l_quantity, l_orderkey, l_linenumber)) AS l_orderkey FROM (SELECT DISTINCT lower(l_returnflag) AS flag, lower(l_linestatus) AS status FROM lineitem) c
 JOIN lineitem ON lower(l_returnflag) = flag AND lower(l_linestatus) = status GROUP BY 1, 2""")
def _(spark, d):
    pairs = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("distance"), "l_orderkey", "l_linenumber")
    claims = pairs.select(F.lower("flag").alias("flag"), F.lower("status").alias("status")).distinct()
    return importing.matching_pairs(claims, pairs, ["flag", "status"], "distance", ["l_orderkey", "l_linenumber"]).select("flag", "status", "distance", "l_orderkey")


@query("reviewable_error", "SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber = 1 AS reviewable FROM lineitem")
def _(spark, d):
    rows = projection.sections(spark, d).withColumn("times", F.when(F.col("l_linenumber") == 1, F.concat("times", F.lit(" Ada Lovelace"))).otherwise("Imelda Quarrie"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", importing.reviewable(F.lit("invalid_times"), F.col("times")).alias("reviewable"))


# Events: rate limits, protocol, windows

@query("rate_window_upper_bound", """SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def _(spark, d):
    return analytics.rate_bound(read(spark, d, "events"), ["user_id", "event_type"], "ts", 3600).select("event_id", "in_window")


@query("rate_admission_exact", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT user_id, event_id, n, true AS admitted, NULL::bigint AS older, t AS newer FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, coalesce(w.older, -1) <= e.t - 21600000000, CASE WHEN coalesce(w.older, -1) <= e.t - 21600000000 THEN w.newer ELSE w.older END, CASE WHEN coalesce(w.older, -1) <= e.t - 21600000000 THEN e.t ELSE w.newer END
 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT user_id, event_id, admitted FROM w""")
def _(spark, d):
    return rate.admitted(read(spark, d, "events"), ["user_id"], "ts", "event_id", seconds=6 * 3600, limit=2)


@query("sse_decode", "SELECT conv_id, count(*) + 2 AS n_events FROM conversations GROUP BY 1")
def _(spark, d):
    return protocol.decode(protocol.sample_stream(read(spark, d, "conversations")), "conv_id", "seq", "data").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_events"))


@query("sse_protocol_check", """SELECT conv_id, conv_id % 4 NOT IN (1, 2, 3) AS ok, CASE conv_id % 4 WHEN 1 THEN 'no end' WHEN 2 THEN (CASE WHEN count(*) > 1 THEN 'chunk' ELSE 'sources' END) || ' after start' WHEN 3 THEN 'chunk after sources' ELSE '' END AS problem
 FROM conversations GROUP BY 1""")
def _(spark, d):
    events = protocol.decode(protocol.sample_stream(read(spark, d, "conversations")), "conv_id", "seq", "data")
    # One in four streams lacks its end, one its beginning, and in one a chunk comes late.
    part = F.col("conv_id") % 4
    events = events.where(~((part == 1) & (F.col("type") == "done")) & ~((part == 2) & (F.col("type") == "meta")))
    late = events.where((F.col("conv_id") % 4 == 3) & (F.col("type") == "sources")).withColumns({"pos": F.col("pos") + 0.5, "type": F.lit("chunk")})
    return protocol.checked(events.withColumn("pos", F.col("pos") + 0.0).unionByName(late), "conv_id", "pos", "type")


@query("reset_and_replace", "SELECT conv_id, turn FROM conversations c WHERE turn <> 2 AND (turn > 2 OR NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 2))")
def _(spark, d):
    rows = read(spark, d, "conversations").withColumn("type", F.when(F.col("turn") == 2, "fallback").otherwise("chunk"))
    return conversation.after_reset(rows, "conv_id", "turn").select("conv_id", "turn")


@query("session_windows", """SELECT user_id, began, ended, n_events FROM (SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n_events FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM (
 SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events)) GROUP BY 1, 2)""")
def _(spark, d):
    return analytics.sessions(read(spark, d, "events"), "user_id", "ts", "30 minutes").drop("session")


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return read(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("began"), "event_type", "n")


@query("interval_join_events", """SELECT a.event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return analytics.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "1 hour", 3_600_000_000).select("event_id", "right_event_id")


@query("rollup_dept_term", "SELECT department_prefix AS dept, term, count(*) AS n FROM course JOIN section USING (course_uid) GROUP BY ROLLUP (department_prefix, term)", True)
def _(spark, d):
    rows = projection.courses(spark, d).select("course_uid", codes.department(F.col("course_code")).alias("dept")).join(projection.sections(spark, d), "course_uid")
    return rows.rollup("dept", "term").agg(F.count(F.lit(1)).alias("n"))


@query("cube_flags", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::int AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("rank_in_dept", "SELECT course_uid, rank() OVER (PARTITION BY department_prefix ORDER BY level)::int AS r, dense_rank() OVER (PARTITION BY department_prefix ORDER BY level)::int AS dr FROM course", True)
def _(spark, d):
    rows = projection.courses(spark, d).select("course_uid", codes.department(F.col("course_code")).alias("dept"), codes.level(F.col("course_code")).alias("level"))
    w = W.partitionBy("dept").orderBy("level")
    return rows.select("course_uid", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"))
