"""Queries of the functions for single records, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import codes, credits, schedule, text
from lectern.operators import answers, context, conversation, crawl, dictionary, evidence, importing, overlays, records, repair, retrieval, robots
from lectern.plans import projection, routing
from lectern.queries import QUALITY, VISIBLE, index, query, read
from lectern.sources import course_pages
from lectern.streaming import protocol


@query("course_uid_made", "SELECT p_partkey, sha1(trim(p_name) || '|' || trim(p_type)) AS uid FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", records.course_uid(F.concat(F.lit(" "), "p_name"), F.concat("p_type", F.lit("  "))).alias("uid"))


@query("filled_down", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS props FROM events")
def _(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("place"), F.when(F.col("event_type") == "signup", F.col("props")).otherwise(" ").alias("props"))
    return records.filled_down(e, "user_id", "place", "props").select("event_id", "props")


@query("same_set", "SELECT p_partkey, p_size % 4 = p_partkey % 4 OR (p_size % 4 + p_partkey % 4) = 3 AS same FROM part")
def _(spark, d):
    a, b = F.col("p_size") % 4, F.col("p_partkey") % 4
    pair = lambda n: F.array(n.cast("long"), (3 - n).cast("long"), n.cast("long"))
    return read(spark, d, "part").select("p_partkey", records.same_set(pair(a), pair(b)).alias("same"))


@query("robots_allow", r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) AS rest FROM pages),
p AS (SELECT page_id, host, CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS path FROM u),
-- Hosts by the length of their name: the first has a group of the agent's own, the second only the general one, the third none.
g AS (SELECT *, length(host) % 3 AS kind FROM p),
r AS (SELECT * FROM (VALUES (0, true, '/en/'), (0, false, '/'), (0, false, '/en/1'), (0, true, '/en/1*/'), (1, false, '/fr'), (1, true, '/fr/1'), (1, false, '/*?page='), (1, false, '/de/')) t(kind, allow, rule)),
m AS (SELECT page_id, rule, allow FROM g JOIN r ON g.kind = r.kind AND (CASE WHEN contains(rule, '*') THEN regexp_matches(path, '^' || replace(replace(rule, '?', '\?'), '*', '.*')) ELSE starts_with(path, rule) END))
SELECT g.page_id, coalesce(arg_max(allow, (length(rule), allow)), true) AS allowed, arg_max(rule, (length(rule), allow)) AS rule FROM g LEFT JOIN m ON m.page_id = g.page_id GROUP BY g.page_id""")
def _(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(robots.host(F.col("url")).alias("host")).distinct()
    own = "User-agent: *\nDisallow: /all\n\nUser-agent: Other\nUser-agent: lectern\nAllow: /en/ # theirs\nDisallow: /\nDisallow: /en/1\nAllow: /en/1*/\nCrawl-delay: 3"
    general = "User-agent: lect-other\nDisallow: /\n\nUSER-AGENT: *\nDisallow: /fr\nAllow: /fr/1\nDisallow: /*?page=\nno colon\nDisallow: /de/"
    text = F.element_at(F.array(F.lit(own), F.lit(general), F.lit("Sitemap: https://x/y")), (F.length("host") % 3 + 1).cast("int"))
    return robots.decided(pages, robots.rules(hosts.withColumn("text", text)), "Lectern/1.0").select("page_id", "allowed", "rule")


@query("dictionary_join", """WITH terms AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT unnest(['tion', 'the', 'é', 'of the', '<p>', 'example.'])),
t AS (SELECT page_id, lower(html) AS body FROM pages)
SELECT page_id, phrase, strpos(body, lower(phrase)) - 1 AS first, (length(body) - length(replace(body, lower(phrase), ''))) // length(phrase) AS n FROM t JOIN terms ON contains(body, lower(phrase))""")
def _(spark, d):
    more = spark.createDataFrame([(p,) for p in ("tion", "the", "é", "of the", "<p>", "example.")], "phrase string")
    terms = read(spark, d, "part").select(F.col("p_name").alias("phrase")).union(more)
    places = dictionary.found(read(spark, d, "pages"), "page_id", "html", terms, "phrase")
    # None of these phrases overlaps itself, so all places are counted.
    return places.groupBy("page_id", "phrase").agg(F.min("start").cast("long").alias("first"), F.count(F.lit(1)).alias("n"))


@query("first_match", "SELECT c_custkey, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, min(p_size) AS p_size FROM customer JOIN part ON c_custkey % 40 = p_partkey % 50 GROUP BY 1")
def _(spark, d):
    people = read(spark, d, "customer").select("c_custkey")
    things = read(spark, d, "part").select("p_partkey", "p_size", F.struct("p_size", "p_partkey").alias("at"))
    return dictionary.first_match(people, things, F.col("c_custkey") % 40, F.col("p_partkey") % 50, "at").select("c_custkey", "p_partkey", "p_size")


@query("course_page_sections", """SELECT course_uid, term, section_id AS section_call_number, times, instructor, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE points || '0' END AS points, current_n AS enrollment_current, capacity_n AS enrollment_capacity, count(*)::bigint AS n
 FROM section GROUP BY ALL""", True)
def _(spark, d):
    rows = projection.sections(spark, d)
    order = F.pmod(F.col("l_orderkey"), F.lit(3))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    seats = F.concat_ws("/", "enrollment_current", "enrollment_capacity")
    number, call, when, who, points = (cell(c) for c in (F.lit("1234"), F.concat(F.lit("<b>"), "section_call_number", F.lit("</b>")), F.concat("times", F.lit("<br/>")), F.col("instructor"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("points"))))
    heads = lambda *names: "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    # Columns in the usual order without headers, then in two other orders with them.
    head = F.element_at(F.array(F.lit(""), F.lit(heads("Instructor", "Course Number", "Section/Call  Number", "Enrollment", "Times/Location", "Points")), F.lit(heads("Enrollment", "Points", "Instructor", "Times/Location", "Section/Call Number", "Course Number"))), (order + 1).cast("int"))
    row = F.when(order == 0, F.concat(number, call, when, who, points, cell(seats))).when(order == 1, F.concat(who, number, call, cell(seats), when, points)).otherwise(F.concat(cell(seats), points, who, when, call, number))
    table = F.concat(F.lit("<div class='desc_sched'><table class='scheduletbl x'><tr><td colspan=6>"), "term", F.lit(": 1234</td></tr>"), head, F.lit("<tr>"), row, F.lit("</tr></table></div>"))
    block = rows.groupBy("course_uid").agg(F.array_join(F.array_sort(F.collect_list(table)), "").alias("tables"))
    html = F.concat(F.lit("<html><head><title>T</title></head><body><main><h1>Dept</h1><div id='sc_courseblock'><div class='courseblock'><p class='courseblocktitle'><strong>COMS W1004 Intro. 3 points</strong></p><p>Text &amp; more"), "tables", F.lit("</div></div></main></body></html>"))
    found = course_pages.sections(course_pages.courses(block.select(F.col("course_uid").alias("url"), html.alias("html"))))
    # Sections that repeat in all that names them are one on a page; here orders tell them apart, so each is counted.
    keys = ["course_uid", "term", "section_call_number", "times", "instructor"]
    return found.withColumnRenamed("url", "course_uid").groupBy(*keys, "points", "enrollment_current", "enrollment_capacity").agg(F.count(F.lit(1)).alias("n"))


@query("first_sentence", r"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?s)^.*?[.?!]\s+.*$') THEN regexp_extract(text, '(?s)^(.*?[.?!])\s+', 1) ELSE text END) AS first FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.first_sentence(F.col("text"))["first"].cast("binary")).alias("first"))


@query("without_thoughts", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'a' || text || ' b' WHEN turn % 3 = 1 THEN text ELSE text || ' ' END AS answer FROM conversations WHERE text NOT LIKE '%<think>%'")
def _(spark, d):
    hidden = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a<think>x\ny</THINK>"), "text", F.lit("<think>z</think> b"))).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" <think>open")))
    return read(spark, d, "conversations").where("text not like '%<think>%'").select("conv_id", "turn", text.without_thoughts(hidden).alias("answer"))


@query("strict_count", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <= 100000 THEN o_custkey::int END AS n FROM orders")
def _(spark, d):
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, "12x").otherwise("1234567")
    return read(spark, d, "orders").select("o_orderkey", text.strict_count(shown).alias("n"))


@query("spans_of", "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::bigint AS n, instr(lower(text), 'the') - 1 AS first FROM documents WHERE contains(lower(text), 'the')")
def _(spark, d):
    spans = read(spark, d, "documents").select("doc_id", text.spans_of(F.col("text"), F.lit("The")).alias("s")).where(F.size("s") > 0)
    return spans.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["start"].cast("long").alias("first"))


@query("span_distance", "SELECT l_orderkey, l_linenumber, l_suppkey, greatest(0, 20 - (l_quantity::int + 5), l_quantity::int - 25)::int AS gap FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity").cast("int")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", text.span_distance(q, q + 5, F.lit(20), F.lit(25)).alias("gap"))


@query("contains_alias", "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') AS has FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.contains_alias(F.col("text"), "THE").alias("has"))


@query("folded_text", "SELECT page_id, trim(lower(strip_accents(url))) AS folded FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.fold(F.concat(F.lit("  "), F.upper("url"), F.lit(" "))).alias("folded"))


@query("points_text", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'raw' WHEN p_size % 4 = 1 THEN 'N/A' WHEN p_size % 4 = 2 THEN p_size::varchar ELSE p_size || '-' || (p_size + 2) END AS points FROM part")
def _(spark, d):
    n, part = F.col("p_size").cast("double"), F.col("p_size") % 4
    shown = answers.points_text(F.when(part == 0, " raw "), F.when(part != 1, n), F.when(part == 3, n + 2).when(part == 2, n))
    return read(spark, d, "part").select("p_partkey", shown.alias("points"))


@query("source_labels", "SELECT o_custkey AS answer_id, o_orderkey AS uid, 'S' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS label FROM orders")
def _(spark, d):
    basis = read(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("uid"), "o_orderdate")
    return answers.source_records(basis, [F.desc("o_orderdate"), "uid"]).select("answer_id", "uid", "label")


@query("citations_unsupported", "SELECT o_orderkey AS answer_id, o_custkey AS uid FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 5 = 0")
def _(spark, d):
    cites = read(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.col("o_custkey").alias("uid"))
    return answers.unsupported(cites, cites.where("not (uid % 3 = 0 or answer_id % 5 = 0)"))


@query("sources_event", """SELECT o_custkey AS answer_id, '{"type":"sources","sources":[' || string_agg('{"uid":"' || o_orderkey || '","course_code":"' || o_orderpriority || '","title":"' || o_orderstatus || '","citation_label":"S1"}', ',' ORDER BY o_orderkey) || ']}' AS event FROM orders GROUP BY 1""")
def _(spark, d):
    basis = read(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("course_code"), F.col("o_orderstatus").alias("title"), F.lit("S1").alias("label"))
    cites = basis.select("answer_id", "uid", F.row_number().over(W.partitionBy("answer_id").orderBy(F.col("uid").cast("long"))).alias("mention"))
    return answers.sources_event(cites, basis)


@query("place_split", "SELECT l_orderkey, l_linenumber, l_suppkey, times, CASE WHEN l_linenumber <= 4 THEN 'Mudd 233' ELSE '' END AS location FROM (SELECT *, CASE WHEN l_linenumber <= 4 THEN times ELSE times || ' Mudd 233' END AS times FROM section) s".replace("SELECT *, CASE", "SELECT * REPLACE (CASE").replace("END AS times FROM section", "END AS times) FROM section"), True)
def _(spark, d):
    rows = projection.sections(spark, d).withColumn("p", schedule.split_place(F.concat("times", F.lit(" Mudd 233"))))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "p.times", "p.location")


@query("term_normal", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'The ' || term ELSE term END AS term FROM section", True)
def _(spark, d):
    loose = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("The "), "term")).otherwise(F.upper(F.replace("term", F.lit(" "), F.lit("   "))))
    return projection.sections(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", schedule.normalize_term(loose).alias("term"))


@query("code_current_level", "SELECT course_uid, p_partkey % 2 = 0 AS current FROM course", True)
def _(spark, d):
    code = F.when(F.col("p_partkey") % 2 == 0, F.col("course_code")).otherwise("MATH V2010")
    return projection.courses(spark, d).select("course_uid", codes.is_current_level(code).alias("current"))


@query("single_department", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN department_prefix END AS dept FROM course", True)
def _(spark, d):
    listed = F.when(F.col("p_partkey") % 3 == 0, F.array("course_code", "course_code")).when(F.col("p_partkey") % 3 == 1, F.array("course_code", F.lit("ZZZZ W1000"))).otherwise(F.array().cast("array<string>"))
    return projection.courses(spark, d).select("p_partkey", records.single_department(listed).alias("dept"))


@query("missing_fields", "SELECT course_uid, concat_ws(',', CASE WHEN trim(coalesce(description, '')) = '' THEN 'description' END, CASE WHEN p_partkey % 7 = 0 THEN 'prerequisites_text' END) AS missing FROM course", True)
def _(spark, d):
    rows = projection.courses(spark, d).withColumn("points_raw", F.lit("3"))
    return rows.select("course_uid", F.array_join(records.missing_fields(rows), ",").alias("missing"))


@query("points_completed", "SELECT course_uid, CASE WHEN points_min = 0 OR points_max = 0 THEN 1.5 ELSE points_min END AS points_min, CASE WHEN points_min = 0 OR points_max = 0 THEN 6 ELSE points_max END::double AS points_max FROM course".replace("1.5 ELSE points_min END", "1.5::double ELSE points_min END"), True)
def _(spark, d):
    return records.with_points(projection.courses(spark, d).withColumn("points_raw", F.lit("1.5-6 credits"))).select("course_uid", "points_min", "points_max")


@query("record_completed", "SELECT course_uid AS old, sha1(course_code || '|' || trim(title)) AS uid, department_prefix AS dept, CASE WHEN trim(coalesce(description, '')) = '' THEN 'none' ELSE 'imported' END AS source FROM course", True)
def _(spark, d):
    rows = projection.courses(spark, d).withColumns({"old": F.col("course_uid"), "points_raw": F.lit("3"), "course_code": F.replace(F.lower("course_code"), F.lit(" "), F.lit("-"))})
    return records.completed(rows, "2025").select("old", F.col("course_uid").alias("uid"), F.col("department_or_group").alias("dept"), F.col("description_source").alias("source"))


@query("lost_context", "SELECT conv_id, turn, turn * turn AS revision FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND turn * turn <> before * before + 1")
def _(spark, d):
    turns = read(spark, d, "conversations").withColumn("revision", F.col("turn") * F.col("turn"))
    return conversation.lost_context(turns, "conv_id", "turn", "revision").select("conv_id", "turn", "revision")


@query("points_conflict", "SELECT s.l_orderkey, s.l_linenumber, s.l_suppkey, points < points_min OR points > points_max AS conflict FROM section s JOIN course USING (course_uid)", True)
def _(spark, d):
    rows = projection.sections(spark, d).select("course_uid", "l_orderkey", "l_linenumber", "l_suppkey", credits.points_value(F.col("points")).alias("v")).join(projection.courses(spark, d).select("course_uid", "points_min", "points_max"), "course_uid")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", importing.points_conflict(F.col("v.lo"), F.col("v.hi"), F.col("points_min"), F.col("points_max")).alias("conflict"))


@query("overall_status", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'published' WHEN bool_or(o_orderstatus = 'O') THEN 'review' ELSE 'rejected' END AS status FROM orders GROUP BY 1")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "review").otherwise("rejected")
    return read(spark, d, "orders").groupBy("o_custkey").agg(importing.overall_status(status).alias("status"))


@query("beginner_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN p_size % 5 ELSE 9 END, p_name, p_partkey)::int AS place FROM part WHERE p_size % 3 <> 1 QUALIFY place <= 40")
def _(spark, d):
    status = F.when(F.col("p_size") % 3 == 0, "positive").when(F.col("p_size") % 3 == 1, "negative").otherwise("unknown")
    rows = read(spark, d, "part").withColumn("suitability", F.struct(status.alias("status"), (F.col("p_size") % 5).alias("priority")))
    best = retrieval.beginner_order(rows, ["p_name", "p_partkey"]).limit(40)
    order = F.when(F.col("suitability.status") == "positive", F.col("suitability.priority")).otherwise(9)
    return best.select("p_partkey", F.row_number().over(W.orderBy(order, "p_name", "p_partkey")).alias("place"))


@query("idle_gaps", """SELECT user_id, bool_or(gap > 70 * 60 * 1000000::bigint) AS timed_out FROM (SELECT user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 0) AS gap FROM events) GROUP BY 1""".replace("> 70", ">= 70"))
def _(spark, d):
    return protocol.idle_gaps(read(spark, d, "events"), "user_id", "ts", 70 * 60)


@query("shifted_sections", "SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber = 2 AS shifted FROM lineitem")
def _(spark, d):
    wrong = F.when(F.col("l_linenumber") == 2, F.array(F.lit("invalid_times"), F.lit("invalid_points"))).otherwise(F.array(F.lit("invalid_times")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", repair.shifted(wrong).alias("shifted"))


@query("prerequisite_text", """SELECT course_uid, CASE p_partkey % 7 WHEN 0 THEN 'Prerequisites are not listed.' WHEN 1 THEN 'No prerequisites.' WHEN 2 THEN 'All of: ' WHEN 3 THEN 'One of: ' WHEN 5 THEN 'Recommended: ' ELSE 'Mentioned: ' END AS shown FROM course""", True)
def _(spark, d):
    from lectern.functions.prerequisites import parse_prerequisites

    said = answers.prerequisite_text(parse_prerequisites(F.col("prerequisites_text")))
    return projection.courses(spark, d).select("course_uid", F.regexp_extract(said, r"^([^:]*(?:: )?)", 1).alias("shown"))


@query("facts_text", "SELECT course_uid, course_code || chr(10) || 'Credits: 3' || CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE chr(10) || 'Description: ' || trim(description) END AS facts FROM course", True)
def _(spark, d):
    return projection.courses(spark, d).select("course_uid", records.facts(F.col("course_code"), F.lit("3"), F.array().cast("array<string>"), F.col("description")).alias("facts"))


@query("quality_without_words", f", {QUALITY} SELECT course_uid, quality FROM quality WHERE {VISIBLE} ORDER BY quality DESC, level, course_code, title, course_uid LIMIT 20", True)
def _(spark, d):
    return retrieval.keyword_topk(index(spark, d), [" "]).select("course_uid", "quality")


@query("first_section_fields", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN term ELSE 'own' END AS term, section_id FROM section", True)
def _(spark, d):
    rows = projection.sections(spark, d).withColumn("sections", F.array(F.struct("term", "section_call_number")))
    rows = rows.withColumns({"section_id": F.lit(" "), "term": F.when(F.col("l_linenumber") == 1, "").otherwise("own")})
    return records.with_first_section(rows).select("l_orderkey", "l_linenumber", "l_suppkey", "term", "section_id")


@query("first_mentions", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1")
def _(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(F.lower("o_orderpriority")).alias("course_uid"), F.col("o_orderpriority").alias("course_code"))
    return records.first_mentions(rows, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("provider_failure", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'rate_limited' WHEN 'click' THEN 'unreachable' ELSE CASE WHEN event_id % 2 = 0 THEN 'invalid_stream' ELSE 'provider_error' END END AS failure FROM events")
def _(spark, d):
    kind = F.when(F.col("event_type") == "signup", "timeout").when(F.col("event_type") == "click", "connection").otherwise("other")
    said = F.when(F.col("event_type") == "purchase", "HTTP 429").when((F.col("event_id") % 2 == 0) & ~F.col("event_type").isin("signup", "click"), "Malformed reply").otherwise("odd")
    return read(spark, d, "events").select("event_id", records.provider_failure(kind, said).alias("failure"))


@query("response_guard", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'none' ELSE o_orderpriority END AS shown FROM orders")
def _(spark, d):
    shown = records.response_guard(F.col("o_custkey") % 3, F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"), F.lit("none"))
    return read(spark, d, "orders").select("o_orderkey", shown.alias("shown"))


@query("canonical_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"none":null}' AS json FROM nation""")
def _(spark, d):
    return read(spark, d, "nation").withColumn("none", F.lit(None).cast("string")).select("n_nationkey", records.canonical_json("none", "n_nationkey", "n_name").alias("json"))


@query("pass_counts", "SELECT event_type AS prefix, count(*) AS n, count(*) FILTER (value > 50) AS passed, round(avg(value), 3) AS seconds FROM events GROUP BY 1")
def _(spark, d):
    return crawl.pass_counts(read(spark, d, "events"), F.col("event_type"), F.col("value") > 50, F.col("value"))


@query("snapshot_order", "SELECT course_uid, row_number() OVER (ORDER BY course_code, title, course_uid)::int AS place FROM course", True)
def _(spark, d):
    return crawl.snapshot_places(projection.courses(spark, d))


@query("effective_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey)::int AS place FROM orders QUALIFY place <= 25")
def _(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("course_code"), F.col("o_orderstatus").alias("term"), F.col("o_orderkey").alias("section_id"))
    best = overlays.effective_order(overlays.without_fields(rows.withColumn("extra", F.lit(1)), "extra")).limit(25)
    return best.select("o_orderkey", F.row_number().over(W.orderBy("course_code", "term", "section_id")).alias("place"))


@query("claim_evidence", "SELECT c.p_partkey, min(l_quantity)::double AS start, min(l_quantity) IS NOT NULL AS verified FROM part c LEFT JOIN lineitem ON l_partkey = c.p_partkey AND l_linenumber = 1 GROUP BY 1")
def _(spark, d):
    claims = read(spark, d, "part").select("p_partkey")
    spans = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + 3).alias("stop"))
    found = importing.evidence_of(claims, importing.anchors(spans, spans), ["p_partkey"])
    return found.select("p_partkey", "start", "verified")


@query("answer_path", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'stats' WHEN 1 THEN 'count_mismatch' WHEN 2 THEN 'suitability' WHEN 3 THEN 'prerequisites' WHEN 4 THEN 'schedule' WHEN 5 THEN 'facts'
 WHEN 6 THEN CASE WHEN p_size % 3 > 1 THEN 'facts' ELSE 'model' END WHEN 7 THEN CASE WHEN p_size % 3 > 1 THEN 'list' ELSE 'model' END ELSE 'model' END AS path FROM part""")
def _(spark, d):
    part = (F.col("p_partkey") % 9).cast("int")
    pick = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), part)
    intent = F.struct(
        F.coalesce(pick({0: "Stats", 7: "search"}), F.lit("detail")).alias("query_type"), F.when(part == 2, "beginner").alias("suitability"),
        F.when(part == 4, F.array(F.lit("Monday"))).otherwise(F.array().cast("array<string>")).alias("day_preference"))
    scope = F.struct(pick({3: "prerequisites", 5: "credits", 6: "description"}).alias("attribute"), F.when(part == 8, "list").otherwise("detail").alias("operation"))
    path = routing.answer_path(intent, scope, F.col("p_size") % 3, part == 8, part == 1)
    return read(spark, d, "part").select("p_partkey", path.alias("path"))


@query("service_health", """SELECT n_nationkey, CASE WHEN ok AND n_regionkey > 0 THEN 'ok' ELSE 'degraded' END AS status, concat_ws(',', CASE WHEN NOT ok AND m <> 1 THEN 'no key for the cloud model' END,
 CASE WHEN NOT ok AND m <> 0 THEN 'local model unreachable' END, CASE WHEN n_regionkey = 0 THEN 'no courses loaded' END) AS reasons FROM (
 SELECT *, n_nationkey % 3 AS m, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey % 2 = 0 WHEN 1 THEN n_nationkey % 5 = 0 ELSE n_nationkey % 2 = 0 OR n_nationkey % 5 = 0 END AS ok FROM nation)""")
def _(spark, d):
    key = F.col("n_nationkey")
    mode = F.element_at(F.array(F.lit("cloud"), F.lit("local"), F.lit("hybrid")), (key % 3 + 1).cast("int"))
    h = routing.health(mode, key % 2 == 0, key % 5 == 0, F.lit(False), F.col("n_regionkey"))
    return read(spark, d, "nation").select("n_nationkey", h["status"].alias("status"), F.array_join(h["reasons"], ",").alias("reasons"))


# Evidence: texts made of orders and their lines, and claims about them, some of them wrong

SYLLABUS = """lines AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS doc_id, l_linenumber AS n, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey),
said AS (SELECT doc_id, n, ['Fall', 'Spring', 'Summer'][n % 3 + 1] || ' ' || (2020 + n) AS term, lpad(n::varchar, 3, '0') || '/' || (10000 + l_suppkey) AS id,
 'Teacher ' || chr((64 + n)::int) || ' ' || translate(l_suppkey::varchar, '0123456789', 'abcdefghij') AS name, n % 4 + 1 AS points FROM lines),
texts AS (SELECT doc_id, 'Outline of ' || translate(doc_id::varchar, '0123456789', 'abcdefghij') || '. ' || string_agg(term || ' section ' || id || ' by ' || name || ', ' || points || ' points', '; ' ORDER BY n) AS text FROM said GROUP BY doc_id)"""


@query("evidence_bundle", f"""WITH {SYLLABUS}, asked AS (
 SELECT doc_id, NULL::bigint AS section, 'title' AS field, 'OUTLINE OF ' || upper(translate(doc_id::varchar, '0123456789', 'abcdefghij')) AS value, 0 AS start, length(value)::int AS stop, false AS tied FROM texts
 UNION ALL SELECT said.doc_id, n, 'term', CASE WHEN n % 5 = 0 THEN 'Winter 1999' ELSE term END, CASE WHEN n % 5 <> 0 THEN strpos(text, term) - 1 END, strpos(text, term) - 1 + length(term), n % 5 <> 0 FROM said JOIN texts USING (doc_id)
 UNION ALL SELECT said.doc_id, n, 'section_id', id, strpos(text, id) - 1, strpos(text, id) - 1 + length(id), n % 5 <> 0 FROM said JOIN texts USING (doc_id)
 UNION ALL SELECT said.doc_id, n, 'instructor', CASE WHEN n % 3 = 0 THEN 'Teacher Q' ELSE lower(name) END, CASE WHEN n % 5 <> 0 AND n % 3 <> 0 THEN strpos(text, name) - 1 END, strpos(text, name) - 1 + length(name), n % 5 <> 0 FROM said JOIN texts USING (doc_id)
 UNION ALL SELECT said.doc_id, n, 'points', points || '.0', CASE WHEN n % 5 <> 0 THEN strpos(text, name || ',') + length(name) + 1 END, strpos(text, name || ',') + length(name) + 1 + length(points || ' points'), n % 5 <> 0 FROM said JOIN texts USING (doc_id))
SELECT doc_id, section, field, value, start IS NOT NULL AS verified, start::int AS start, CASE WHEN start IS NOT NULL THEN stop::int END AS stop, tied AS identity_associated FROM asked""")
def _(spark, d):
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("l_suppkey"))
    n = F.col("n")
    said = lines.select(
        "doc_id", "n", F.concat_ws(" ", F.element_at(F.array(F.lit("Fall"), F.lit("Spring"), F.lit("Summer")), (n % 3 + 1).cast("int")), (2020 + n).cast("string")).alias("term"),
        F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("/"), (10_000 + F.col("l_suppkey")).cast("string")).alias("id"),
        F.concat(F.lit("Teacher "), F.chr((64 + n).cast("int")), F.lit(" "), letters(F.col("l_suppkey"))).alias("name"), (n % 4 + 1).cast("string").alias("points"))
    line = F.concat("term", F.lit(" section\n "), "id", F.lit(" by "), "name", F.lit(", "), "points", F.lit("  points"))
    texts = said.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("s")))).alias("l"))
    texts = texts.select("doc_id", F.concat(F.lit("Outline of "), letters(F.col("doc_id")), F.lit(". "), F.array_join(F.transform("l", lambda x: x["s"]), "; ")).alias("text"))
    claim = lambda field, value: F.struct(n.cast("long").alias("section"), F.lit(field).alias("field"), value.alias("value"))
    made = F.array(
        claim("term", F.when(n % 5 == 0, "Winter 1999").otherwise(F.col("term"))), claim("section_id", F.col("id")),
        claim("instructor", F.when(n % 3 == 0, "Teacher Q").otherwise(F.lower("name"))), claim("points", F.concat("points", F.lit(".0"))))
    claims = said.select("doc_id", F.explode(made).alias("c")).select("doc_id", "c.*")
    title = texts.select("doc_id", F.lit(None).cast("long").alias("section"), F.lit("title").alias("field"), F.upper(F.concat(F.lit("Outline of "), letters(F.col("doc_id")))).alias("value"))
    return evidence.bundle(texts, claims.union(title)).drop("quote")


# Texts for an answer

@query("course_context", """, s AS (SELECT course_uid, l_orderkey, l_linenumber, l_suppkey, '  ' || term || ', Section ' || section_id || ': ' || CASE WHEN times = '' THEN 'TBA' ELSE times END || ', ' || instructor || ', TBA, ' || current_n || '/' || capacity_n AS line,
 row_number() OVER (PARTITION BY course_uid ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM section),
l AS (SELECT course_uid, string_agg(line, chr(10) ORDER BY n) FILTER (n <= 4) AS shown, count(*) AS held FROM s GROUP BY 1)
SELECT c.course_uid, md5('[' || course_code || ']' || CASE WHEN p_partkey % 2 = 0 THEN ' [S' || p_partkey % 9 || ']' ELSE '' END || ' ' || title || ' | 3 points' || chr(10) || '  Prereqs: none'
 || CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE chr(10) || '  Desc: ' || substr(trim(description), 1, 500) || CASE WHEN length(trim(description)) > 500 THEN '...' ELSE '' END END
 || chr(10) || coalesce(shown || CASE WHEN held > 4 THEN chr(10) || '  (+' || (held - 4) || ' more matching sections)' ELSE '' END, '  No matching sections')) AS text FROM course c LEFT JOIN l ON l.course_uid = c.course_uid""", True)
def _(spark, d):
    c = projection.details(spark, d)
    listed = F.transform("sections", lambda s: F.struct(s["term"].alias("term"), s["section_call_number"].alias("section_id"), s["times"].alias("times"), s["instructor"].alias("instructor"), s["location"].alias("location"), s["enrollment_current"].alias("enrollment_current"), s["enrollment_capacity"].alias("enrollment_capacity")))
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), (F.col("p_partkey") % 9).cast("string")))
    made = context.course_context(F.col("course_code"), F.col("title"), F.lit("3 points"), F.lit("none"), F.col("description"), listed, label)
    return c.select("course_uid", F.md5(made).alias("text"))


@query("prompt_context", """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 GROUP BY 1""")
def _(spark, d):
    return context.prompt_context(read(spark, d, "conversations"), "conv_id", "turn", "text", 3)


@query("notices", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '_' || CASE p_partkey % 3 WHEN 0 THEN 'Showing ' || p_size || ' results; more match.' WHEN 1 THEN p_size || ' résultats affichés ; il y en a d''autres.' ELSE 'Showing ' || p_size || ' results; more match.' END || '_' ELSE '' END
 || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || chr(10) || '_' || CASE p_partkey % 3 WHEN 1 THEN 'Les mathématiques sont ici les mathématiques appliquées.' ELSE 'Mathematics is taken as applied mathematics here.' END || '_' ELSE '' END AS notices FROM part""")
def _(spark, d):
    key = F.col("p_partkey")
    lang = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("pt")), (key % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", context.notices(key % 2 == 0, F.when(key % 5 == 0, "mathematics"), lang, F.col("p_size")).alias("notices"))


@query("description_in", r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Intro' || chr(10) || 'Course  Description: ' || text WHEN 1 THEN 'Syllabus' || chr(13) || chr(10) || text WHEN 2 THEN left(text, 60) ELSE text END AS raw FROM documents),
n AS (SELECT doc_id, regexp_replace(raw, '\r\n?', chr(10), 'g') AS t FROM t),
m AS (SELECT doc_id, t, trim(regexp_replace(regexp_extract(t, '(?is)(?:course\s+description|description)\s*[:：]?\s*(.{80,1000}?.{0,1000}?)(?:\n\s*\n|\z)', 1), '[\s\x{a0}]+', ' ', 'g')) AS a,
 trim(regexp_replace(regexp_extract(t, '(?is)(?:module|topics?|outline|syllabus)\s*[:：]?\s*(.{80,1000}?.{0,1000}?)(?:\n\s*\n|\z)', 1), '[\s\x{a0}]+', ' ', 'g')) AS b, trim(regexp_replace(t, '[\s\x{a0}]+', ' ', 'g')) AS w FROM n)
SELECT doc_id, md5(substr(CASE WHEN length(a) >= 20 THEN a WHEN length(b) >= 20 THEN b WHEN length(w) >= 120 THEN w ELSE '' END, 1, 1200)) AS description FROM m""")
def _(spark, d):
    key = F.col("doc_id") % 4
    raw = F.when(key == 0, F.concat(F.lit("Intro\nCourse  Description: "), "text")).when(key == 1, F.concat(F.lit("Syllabus\r\n"), "text")).when(key == 2, F.left("text", F.lit(60))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(text.description_in(raw)).alias("description"))
