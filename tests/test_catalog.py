"""Functions and operators of the catalogue engine on fixed cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import codes, credits, prerequisites, schedule, suitability, text, web
from lectern.operators import answers, catalog, conversation, importing, overlays, repair, retrieval
from lectern.plans import intent, projection
from lectern.sources.store import Store, upsert
from lectern.streaming import protocol, rate


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_codes(spark):
    good = ["COMS W4111", "coms-w4111", "COMS_W4111", "COMSW4111", "psam-un3707", "PSAMUN3707", "BINFGU4001", "EESC_GR5400", "MATH V2010"]
    bad = ["", "A W1234", "ABCDE W1234", "COMS ZZ4111", "COMS W411", "COMS 4111", "COMS W41111", "not a course", None]
    assert column(spark, good, codes.normalize_code) == ["COMS W4111"] * 4 + ["PSAM UN3707"] * 2 + ["BINF GU4001", "EESC GR5400", "MATH V2010"]
    assert column(spark, bad, codes.normalize_code) == [None] * len(bad)
    line = "Compare psam-un3707, BINF GU4001, and EESCGR5400. PSAM UN3707 is repeated."
    assert column(spark, [line], codes.extract_codes) == [["PSAM UN3707", "BINF GU4001", "EESC GR5400"]]
    assert len(column(spark, [line], lambda c: codes.extract_codes(c, distinct=False))[0]) == 4
    assert column(spark, ["MATH V2010", "COMS W4111"], codes.is_current_level) == [False, True]
    assert column(spark, ["COMS W4111", "", None], codes.level) == [4111, 9999, 9999]


def test_credit_constraints(spark):
    cases = {
        "3.5 credits": (3.5, 3.5), "2-4 credits": (2, 4), "between 2 and 4 credits": (2, 4), "at least 3 credits": (3, None), "at most 4 credits": (None, 4),
        "3 credits or more": (3, None), "4 credits or less": (None, 4), "3.5学分": (3.5, 3.5), "2到4学分": (2, 4), "至少3学分": (3, None), "不超过4学分": (None, 4),
        "3,5 créditos": (3.5, 3.5), "entre 2 y 4 créditos": (2, 4), "al menos 3 créditos": (3, None), "como máximo 4 créditos": (None, 4),
        "entre 2 et 4 crédits": (2, 4), "au moins 3 crédits": (3, None), "nothing": None, "": None, "at least 5 and at most 3 credits": None, "1 to 2": (1, 2),
    }
    got = column(spark, list(cases), credits.credit_constraint)
    assert [tuple(g) if g else None for g in got] == list(cases.values())
    assert [tuple(v) if v else None for v in column(spark, ["3", "1-3 points", "3.00", "31", "4-2", "x3", "", None], credits.points_value)] == [(3, 3), (1, 3), (3, 3), None, None, None, None, None]
    assert [tuple(v) for v in column(spark, ["10/20", "7", "", "a", "200000"], credits.enrollment_value)] == [(True, 10, 20), (True, 7, None), (True, None, None), (False, None, None), (False, None, None)]


def test_schedule(spark):
    times = ["M W 10:10am - 11:25am", "F Sa S 9:00am - 5:00pm", "Imelda Quarrie", "TBA", "", "T 13:10pm - 2:25pm", "Th 6:10pm - 8:00pm Smith"]
    assert column(spark, times, schedule.meeting_days) == [["Monday", "Wednesday"], ["Friday", "Saturday", "Sunday"], [], [], [], ["Tuesday"], ["Thursday"]]
    assert column(spark, times, schedule.is_schedule) == [True, True, False, True, True, False, False]
    assert column(spark, times[:2] + ["T 1:10pm", "W 6:10pm", ""], schedule.time_of_day) == ["morning", "morning", "afternoon", "evening", ""]


def test_prerequisites(spark):
    cases = {
        "": ("UNKNOWN", "UNKNOWN", None), "No prerequisites listed": ("UNKNOWN", "UNKNOWN", None), "None.": ("EXPLICIT_NONE", "UNKNOWN", 0), "无先修要求": ("EXPLICIT_NONE", "UNKNOWN", 0),
        "COMS W3134": ("LISTED", "AND", 1), "COMS W3134 and MATH UN1201": ("LISTED", "AND", 2), "COMS W3134 or MATH UN1201": ("LISTED", "OR", 1),
        "COMS W3134, MATH UN1201, and APMA E2000": ("LISTED", "AND", 3), "(COMS W3134 or COMS W3137) and MATH UN1201": ("LISTED", "MIXED", 2),
        "COMS W3134 and (MATH UN1201 or (APMA E2000 and APMA E3000))": ("LISTED", "MIXED", 2), "COMS W3134, MATH UN1201": ("LISTED", "UNKNOWN", None),
        "Recommended: COMS W3134 or COMS W3137.": ("LISTED", "OR", 0), "Permission of the instructor.": ("LISTED", "UNKNOWN", None), "COMS W3134 and": ("LISTED", "AND", 1),
    }
    got = column(spark, list(cases), prerequisites.parse_prerequisites)
    assert [(g["status"], g["relationship"], g["min_count"]) for g in got] == list(cases.values())


def test_suitability(spark):
    rows = [
        ("COMS W1004", "Intro", "Assumes no prior programming experience. More.", ""), ("COMS W1004", "x", "", "None"), ("COMS W1004", "x", "Designed for beginners.", "COMS W3134"),
        ("COMS W1004", "x", "", "COMS W3134"), ("COMS W4111", "Databases", "", ""), ("COMS W1004", "Advanced things", "", ""), ("COMS W1004", "x", "", ""),
    ]
    df = spark.createDataFrame(rows, "c string, t string, d string, p string").withColumn("q", prerequisites.parse_prerequisites(F.col("p")))
    got = [r[0] for r in df.select(suitability.beginner_suitability(*(F.col(x) for x in "ctd"), F.col("q"), F.col("p"))).collect()]
    assert [g["status"] for g in got] == ["positive", "positive", "positive", "negative", "negative", "negative", "unknown"]
    assert got[0]["evidence"] == "assumes no prior programming experience."


def test_text(spark):
    assert column(spark, [" a  b\n", None], text.squash) == ["a b", ""]
    assert column(spark, ["Crédits ÀÉ"], text.fold) == ["credits ae"]
    assert column(spark, ["cs课", "xcs"], lambda c: text.contains_alias(c, "cs")) == [True, False]
    assert column(spark, ['{"a":1}', 'x ```json\n{"b":2}\n``` y', "<think>{no}</think> {\"c\":3} z", "none"], text.embedded_json) == ['{"a":1}', '{"b":2}', '{"c":3}', None]
    spans = spark.createDataFrame([("Aba abA", "aba")], "t string, n string").select(text.spans_of(F.col("t"), F.col("n"))).first()[0]
    assert [tuple(s) for s in spans] == [(0, 3), (4, 7)]


def test_web(spark):
    assert column(spark, ["HTTP://A.b//x/y?q=1#f", "//A.b"], web.canonical_url) == ["HTTP://a.b/x/y/?q=1", "https://a.b/"]
    assert column(spark, ["<nav>no</nav><p>a &amp; b</p><script>x</script>"], web.visible_text) == ["a & b"]
    scope = column(spark, ["https://h/a/x/", "https://h/a/x.pdf", "https://o/a/", "https://h/b/", "https://h/a/no/"], lambda c: web.in_scope(c, "h", ("/a/",), ("/a/no/",)))
    assert scope == [True, False, False, False, False]
    assert column(spark, ["x.html", "/y", "//o/z", "https://q/"], lambda c: web.absolute(c, F.lit("https://h/a/b.html"))) == ["https://h/a/x.html", "https://h/y", "https://o/z", "https://q/"]


@pytest.fixture(scope="module")
def small_index(spark):
    section = lambda t, n, times, who, pts: (t, n, times, "", who, pts, "", None, None)
    rows = [
        ("u1", "COMS W1004", "Intro", 3.0, 3.0, "text", [section("Spring 2026", "001", "M W 10:10am - 11:25am", "Ada Lovelace", "3"), section("Fall 2025", "001", "T Th 1:10pm - 2:25pm", "Alan Turing", "4")], False),
        ("u2", "COMS W4111", "Databases", 3.0, 3.0, "", [section("Spring 2026", "002", "Imelda Quarrie", "", "3")], False),
        ("u3", "COMS W4111", "Databases II", 2.0, 4.0, None, None, False), ("u4", "MECE E9000", "Research topics", 0.0, 0.0, "x", [], True),
    ]
    schema = f"course_uid string, course_code string, title string, points_min double, points_max double, description string, sections array<{catalog.SECTION}>, needs_review boolean"
    df = spark.createDataFrame(rows, schema).withColumns({"prerequisites_text": F.lit(""), "course_review_warnings": F.lit(None).cast("array<string>"), "parse_warnings": F.lit(None).cast("array<string>")})
    return catalog.enrich(df, {"COMS": "computer science"}).cache()


def uids(df):
    return [r["course_uid"] for r in df.collect()]


def test_same_section_semantics(small_index):
    find = lambda **f: sorted(uids(retrieval.stage1(small_index, retrieval.Filters(**f))))
    assert find(term="spring 2026", days=("Monday",)) == ["u1"]
    assert find(term="Spring 2026", time_of_day="afternoon") == []
    assert find(term="Fall 2025", instructor="lovelace") == [] and find(instructor="turing alan") == ["u1"]
    assert find(term="Spring 2026", points_min=4) == [] and find(points_min=4) == ["u1", "u3"]
    assert find(course_codes=("coms w4111",)) == ["u2", "u3"] and find() == ["u1", "u2", "u3"]
    rows = {r["course_uid"]: r["matched_sections"] for r in retrieval.stage1(small_index, retrieval.Filters(points_min=3)).collect()}
    assert rows["u3"] is None and len(rows["u1"]) == 2


def test_ranking(small_index):
    assert uids(retrieval.keyword_topk(small_index, ["databases"], 5)) == ["u2", "u3"]
    assert uids(retrieval.keyword_topk(small_index, [])) == uids(retrieval.quality_sort(small_index)) == ["u1", "u2", "u3"]
    assert uids(retrieval.distinct_code_first(small_index, ["course_uid"], 3).orderBy("place")) == ["u1", "u2", "u4"]
    assert uids(retrieval.distinct_code_first(small_index, ["course_uid"], 0)) == []


def test_overlays(spark):
    log = spark.createDataFrame([("a", 1, 1, "v1", "x"), ("a", 2, 1, "v0", "y"), ("a", 2, 1, "v3", "z"), ("b", 1, 1, "v9", None)], "k string, created_at_ns long, revision int, version_id string, p string")
    for rows in (log, log.orderBy(F.desc("version_id")).repartition(3)):
        assert {r["k"]: r["p"] for r in overlays.latest_wins(rows, ["k"]).collect()} == {"a": "z", "b": None}
    base = spark.createDataFrame([("c", "old", "keep")], "course_uid string, title string, notes string")
    over = spark.createDataFrame([("c", {"title": ""}, 1, 1, "v")], "course_uid string, payload map<string,string>, created_at_ns long, revision int, version_id string")
    assert overlays.merge_fields(base, over, ["title", "notes"]).first()[1:] == ("", "keep")
    o = spark.createDataFrame([("v1", ["u1", "gone"], "X"), ("v2", ["gone"], "COMS W1")], "version_id string, seed_course_uids array<string>, course_code string")
    c = spark.createDataFrame([("u1", "Y"), ("u2", "COMS W1"), ("u3", "COMS W1")], "course_uid string, course_code string")
    assert sorted(map(tuple, overlays.bind(o, c).collect())) == [("u1", "v1"), ("u2", "v2"), ("u3", "v2")]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "id", most_rows=3)
    rows = lambda *x: spark.createDataFrame(x, "id string, status string")
    assert store.read() is None
    first = store.append(rows(("a", "review")))
    assert store.append(rows(("a", "published"))) is None and store.current() == first
    assert store.update("a", status="published") and store.update("a", status="published") is None
    now = store.current()
    for bad in (rows(("b", "x"), ("b", "y")), rows(*((str(i), "x") for i in range(5)))):
        with pytest.raises(ValueError):
            store.commit(bad)
    assert store.current() == now and [tuple(r) for r in store.read().collect()] == [("a", "published")]
    assert sorted(map(tuple, upsert(rows(("a", "1"), ("b", "1")), rows(("b", "2"), ("c", "2")), "id").collect())) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_import_gate(spark):
    df = spark.createDataFrame([("COMS W4111", "Databases", "d", 3.0), ("COMS W4111", "DB", "d", 3.0), ("COMS W4111", "Data base", "", 3.0), ("bad", "Databases", "d", 3.0)], "c string, t string, d string, p double")
    found = importing.import_issues(F.col("c"), F.col("t"), F.col("d"), F.lit(""), F.col("p"), ["COMS"])
    errors = importing.hard_errors(F.col("c"), F.col("t"), F.lit(""), F.col("p"), F.col("p"))
    assert [tuple(r) for r in df.select(found["score"], importing.gate(errors, found["score"], found["issues"])).collect()] == [(100, "published"), (70, "rejected"), (90, "review"), (60, "rejected")]


def test_conversation(spark):
    rows = spark.createDataFrame([("compare them", 2, False, False), ("the second one", 3, False, False), ("both courses", 1, True, True), ("COMS W4111", 3, True, False), ("its credits", 1, False, False), ("hello", 0, False, False), ("第二门课", 4, False, False)], "q string, n int, f boolean, a boolean")
    s = conversation.scope(F.col("q"), F.col("n"), F.col("f"), F.col("a"), F.lit(False))
    got = [r[0] for r in rows.select(s).collect()]
    assert [g["scope"] for g in got] == ["previous_results", "current_course", "previous_results", "new_search", "current_course", "new_search", "current_course"]
    assert got[1]["ordinal"] == 2 and got[2]["reference_count"] == 2 and got[6]["ordinal"] == 2


def test_intent_to_plan(spark):
    q = spark.createDataFrame([("Recommend robotics courses by Professor Ada Lovelace on Mondays, at least 3 credits, Fall 2025",)], "question string")
    plan = intent.plan_of(intent.parse(q).first()["intent"])
    assert plan.term == "Fall 2025" and plan.days == ("Monday",) and plan.instructor == "Ada Lovelace" and plan.points_min == 3 and plan.keywords == ("robotics",)


def test_streams(spark):
    events = spark.createDataFrame([("k", i * 1_000_000, i) for i in (0, 1, 2, 9, 10, 11, 12)], "key string, at long, id long")
    got = rate.admitted(events.withColumn("at", F.timestamp_micros("at")), ["key"], "at", "id", seconds=10, limit=3)
    assert [r["admitted"] for r in got.orderBy("id").collect()] == [True, True, True, False, True, True, True]
    chunks = spark.createDataFrame([("s", 0, 'data: {"type":"me'), ("s", 1, 'ta"}\r\n\r\ndata: {"type":"chunk","content":"x"}\n\n'), ("s", 2, 'data: {"type":"done"}\n\n'), ("t", 0, 'data: {"type":"error"}\n\n'), ("v", 0, "data: oops\n\n")], "k string, seq int, data string")
    decoded = protocol.decode(chunks, "k", "seq", "data")
    assert {r["k"]: r["problem"] for r in protocol.checked(decoded, "k", "pos", "type").collect()} == {"s": "done after chunk", "t": "", "v": "malformed after start"}


def test_citations_and_digest(spark):
    a = spark.createDataFrame([(1, "【S2】 then [s1] and COMS W4111 [S7]")], "answer_id int, text string")
    b = spark.createDataFrame([(1, "u1", "S1", "X"), (1, "u2", "S2", "X"), (1, "u3", "S3", "COMS W4111")], "answer_id int, uid string, label string, course_code string")
    assert [r["uid"] for r in answers.cited(a, b).orderBy("mention").collect()] == ["u2", "u1", "u3"]
    rows = spark.range(50).withColumn("x", F.col("id") * 2)
    same = repair.set_digest(rows.orderBy(F.desc("id")).repartition(5), ["x", "id"]).first()[0]
    assert repair.set_digest(rows, ["id", "x"]).first()[0] == same != repair.set_digest(rows.where("id > 0"), ["id", "x"]).first()[0]


def test_projection_slice(spark):
    rows = retrieval.stage1(catalog.enrich(projection.details(spark, "/root/testdata/sf0.001")), retrieval.Filters(department="SMAL", term="Spring 1998", days=("Monday", "Wednesday")))
    assert rows.count() > 0


def test_validated_as_one_by_one(spark):
    """Flat validation through different cells gives what the expression for one section does, nulls and odd cells included."""
    import itertools

    kind = "k int, term string, section_call_number string, times string, location string, instructor string, points string, enrollment_raw string, enrollment_current int, enrollment_capacity int"
    cells = [["Fall 2025", "", None, "fall  2025", "2025"], ["001", None], ["M W 10:10am - 11:25am", "Imelda Quarrie", "TBA", None, "T 13:10pm - 2:25pm"], ["Ada Lovelace", "3", "20/30", None], ["3.00", "", None, "40", "1-4"], ["20/30", "x", "", None, "7"]]
    made = [(*c[:3], " a  b ", *c[3:], n, m) for c in itertools.product(*cells) for n, m in [(20, 30), (None, None), (31, 30), (-1, 200_000)]][::7]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], kind)
    one = {r["k"]: r["s"] for r in rows.select("k", catalog.section_summary(F.struct(*[c for c in rows.columns if c != "k"])).alias("s")).collect()}
    assert {r["k"]: r["summary"] for r in catalog.validated(rows).collect()} == one and len(one) == len(made)
    nested = catalog.summaries(rows.withColumn("u", F.col("k") % 3), "u", ["k"]).collect()
    assert {r["u"]: len(r["checked"]) for r in nested} == {u: len(range(u, len(made), 3)) for u in range(3)} and nested[0]["checked"][0] == one[nested[0]["u"]]
    assert catalog.validated(rows.limit(0)).count() == 0


def test_sections_are_shuffled_once(spark, monkeypatch):
    """Validation shuffles no rows, however many cells differ; the index shuffles lines, before texts are made of them."""
    from lectern import queries

    rows = projection.sections(spark, "/root/testdata/sf0.001")
    want = {r["identity"]: r["summary"] for r in catalog.validated(rows.withColumn("identity", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_suppkey"))).collect()}
    monkeypatch.setattr(catalog, "BROADCAST_CELLS", 5)
    checked = catalog.validated(rows.localCheckpoint().withColumn("identity", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_suppkey")))
    assert {r["identity"]: r["summary"] for r in checked.collect()} == want
    assert "Exchange hashpartitioning" not in checked._jdf.queryExecution().executedPlan().toString()
    plan = queries.enriched(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1 and "Exchange hashpartitioning(course_uid" not in plan


def test_costly_rows_are_dealt_by_number(spark):
    """What is made of few bytes a row is dealt by the number of rows, not by the bytes of a file or shuffle."""
    from lectern import record_queries  # noqa: F401  registers its queries
    from lectern.queries import QUERIES

    for name in ("department_named", "question_english", "intent_validation", "citation_extract"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4, name
    plan = QUERIES["course_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1 and "Exchange hashpartitioning(course_uid" not in plan


def test_spans_of_a_phrase_that_fills_a_text(spark):
    """Time in proportion to little more than the occurrences: a text with 20,000 of them took over a minute."""
    import time

    from lectern.functions import text

    rows = spark.createDataFrame([(n, " The" * n) for n in (0, 1, 2, 3, 10, 99, 20_000)], "n int, t string")
    since = time.time()
    got = {r["n"]: r["s"] for r in rows.select("n", text.spans_of(F.col("t"), F.lit("tHE")).alias("s")).collect()}
    assert all([tuple(x) for x in s] == [(4 * i + 1, 4 * i + 4) for i in range(n)] for n, s in got.items())
    assert time.time() - since < 30
