from pyspark.sql import functions as F

from lectern.operators import records
from lectern.streaming import conversation, rate


def test_records(spark):
    rows = spark.createDataFrame([("coms-w4111", "Databases", "3", None, None, "", "x")], "course_code string, title string, points_raw string, points_min double, points_max double, description string, prerequisites_text string")
    r = records.completed(rows, "2025").first()
    assert (r["course_code"], r["points_min"], r["points_max"], r["department_or_group"], r["description_source"], r["prerequisites_source"]) == ("COMS W4111", 3.0, 3.0, "COMS", "none", "imported")
    assert rows.select(records.missing_fields(rows)).first()[0] == ["description"]
    got = spark.createDataFrame([("k", 1, "Fall 2025"), ("k", 2, ""), ("k", 3, None), ("j", 1, "")], "k string, n int, term string")
    assert [r["term"] for r in records.filled_down(got, "k", "n", "term").orderBy("k", "n").collect()] == [None, "Fall 2025", "Fall 2025", "Fall 2025"]
    one = spark.createDataFrame([(["COMS W1", "COMS W2"], ["A B", "C D"], {"term": "x", "bad": "y"})], "a array<string>, b array<string>, m map<string,string>")
    assert one.select(records.single_department(F.col("a")), records.single_department(F.col("b")), records.allowed(F.col("m"))).first()[0:3] == ("COMS", None, {"term": "x"})


def test_turns_commit_after_done():
    state = ([], None)
    for kind, text in [("question", "q1"), ("chunk", "a"), ("fallback", ""), ("chunk", "b"), ("done", ""), ("question", "q2"), ("chunk", "x"), ("error", ""), ("done", "")]:
        state = conversation.advance(*state, kind, text, 10, 100)
    assert state == ([("q1", "b")], None)
    assert conversation.trimmed([("a", "b"), ("cc", "dd"), ("e", "f")], 10, 6) == [("cc", "dd"), ("e", "f")]


def test_rate_stream_matches_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("k", i * 1_000_000) for i in (0, 1, 2, 9, 10, 11, 12)]
    spark.createDataFrame(rows, "key string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate.admitted_stream(spark.readStream.schema("key string, at long").parquet(str(tmp_path / "in")), seconds=10, limit=3)
    run = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["admitted"] for r in spark.table("admitted").orderBy("at").collect()] == [True, True, True, False, True, True, True]


def test_store_pointer_is_replaced_and_guarded(spark, tmp_path):
    import pytest

    from lectern.sources.store import Store

    store = Store(spark, str(tmp_path / "s"), "k")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    first = store.commit(rows("a"))
    second = store.commit(rows("a", "b"))
    assert store.current() == second and {r["k"] for r in store.read().collect()} == {"a", "b"}

    def meanwhile(written):
        Store(spark, str(tmp_path / "s"), "k").commit(rows("x"))

    with pytest.raises(RuntimeError):
        store.commit(rows("c"), check=meanwhile)
    assert {r["k"] for r in store.read().collect()} == {"x"} and first != second


def test_registry_keeps_the_last_line(spark, tmp_path):
    from lectern.operators.crawl import save_registry
    from lectern.sources.readers import registry

    lines = [{"dedup_key": "b", "seen_count": 9, "last_seen_at": "2026"}, {"dedup_key": "a", "seen_count": 1, "last_seen_at": "2025"}, {"dedup_key": "b", "seen_count": 2, "last_seen_at": "2024"}]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(__import__("json").dumps(x) for x in lines) + "\nnot json\n")
    got = registry(spark, str(path))
    assert {r["dedup_key"]: r["seen_count"] for r in got.collect()} == {"a": 1, "b": 2}
    save_registry(got, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/keys")).collect()] == ["a", "b"]


def test_rebuilt_index_needs_every_row(spark):
    import pytest

    from lectern.operators.repair import rebuilt

    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "course_uid string, n int, other string")
    fixed = spark.createDataFrame([("a", 5)], "course_uid string, n int")
    with pytest.raises(Exception, match="no repaired row of b"):
        rebuilt(rows, fixed, ["n"]).collect()
    assert {tuple(r) for r in rebuilt(rows, fixed.union(fixed.withColumn("course_uid", __import__("pyspark").sql.functions.lit("b"))), ["n"]).collect()} == {("a", 5, "x"), ("b", 5, "y")}


def test_snapshot_order_of_equal_codes_and_titles(spark):
    from lectern.operators.crawl import snapshot_order

    rows = [(f"{i * 7919 % 1000:03d}", "A 1", "T") for i in range(1000)]
    # An order given before isn't kept by a sort of all rows.
    got = snapshot_order(spark.createDataFrame(rows, "course_uid string, course_code string, title string").repartition(7)).limit(30)
    assert [r["course_uid"] for r in got.collect()] == [f"{i:03d}" for i in range(30)]


def test_snapshot_places_of_all_courses(spark):
    from __spark_entry__ import queries
    from lectern.operators.crawl import snapshot_places

    rows = [(f"{i * 7919 % 1000:03d}", None if i % 3 == 0 else "" if i % 3 == 1 else f"A {i % 7}", None if i % 5 == 0 else f"T {i % 4}") for i in range(1000)]
    got = snapshot_places(spark.createDataFrame(rows, "course_uid string, course_code string, title string").repartition(7))
    wanted = sorted(rows, key=lambda r: (r[1] or "", r[2] or "", r[0]))
    assert {r["course_uid"]: r["place"] for r in got.collect()} == {r[0]: i + 1 for i, r in enumerate(wanted)}
    # The query places every course, not the first thirty.
    d = "/root/testdata/sf0.001"
    assert queries()["snapshot_order"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count() > 30
