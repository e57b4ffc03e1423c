"""Streams run as streams: restarts, cuts anywhere, rows out of order, timers and state that runs out."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import payloads
from lectern.streaming import chat, sessions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BASE = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def event(kind, **more):
    return "data: " + json.dumps({"type": kind, **more}, ensure_ascii=False) + random.choice(["\n\n", "\r\n\r\n"])


def reply(text):
    return event("meta", provider="one", fallback_available=False) + event("chunk", content=text) + event("sources") + event("done", provider="one", fallback_used=False, fallback_reason=None)


def pieces(spark, rows):
    return spark.createDataFrame([(c, s, float(BASE + at), k, d.encode() if isinstance(d, str) else d) for c, s, at, k, d in rows], "conv_id long, seq long, at double, kind string, data binary").withColumn("at", F.col("at").cast("timestamp"))


class Fed:
    """A stream fed file by file, with its results in Parquet."""

    def __init__(self, spark, folder, **settings):
        self.spark, self.folder, self.settings, self.n = spark, folder, settings, 0

    def feed(self, df):
        self.n += 1
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, build=chat.chat_stream, kind=chat.INPUT, once=False):
        """All there is; on the machine's clock a stream has always something to wait for, so it runs ``once``."""
        source = self.spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        q = build(source, **self.settings).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/check").outputMode("append").trigger(**({"once": True} if once else {"availableNow": True})).start()
        assert q.awaitTermination(120)
        return self

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()), key=repr)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    """The log of real conversations, cut into five files amid the replies; the stream stops after each and goes on from its checkpoint."""
    log = chat.chat_log(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12"), piece=211).cache()
    fed = Fed(spark, str(tmp_path))
    bounds = [BASE + x for x in (0.02, 0.05, 1200.01, 1200.06, 1e9)]
    for k, (low, high) in enumerate(zip([0, *bounds], bounds, strict=False)):
        at = F.col("at").cast("double")
        fed.feed(log.where((at > low) & (at <= high)).orderBy(F.rand(k)))
        fed.run()
    want = sorted((tuple(r) for r in chat.replayed(log).collect()), key=repr)
    assert {r[2] for r in want} == {"commit", "error", "early end", "timeout"}
    # The watermark may end a turn before the row that would; whatever else happens is the same.
    strip = lambda rows: sorted((r[0], *r[2:]) for r in rows if r[2] != "forgotten")
    assert strip(fed.rows()) == strip(want)


def test_any_cut_and_any_order(spark):
    """Bytes of one turn cut at every place, one by one, and given out of order or twice, give one commit."""
    text = "Zé日😀 <b>"
    wire = reply(text).encode()
    logs = []
    for cut in range(1, len(wire)):
        logs.append([(cut, 0, 0, "question", "q"), (cut, 1, 1, "bytes", wire[:cut]), (cut, 2, 2, "bytes", wire[cut:]), (cut, 3, 3, "close", None)])
    logs.append([(0, 0, 0, "question", "q"), *((0, 1 + i, 1, "bytes", wire[i : i + 1]) for i in range(len(wire))), (0, 1 + len(wire), 2, "close", None)])
    rows = [r for log in logs for r in log] + logs[3][:2]
    random.Random(1).shuffle(rows)
    got = chat.replayed(pieces(spark, rows)).collect()
    assert len(got) == len(logs) and {(r["outcome"], r["question"], r["answer"], r["turns"]) for r in got} == {("commit", "q", text, 1)}


def test_rows_out_of_order_between_batches(spark, tmp_path):
    fed = Fed(spark, str(tmp_path), late="1 hour")
    wire = reply("answer").encode()
    fed.feed(pieces(spark, [(1, 2, 2, "bytes", wire[20:]), (2, 0, 0, "question", "other")]))
    fed.run()
    fed.feed(pieces(spark, [(1, 1, 1, "bytes", wire[:20]), (2, 0, 0, "question", "again")]))
    fed.run()
    assert fed.rows() == []
    fed.feed(pieces(spark, [(1, 0, 0, "question", "q")]))
    fed.run()
    assert [(r[0], r[2], r[4], r[5], r[6]) for r in fed.rows()] == [(1, "commit", "q", "answer", 1)]


def test_time_limits_by_timer(spark, tmp_path):
    """No first event, silence after one, and an idle conversation; one with an open turn stays."""
    fed = Fed(spark, str(tmp_path), first=70, idle=70, keep=1000)
    start = event("meta", provider="one", fallback_available=False) + event("chunk", content="part")
    fed.feed(pieces(spark, [(1, 0, 0, "question", "a"), (2, 0, 0, "question", "b"), (2, 1, 60, "bytes", start), (3, 0, 0, "question", "c"), (3, 1, 1, "bytes", reply("fine"))]))
    fed.run()
    clock = lambda at: pieces(spark, [(99, 0, at, "close", None)])  # noqa: E731  another key moves the watermark
    fed.feed(clock(100))
    fed.run().run()
    got = {(r[0], r[2], r[3]): r for r in fed.rows()}
    assert set(got) == {(3, "commit", ""), (1, "timeout", "no first event in time")}
    fed.feed(pieces(spark, [(99, 1, 140, "close", None), (4, 0, 140, "question", "d")]))
    fed.run().run()
    assert {(r[0], r[2], r[3], r[5]) for r in fed.rows()} >= {(2, "timeout", "no event in time", "part")}
    # 3 has been idle since 1, 2 since its time-out; 4 is open and only times out.
    fed.feed(pieces(spark, [(99, 2, 1180, "close", None)]))
    fed.run().run()
    out = {(r[0], r[2]): r[6] for r in fed.rows()}
    assert out[3, "forgotten"] == 1 and (1, "forgotten") in out and (4, "timeout") in out and (4, "forgotten") not in out and (2, "forgotten") in out
    # Its history is gone: the next turn is its first again.
    fed.feed(pieces(spark, [(3, 2, 1200, "question", "more"), (3, 3, 1201, "bytes", reply("again"))]))
    fed.run()
    assert [r[6] for r in fed.rows() if r[0] == 3 and r[2] == "commit"] == [1, 1]


def test_history_runs_out_by_ttl(spark, tmp_path):
    """On the machine's clock Spark drops a history after its time to live."""
    fed = Fed(spark, str(tmp_path), clock="processingTime", keep=6)
    turn = lambda n: pieces(spark, [(1, 2 * n, 0, "question", f"q{n}"), (1, 2 * n + 1, 0, "bytes", reply("a"))])
    for n in range(2):
        fed.feed(turn(n))
    fed.run(once=True)
    assert max(r[6] for r in fed.rows()) == 2
    time.sleep(7)
    fed.feed(turn(2))
    fed.run(once=True)
    assert [r[6] for r in fed.rows() if r[4] == "q2"] == [1]


@pytest.mark.parametrize(("body", "outcome", "detail"), [
    ("data: oops\n\n", "problem", "malformed event"), ("data:\n\n", "problem", "empty event"), ("data: [1]\n\n", "problem", "event without a type"), (": comment\n\n" + reply("x"), "commit", ""),
    (event("chunk", content="x"), "problem", "chunk out of order"), (event("meta", provider="a") + event("meta", provider="a"), "problem", "meta out of order"),
    (event("meta", provider="a") + event("sources"), "problem", "sources out of order"), (event("meta", provider="a") + event("chunk", content=""), "problem", "chunk without text"),
    (event("meta", provider="a") + event("chunk", content="x") + event("fallback", **{"from": "a", "to": "b"}), "problem", "fallback out of order"),
    (event("meta", provider="a") + event("chunk", content="x") + event("sources") + event("done", provider="b", fallback_used=False, fallback_reason=None), "problem", "done contradicts the reply"),
    (event("meta", provider="a") + event("error", message="m", provider="b"), "problem", "error contradicts the reply"), (event("error", message="m"), "error", "m"), (event("odd"), "problem", "unknown event odd"),
    (reply("x")[:-3], "commit", ""), (event("meta", provider="a"), "early end", ""), ("", "early end", ""), ("data: {\"type\":\ndata: \"error\", \"message\": \"two lines\"}\n\n", "error", "two lines"),
])
def test_protocol(body, outcome, detail):
    state, limits = chat.ChatState(), chat.Limits(10, 12_000, 70_000, 70_000, None)
    ends = [*state.take("question", b"q", 0, limits), *state.take("bytes", body.encode(), 0, limits), *state.take("close", None, 0, limits), *state.take("bytes", b"late", 0, limits)]
    assert [e[:2] for e in ends] == [(outcome, detail)] and not state.open


def test_thoughts_for_every_cut():
    rng = random.Random(2)
    texts = ["a<think>b</think>c", "<think>", "<THINK>x</Think>y<think>z", "<thi", "<<think>>a</think", "</think>a<think></think>b", "a<think>b<think>c</think>d</think>e", "日<think>é</think>😀<"]
    texts += ["".join(rng.choices(["<think>", "</think>", "<", "th", "</", "a", "K", ">"], k=rng.randrange(12))) for _ in range(200)]
    for text in texts:
        want = re.sub(r"<think>.*?(</think>|$)", "", text, flags=re.S | re.I)
        for cut in range(len(text) + 1):
            f = chat.ThoughtFilter()
            assert f.push(text[:cut]) + f.push(text[cut:]) + f.push("", final=True) == want
        f = chat.ThoughtFilter()
        assert "".join(map(f.push, text)) + f.push("", final=True) == want


def test_cached_checks(spark, tmp_path):
    rows = [("k", i, at, ok, force) for i, (at, ok, force) in enumerate([(0, True, False), (29, False, False), (30, False, False), (31, True, False), (40, True, True), (69, False, False), (70, False, False)])]
    asked = spark.createDataFrame([*rows, ("j", 9, 5, False, False)], "key string, id long, at long, ok boolean, force boolean").withColumn("at", F.timestamp_seconds("at"))
    got = {r["id"]: (r["available"], r["probed"]) for r in sessions.cached_checks(asked, "key", "at", "id", "ok", 30, "force").collect()}
    assert got == {0: (True, True), 1: (True, False), 2: (False, True), 3: (False, False), 4: (True, True), 5: (True, False), 6: (False, True), 9: (False, True)}
    fed = Fed(spark, str(tmp_path), keep=4)
    kind = "key string, id long, ok boolean, force boolean"
    build = sessions.checks_stream
    fed.feed(spark.createDataFrame([("k", 1, True, False)], kind))
    fed.run(build, kind, once=True)
    fed.feed(spark.createDataFrame([("k", 2, False, True)], kind))
    fed.run(build, kind, once=True)
    time.sleep(5)
    fed.feed(spark.createDataFrame([("k", 3, True, False)], kind))
    fed.run(build, kind, once=True)
    assert fed.rows() == [("k", 1, True, True), ("k", 2, False, True), ("k", 3, True, True)]


@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_evicted(spark, most):
    rng = random.Random(most)
    for _ in range(3):
        rows = [(i, rng.randrange(6), rng.random() < 0.1) for i in range(30)]
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        want = []
        for r in order[: max(0, len(order) - most)]:
            if r[2]:
                break
            want.append(r[0])
        assert sorted(r["k"] for r in sessions.evicted(spark.createDataFrame(rows, "k long, used long, active boolean"), "k", "used", "active", most).collect()) == sorted(want)


def test_source_payloads(spark):
    offering = {"term": None, "section_id": "1", "meeting_time": None, "location": None}
    source = {"uid": "u", "course_code": "C", "title": "t", "citation_label": "S1", "source_label": "x", "citation_status": "verified", "offerings": [offering]}
    good = {"type": "sources", "schema_version": 2, "courses": ["C"], "answer_sources": [{**source, "role": "answer_source"}], "prompt_basis": [{**source, "role": "prompt_basis", "citation_status": "candidate"}]}
    change = lambda part, **more: {**good, part: [{**good[part][0], **more}]}
    cases = [
        (good, None), ({**good, "courses": ["D"]}, "courses: differ from answer_sources"), ({**good, "courses": "C"}, "courses: not a list of names"), ({**good, "schema_version": 1}, "sources without schema_version 2"),
        (change("answer_sources", role="prompt_basis"), "answer_sources: broken source"), (change("answer_sources", citation_status="candidate"), "answer_sources: broken source"),
        (change("answer_sources", title="other"), "answer_sources: differs from prompt_basis"), (change("answer_sources", uid="v"), "answer_sources: not in prompt_basis"),
        (change("prompt_basis", citation_label="S2"), "prompt_basis: labels not in order"), (change("prompt_basis", title=" "), "prompt_basis: broken source"),
        ({**good, "answer_sources": good["answer_sources"] * 2}, "sources: repeated uid"), ({**good, "prompt_basis": None}, "prompt_basis: broken source"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, p string")
    assert [r[0] for r in df.select("i", payloads.event_violation(F.col("p")).alias("v")).orderBy("i").select("v").collect()] == [w for _, w in cases]
