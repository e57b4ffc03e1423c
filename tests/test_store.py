"""The store: writers at once, revisions, live refresh; digest trees that open what has changed only."""

import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import digests, overlays
from lectern.sources.store import LiveView, Moved, Store, live_refresh

KIND = "uid string, version_id string, created_at_ns long, status string"


def test_append_versions_continues_revisions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "version_id")
    rows = lambda *x: spark.createDataFrame([(*r, "published") for r in x], KIND)
    assert store.append_versions(rows(("a", "v2", 20), ("a", "v1", 10), ("b", "w1", 5), ("a", "v1", 10)), ["uid"])
    first = store.current()
    assert store.append_versions(rows(("a", "v1", 99)), ["uid"]) is None and store.current() == first
    store.append_versions(rows(("a", "v0", 1), ("a", "v2", 20), ("c", "x", 1)), ["uid"])
    assert {(r["uid"], r["version_id"], r["revision"], r["created_at_ns"]) for r in store.read().collect()} == {("a", "v1", 1, 10), ("a", "v2", 2, 20), ("a", "v0", 3, 1), ("b", "w1", 1, 5), ("c", "x", 1, 1)}
    assert store.read(first).count() == 3


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    """Four writers append three versions each to one identity; every commit is in, and revisions have no gap."""
    store = Store(spark, f"file://{tmp_path}/s", "version_id")
    failed = []

    def write(w):
        try:
            own = Store(spark, f"file://{tmp_path}/s", "version_id")
            for n in range(3):
                own.append_versions(spark.createDataFrame([("a", f"{w}-{n}", 10 * n + w, "review")], KIND), ["uid"], tries=40)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    writers = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not failed
    got = store.read().collect()
    assert {r["version_id"] for r in got} == {f"{w}-{n}" for w in range(4) for n in range(3)} and sorted(r["revision"] for r in got) == list(range(1, 13))


def test_a_commit_in_between_is_an_error_or_tried_again(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/s", "k") for _ in range(2))
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    store.commit(rows("a"))
    with pytest.raises(Moved):
        store.commit(rows("a", "x"), check=lambda _: other.append(rows("b")))
    calls = []

    def build(old):
        calls.append(old.count())
        if len(calls) == 1:
            other.append(rows("c"))
        return old.union(rows("d"))

    store.change(build)
    assert calls == [2, 3] and {r["k"] for r in store.read().collect()} == {"a", "b", "c", "d"}
    # A reader whose CURRENT lags behind still finds the end of the chain.
    (tmp_path / "s" / "CURRENT").unlink()
    assert store.current() == other.current() and other.read().count() == 4
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_")) == []


def test_live_refresh(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "uid")
    view = LiveView(store)
    assert view.get() is None
    kind, source, check = "uid string, n long", str(tmp_path / "in"), str(tmp_path / "c")

    def build(old, batch):
        if batch.where("n < 0").count():
            raise ValueError("a bad batch")
        rows = batch if old is None else old.unionByName(batch)
        return rows.groupBy("uid").agg(F.sum("n").alias("n"))

    def small(rows):
        if rows.where("n > 100").count():
            raise ValueError("too much")

    def run(folder=check):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        q = live_refresh(stream, store, "feed", build, small).option("checkpointLocation", folder).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.exception()

    put = lambda *rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    state = lambda: {r["uid"]: r["n"] for r in view.get().collect()}
    put(("a", 1), ("b", 2))
    assert run() is None and state() == {"a": 1, "b": 2}
    put(("a", 5))
    assert run() is None and state() == {"a": 6, "b": 2}
    first = store.current()
    # The same batches again, from a lost checkpoint: nothing changes.
    assert run(str(tmp_path / "lost")) is None and store.current() == first and view.get() is view.get()
    # A build that fails, and a candidate that fails its check, leave the view as it is.
    put(("a", -1))
    with pytest.raises(Exception, match="a bad batch"):
        run()
    put(("b", 1000))
    assert state() == {"a": 6, "b": 2} and store.current() == first
    with pytest.raises(ValueError, match="too much"):
        store.change(lambda old: build(old, spark.createDataFrame([("b", 1000)], kind)), check=small)
    assert state() == {"a": 6, "b": 2} and store.marks() == {"feed": 1}


def test_effective(spark):
    rows = spark.createDataFrame([("a", 1, "v1", "published"), ("a", 2, "v2", "review"), ("b", 1, "w", "rejected")], "uid string, revision int, version_id string, status string")
    assert [tuple(r) for r in overlays.effective(rows, ["uid"]).collect()] == [("a", 1, "v1", "published")]
    assert {r["version_id"] for r in overlays.effective(rows, ["uid"], published=False).collect()} == {"v2", "w"}
    assert overlays.manifest(rows, ["uid"]).first()[:6] == (2, 3, 1, 1, 1, 1)


def test_digest_tree_of_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a/x.txt": "1", "a/y.txt": "2", "a/b/z.txt": "3", "c/w.txt": "4", "top.txt": "5"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    nodes = lambda leaves: {"/".join(r["path"]): (r["children"], r["digest"]) for r in digests.tree(leaves, 3).collect()}
    leaves = spark.createDataFrame(digests.file_leaves(spark, str(root)).collect(), "path array<string>, digest string, length long, modified timestamp")
    before = nodes(leaves)
    assert {k: v[0] for k, v in before.items()} == {"": 3, "a": 3, "a/b": 1, "c": 1, "a/x.txt": 0, "a/y.txt": 0, "a/b/z.txt": 0, "c/w.txt": 0, "top.txt": 0}
    # The order of rows doesn't matter, their names do.
    assert nodes(leaves.repartition(7)) == before
    assert nodes(leaves.withColumn("path", F.expr("transform(path, p -> if(p = 'x.txt', 'v.txt', p))")))["a"] != before["a"]
    (root / "a/b/z.txt").write_text("changed")
    (root / "c/w.txt").unlink()
    (root / "c/v.txt").write_text("new")
    now = digests.file_leaves(spark, str(root), leaves)
    assert sorted(map(tuple, now.select(F.array_join("path", "/"), "digest").collect())) == sorted(map(tuple, digests.file_leaves(spark, str(root)).select(F.array_join("path", "/"), "digest").collect()))
    after = nodes(now)
    assert {k for k in before if before[k] != after.get(k)} == {"", "a", "a/b", "a/b/z.txt", "c", "c/w.txt"}
    again = {"/".join(r["path"]): (r["children"], r["digest"]) for r in digests.refreshed(digests.tree(leaves, 3), now, 3).collect()}
    assert again == after and digests.refreshed(digests.tree(leaves, 3), leaves, 3).count() == len(before)
