"""A versioned store: every commit is a new generation folder, and the generations form a chain.

Data is written by Spark, read back and checked before it counts. The commit
itself is one file, ``after-<generation>``, that names the next generation and
can be made only once, so of two writers who began at the same generation one
wins and the other is told. ``CURRENT`` is where readers begin to follow the
chain; it may lag behind, never lead astray. Paths may be in any store that
Spark's file systems reach and that refuses to rename onto an existing file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lectern.operators import overlays

START = "start"


class Moved(RuntimeError):
    """Another commit came first."""


class Store:
    """Generations of one table under ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: str, most_rows: int | None = None):
        self.spark, self.root, self.key, self.most_rows = spark, root, key, most_rows
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        """What a small file of the store holds, None without it."""
        at = self.path(f"{self.root}/{name}")
        if not self.files.exists(at):
            return None
        held = self.files.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8").strip()
        finally:
            held.close()

    def _write(self, name: str, text: str):
        at = self.files.makeQualified(self.path(f"{self.root}/{name}"))
        out = self.files.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return at

    def _head(self) -> str:
        """The last generation of the chain, ``START`` if there is none."""
        try:
            name = self._text("CURRENT") or START
        except Exception:  # noqa: BLE001  replaced while it was read: the chain's beginning does as well
            name = START
        while True:
            following = self._text(f"after-{name}")
            if following is None:
                return name
            name = following

    def current(self) -> str | None:
        """Name of the current generation."""
        name = self._head()
        return None if name == START else name

    def read(self, generation: str | None = None) -> DataFrame | None:
        """Rows of a generation, the current one if none is named."""
        name = generation or self.current()
        return self.spark.read.parquet(f"{self.root}/{name}") if name else None

    def marks(self, generation: str | None = None) -> dict[str, int]:
        """What the current generation says of the streams that went into it: the last batch of each."""
        name = generation or self.current()
        return json.loads(self._text(f"{name}/_marks.json") or "{}") if name else {}

    def commit(self, rows: DataFrame, check: Callable[[DataFrame], None] | None = None, before: str | None = None, marks: Mapping[str, int] | None = None) -> str:
        """Write a generation, check what was written, then chain it to ``before`` (the current one); returns its name.

        A key that isn't unique, too many rows or a failing ``check`` raises and
        leaves the current generation as it is, and so does a commit by someone
        else in between (``Moved``).
        """
        before = before or self._head()
        name = f"g-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.root}/{name}")
            written = self.spark.read.parquet(f"{self.root}/{name}")
            state = written.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(self.key).alias("k")).first()
            if state["n"] != state["k"]:
                raise ValueError(f"{state['n'] - state['k']} rows repeat {self.key} or have none")
            if self.most_rows is not None and state["n"] > self.most_rows:
                raise ValueError(f"{state['n']} rows; the store takes {self.most_rows}")
            if check:
                check(written)
            held = {**({} if before == START else self.marks(before)), **(marks or {})}
            if held:
                self._write(f"{name}/_marks.json", json.dumps(held))
            if not self._claim(f"after-{before}", name):
                raise Moved(f"the store moved on from {before} to {self.current()}")
        except Exception:
            self.files.delete(self.path(f"{self.root}/{name}"), True)
            raise
        self._lead(name)
        return name

    def _claim(self, name: str, text: str) -> bool:
        """Make a small file with its text in one step; False if it is there already."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        new, now = self._write(f"_{text}", text), self.files.makeQualified(self.path(f"{self.root}/{name}"))
        try:
            if now.toUri().getScheme() == "file":
                # A local rename replaces what is there; a link doesn't.
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(now), local(new))
            else:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), conf).rename(new, now, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if self.files.exists(now):
                return False
            raise
        finally:
            self.files.delete(new, False)
        return True

    def _lead(self, name: str) -> None:
        """Let readers begin at a generation, by a rename that replaces; should it fail, they begin earlier."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        new, now = self._write(f"_CURRENT-{name}", name), self.files.makeQualified(self.path(f"{self.root}/CURRENT"))
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), conf).rename(new, now, over)

    def change(self, build: Callable[[DataFrame | None], DataFrame | None], tries: int = 8, **settings) -> str | None:
        """Commit ``build`` of the current rows, built anew whenever someone else committed in between; None from it is no commit."""
        for left in range(tries - 1, -1, -1):
            before = self._head()
            rows = build(None if before == START else self.read(before))
            if rows is None:
                return None
            try:
                return self.commit(rows, before=before, **settings)
            except Moved:
                if not left:
                    raise

    def append(self, rows: DataFrame) -> str | None:
        """Commit the current rows and those of ``rows`` with new keys; nothing new is no commit."""

        def build(old: DataFrame | None) -> DataFrame | None:
            fresh = rows if old is None else rows.join(old.select(self.key), self.key, "left_anti")
            return None if fresh.isEmpty() else fresh if old is None else old.unionByName(fresh)

        return self.change(build)

    def append_versions(self, versions: DataFrame, identity: list[str], **settings) -> str | None:
        """Commit new versions of identities; revisions go on from those stored, known version ids change nothing."""

        def build(old: DataFrame | None) -> DataFrame | None:
            fresh = overlays.new_versions(old, versions, identity, self.key)
            return None if fresh.isEmpty() else fresh if old is None else old.unionByName(fresh)

        return self.change(build, **settings)

    def update(self, key, **values) -> str | None:
        """Commit the current rows with ``values`` set where the key is ``key``; no change is no commit."""
        hit, differs = F.col(self.key) == F.lit(key), F.lit(False)
        for c, v in values.items():
            differs |= ~F.col(c).eqNullSafe(F.lit(v))

        def build(old: DataFrame | None) -> DataFrame | None:
            if old is None or old.where(hit & differs).isEmpty():
                return None
            return old.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})

        return self.change(build)


class LiveView:
    """The store's current rows for readers that stay open: looked up again only when the store has moved on."""

    def __init__(self, store: Store):
        self.store, self.generation, self.rows = store, None, None

    def get(self) -> DataFrame | None:
        now = self.store.current()
        if now != self.generation:
            self.rows, self.generation = self.store.read(now), now
        return self.rows


def live_refresh(
    stream: DataFrame, store: Store, name: str, build: Callable[[DataFrame | None, DataFrame], DataFrame], check: Callable[[DataFrame], None] | None = None
) -> DataStreamWriter:
    """A stream writer that turns each batch into a generation of ``store``: a candidate is built, written, checked, then swapped in.

    A batch is applied once: the generation carries the number of the last batch
    of stream ``name``, and a batch that comes again changes nothing. A batch
    whose candidate can't be built or fails its check stops the stream and
    leaves the old view; so does none.
    """

    def apply(batch: DataFrame, number: int) -> None:
        def candidate(old: DataFrame | None) -> DataFrame | None:
            return None if store.marks().get(name, -1) >= number else build(old, batch)

        store.change(candidate, check=check, marks={name: number})

    return stream.writeStream.foreachBatch(apply)


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of a key replaced; rows of a blank key are appended."""
    named = rows.where(F.coalesce(F.trim(key), F.lit("")) != "")
    return base.join(named.select(key), key, "left_anti").unionByName(rows)
