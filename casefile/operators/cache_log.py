"""A cache kept as a log of changes, which tasks append to and readers see in whole versions.

Changes (put, remove, clear) come in numbered batches, each a folder of its own. One small file names the
snapshot and the batches that count; it is replaced in one step, so a reader sees a batch whole or not at
all, and a batch that is replayed changes nothing. Compaction folds the batches into a new snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, REMOVE, CLEAR = "put", "remove", "clear"


@dataclass(frozen=True)
class CacheLog:
    """A cache below ``path`` of entries ``(key, value)``; ``value`` is any type, given as a schema string."""

    spark: SparkSession
    path: str
    value: str = "string"

    @property
    def schema(self) -> str:
        return f"key string, seq long, op string, value {self.value}"

    # --- the file that names what counts ---

    def _hadoop(self, name: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        where = jvm.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        where, fs = self._hadoop("current.json")
        if not fs.exists(where):
            return {"snapshot": None, "batches": [], "last": -1}
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _switch(self, state: dict) -> None:
        """Name another state in one step: the new file takes the place of the old by a rename."""
        there, fs = self._hadoop("current.json")
        new, _ = self._hadoop(f"current-{uuid.uuid4().hex}.json")
        stream = fs.create(new, True)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(option, 1)
        over[0] = option.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(there), over)

    # --- writing: one writer at a time ---

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Append changes ``(key, seq, op, value)`` as the batch of that number; within it, ``seq`` orders them. A
        clear has a null key. Batches count up; one that was applied before is left alone (False)."""
        state = self._state()
        if batch <= state["last"]:
            return False
        rows = changes.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "op", F.col("value").cast(self.value).alias("value"))
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{batch}")  # what a failed try left goes
        self._switch({**state, "batches": [*state["batches"], batch], "last": batch})
        return True

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that applies each micro-batch; restarts replay the last one, which changes nothing."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.apply(batch, rows) and None).option("checkpointLocation", checkpoint)

    def put(self, rows: DataFrame, key: str, value: str) -> None:
        self._next(rows.select(F.col(key).alias("key"), F.lit(0).alias("seq"), F.lit(PUT).alias("op"), F.col(value).alias("value")))

    def remove(self, keys: DataFrame, key: str) -> None:
        self._next(keys.select(F.col(key).alias("key"), F.lit(0).alias("seq"), F.lit(REMOVE).alias("op"), F.lit(None).alias("value")))

    def clear(self) -> None:
        self._next(self.spark.range(1).select(F.lit(None).alias("key"), F.lit(0).alias("seq"), F.lit(CLEAR).alias("op"), F.lit(None).alias("value")))

    def invalidate(self, stale: Column) -> None:
        """Remove the entries for which the condition on ``key`` and ``value`` holds."""
        self.remove(self.entries().filter(stale), "key")

    def _next(self, changes: DataFrame) -> None:
        self.apply(self._state()["last"] + 1, changes)

    def compact(self) -> None:
        """Fold all batches into a new snapshot. Readers of the old one go on reading it until :meth:`vacuum`."""
        state = self._state()
        name = uuid.uuid4().hex
        self._entries(state).write.parquet(f"{self.path}/snapshots/{name}")
        self._switch({"snapshot": name, "batches": [], "last": state["last"]})

    def vacuum(self) -> None:
        """Delete snapshots and batches that no longer count."""
        state = self._state()
        for folder, kept in (("snapshots", {state["snapshot"]}), ("log", set(map(str, state["batches"])))):
            where, fs = self._hadoop(folder)
            for found in fs.listStatus(where) if fs.exists(where) else []:
                if found.getPath().getName() not in kept:
                    fs.delete(found.getPath(), True)

    # --- reading ---

    def entries(self) -> DataFrame:
        """``(key, value)`` as the cache stands now; what is applied later does not show."""
        return self._entries(self._state())

    def _entries(self, state: dict) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{self.schema}, batch long")
        changes = empty
        if state["batches"]:
            folders = [f"{self.path}/log/{b}" for b in state["batches"]]
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/log/(\d+)/[^/]*$", 1).cast("long")
            changes = self.spark.read.schema(self.schema).parquet(*folders).withColumn("batch", number)
        if state["snapshot"]:
            old = self.spark.read.schema(f"key string, value {self.value}").parquet(f"{self.path}/snapshots/{state['snapshot']}")
            changes = changes.unionByName(old.select("key", F.lit(0).cast("long").alias("seq"), F.lit(PUT).alias("op"), "value", F.lit(-1).cast("long").alias("batch")))
        when = F.struct("batch", "seq")
        cleared = changes.filter(F.col("op") == CLEAR).agg(F.max(when).alias("cleared"))  # one row
        left = changes.filter("key is not null").join(F.broadcast(cleared), F.coalesce(when > F.col("cleared"), F.lit(True)))
        last = left.groupBy("key").agg(F.max_by(F.struct("op", "value"), when).alias("l"))
        return last.filter(F.col("l.op") == PUT).select("key", "l.value")
