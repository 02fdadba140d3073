"""Sessions: stretches of events separated by inactivity, kept in a table that grows by batches.

``local_sessions`` finds the sessions of a set of events; ``SessionTable.upsert`` compares those of
a new batch with the stored ones within the gap, merges what the batch bridges and replaces the
affected part of the table in one atomic step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import US, from_micros, micros
from ultradia.session import remove_path


def local_sessions(events: DataFrame, keys: Sequence[str], ts: str, gap_s: int, placed_by: Sequence[str] = ()) -> DataFrame:
    """Sessions of ``events``: keys, start_us, end_us, n_events.

    ``placed_by``: further columns by which the rows are already placed among the partitions; the
    slots below are then counted in place.

    A session ends where more than ``gap_s`` seconds pass without an event of the same keys. Events
    are first counted in slots of ``gap_s`` seconds (two events of one slot always share a
    session): a partial aggregate, so that what is ordered per key is at most one row for each slot
    of the observed time, however many events a hot key has. Events at one time are counted each; rows
    with a null key or time are left out; no events give no sessions.
    """
    gap = int(gap_s) * US
    slots = (
        events.select(*keys, *placed_by, micros(ts).alias("us"))
        .where(F.col("us").isNotNull())
        .dropna(subset=list(keys))
        .groupBy(*keys, *placed_by, F.expr(f"us div {gap}L").alias("slot"))
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_events"))
    )
    return merge_sessions(slots.drop("slot", *placed_by), keys, gap_s)


def merge_sessions(parts: DataFrame, keys: Sequence[str], gap_s: int) -> DataFrame:
    """Merge partial sessions (keys, start_us, end_us, n_events) that overlap or lie within the gap.

    Parts of one key are further apart than the gap or come from different batches, so a key has at
    most (batches x time / gap) of them.
    """
    gap = int(gap_s) * US
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        parts.withColumn("_new", (before.isNull() | (F.col("start_us") - before > gap)).cast("int"))
        .withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
        .drop("_session")
    )


def described(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, session_start, session_end, duration_s, n_events."""
    return sessions.select(
        *keys,
        from_micros("start_us").alias("session_start"),
        from_micros("end_us").alias("session_end"),
        ((F.col("end_us") - F.col("start_us")) / F.lit(float(US))).alias("duration_s"),
        "n_events",
    )


class SessionTable:
    """Sessions stored under ``path`` in ``buckets`` parts by hash of the keys (as many as the session shuffles, unless given).

    Each upsert writes the parts that its batch touches under a new name and then puts a new list
    of parts in place by a rename, which is atomic: a reader sees all of an upsert or nothing of
    it, and an upsert that dies leaves the table as it was. The list also names the batches that are in the
    table, so a batch that is given again changes nothing. Parts no longer listed are deleted. The number of
    buckets is fixed when the table is made and kept in the list.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], gap_s: int, buckets: int | None = None):
        self.spark, self.path, self.keys, self.gap_s = spark, path.rstrip("/"), list(keys), gap_s
        self.buckets = self._state().get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def parts(self) -> dict[int, str]:
        """Bucket to folder, as of the last finished upsert."""
        return {int(k): v for k, v in self._state().get("parts", {}).items()}

    def batches(self) -> list[str]:
        """Names of the batches in the table."""
        return self._state().get("batches", [])

    def _state(self) -> dict:
        fs, p = self._fs(), self._p("_parts")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, parts: dict[int, str], batches: list[str]) -> None:
        fs, new = self._fs(), self._p(f"_parts.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "batches": batches, "parts": parts}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, self._p("_parts"), options)

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _read(self, folders: Sequence[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.select(*self.keys, "start_us", "end_us", "n_events").schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def upsert(self, batch: DataFrame, touched: Sequence[int] | None = None, name: str | None = None) -> None:
        """Merge the local sessions of a batch into the table; one whose ``name`` is in it already is left out.

        Events that repeat earlier ones are the caller's to drop (``unseen``), as sessions no longer know their events.
        ``touched``: the buckets the batch can touch, where the caller knows; else they are looked
        up (at most ``buckets`` numbers).
        """
        batch = batch.select(*self.keys, "start_us", "end_us", "n_events")
        if name is not None and name in self.batches():
            return
        if touched is None:
            touched = [r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        before = self.parts()
        stored = [before[b] for b in touched if b in before]
        both = batch.unionByName(self._read(stored, batch)) if stored else batch
        merged = merge_sessions(both, self.keys, self.gap_s)
        folder = f"part-{uuid.uuid4().hex}"
        merged.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, now = self._fs(), dict(before)
        for b in touched:
            if fs.exists(self._p(f"{folder}/bucket={b}")):
                now[b] = f"{folder}/bucket={b}"
        self._commit(now, self.batches() + ([name] if name is not None else []))
        for b in touched:
            if b in before and before[b] != now[b]:
                remove_path(self.spark, f"{self.path}/{before[b]}")

    def sessions(self, like: DataFrame) -> DataFrame:
        """The stored sessions; ``like`` gives the key types where nothing is stored yet."""
        parts = self.parts()
        return self._read(sorted(parts.values()), like) if parts else like.select(*self.keys, "start_us", "end_us", "n_events").limit(0)


def unseen(batch: DataFrame, earlier: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The events of a batch whose keys and time no earlier event has; one of those that repeat within the batch. Null keys or times are left out."""
    at = [*keys, ts]
    return batch.dropna(subset=at).dropDuplicates(at).join(earlier.select(*at).distinct(), at, "left_anti")


def arrival_batch(arrival: str, low: int, high: int, n: int) -> Column:
    """0 to n - 1: equal ranges of the arrival number, as if loaded one after the other."""
    return F.least(F.lit(n - 1), F.floor((F.col(arrival) - F.lit(low)) * F.lit(n) / F.lit(high - low + 1))).cast("int")
