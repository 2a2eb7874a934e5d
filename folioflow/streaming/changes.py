"""Keeping an index current from a feed of file changes."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from folioflow.operators import index as I
from folioflow.operators.encode import Encoder
from folioflow.schemas import CHANGES


def read_changes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """An append-only folder of Parquet files with events (path, op, content, mtime). Edits in place are not seen."""
    reader = spark.readStream.schema(CHANGES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def last_events(changes: DataFrame) -> DataFrame:
    """The latest event of each path; of several at one time, a deletion, then the greatest content."""
    return changes.groupBy("path").agg(F.max_by(F.struct("op", "content", "mtime"), F.struct("mtime", F.col("op") == "deleted", "content")).alias("e")).select("path", "e.*")


def classified(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """``changes`` with status: created, updated, skipped (equal content, or older than what is stored), deleted,
    missing (a deletion of what is not there) or error (no content)."""
    new = last_events(changes).withColumn("sha256", F.sha2("content", 256))
    old = stored.select("path", F.col("sha256").alias("_sha"), F.col("mtime").alias("_mtime"))
    status = (
        F.when(F.col("mtime") < F.col("_mtime"), "skipped")
        .when((F.col("op") == "deleted") & F.col("_sha").isNull(), "missing")
        .when(F.col("op") == "deleted", "deleted")
        .when(F.col("content").isNull(), "error")
        .when(F.col("_sha").isNull(), "created")
        .when(F.col("_sha") == F.col("sha256"), "skipped")
        .otherwise("updated")
    )
    return new.join(old, "path", "left").withColumn("status", status).drop("_sha", "_mtime")


def apply_changes(spark: SparkSession, index_dir: str, model: str, changes: DataFrame, encoder: Encoder, batch_id: int, chunk_size: int = 600, overlap: int = 80) -> DataFrame:
    """One batch of events into the index; returns (path, status). Only created and updated paths are chunked and
    encoded. The index as it was before ``batch_id`` decides, so a batch that is replayed changes nothing."""
    before = I.current_version(I.read_table(spark, index_dir, "documents").filter((F.col("model_id") == model) & (F.col("batch_id") < batch_id)))
    status = classified(changes, before).persist()
    work = I.prepared(status.filter("status IN ('created', 'updated')"))
    gone = status.filter("status = 'deleted'").select("path")
    if status.filter("status IN ('created', 'updated', 'deleted')").limit(1).count():
        I.write_batch(spark, index_dir, model, batch_id, work, gone, encoder, chunk_size, overlap)
    return status.select("path", "status")


#: Paths are dealt into so many groups by their hash, and a group's paths are one state: a call of Python for each path costs milliseconds. A stream
#: keeps the number that it began with.
BUCKETS = 1 << 11
#: A path in the state of its group, what the stream says about it, and the store that keeps states.
STORED = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("mtime", pa.timestamp("us")), ("version", pa.int64())])
VERDICTS = "path string, op string, content string, mtime timestamp, sha256 string, status string, version long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = ["op", "content", "mtime", "sha256"]


def verdict(stored: tuple | None, op: str, content: str | None, mtime, sha256: str | None) -> str:
    """What an event makes of a path (``classified`` by row). ``stored``: digest, time and version of what is there."""
    if stored is not None and mtime is not None and stored[1] is not None and mtime < stored[1]:
        return "skipped"
    if op == "deleted":
        return "missing" if stored is None else "deleted"
    if content is None:
        return "error"
    return "created" if stored is None else "skipped" if stored[0] == sha256 else "updated"


class PathStates(StatefulProcessor):
    """Keeps digest, time and number of versions of every path that is there, so that a batch reads no more than the groups of its own events.
    Of a path's events in one batch the last one counts: by time, a deletion after others, then by content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "rows binary")

    def _read(self) -> dict[str | None, tuple]:
        """(digest, time, version) by path."""
        value = self.stored.get()
        if value is None:
            return {}
        rows = pa.ipc.open_stream(bytes(value[0])).read_all().to_pydict()
        return dict(zip(rows["path"], zip(rows["sha256"], rows["mtime"], rows["version"])))

    def _write(self, held: dict[str | None, tuple]) -> None:
        if not held:
            self.stored.clear()
            return
        columns = [list(held), *map(list, zip(*held.values()))]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, STORED) as writer:
            writer.write_table(pa.table(columns, schema=STORED))
        self.stored.update((sink.getvalue().to_pybytes(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._read()
        held.update((path, (sha256, _time(mtime), 1)) for path, sha256, mtime in zip(*(initialState[c] for c in ("path", "sha256", "mtime")), strict=True))
        self._write(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str | None, tuple] = {}
        for batch in rows:
            for row in zip(batch["path"], *(batch[c] for c in EVENT), strict=True):
                path, op, content, mtime, sha256 = (None if x is None or x != x else x for x in row)
                own = (mtime is not None, mtime or 0, op == "deleted", content is not None, content or "")
                if path not in last or own > last[path][0]:
                    last[path] = own, (op, content, _time(mtime), sha256)
        held, out, changed = self._read(), [], False
        for path, (_, event) in last.items():
            stored = held.get(path)
            status = verdict(stored, *event)
            version = stored[2] if stored else 0
            if status in ("created", "updated"):
                version += 1
                held[path] = event[3], event[2], version
            elif status == "deleted":
                del held[path]
            changed |= status in ("created", "updated", "deleted")
            out.append((path, *event, status, version))
        if changed:
            self._write(held)
        yield pd.DataFrame(out, columns=["path", *EVENT, "status", "version"])

    def close(self) -> None:
        pass


def _time(value):
    """A time as Python has it, null for none."""
    return None if value is None or value != value else pd.Timestamp(value).to_pydatetime()


def path_states(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A stream of VERDICTS for a stream of events, one row for each path in a batch. ``stored`` (path, sha256, mtime) is what an index holds
    when the stream first begins; from then on the state store knows, by groups of paths (``BUCKETS``). Needs a store that lies on disk, which
    it sets."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    events = changes.select(bucket, "path", *EVENT[:3], F.sha2("content", 256).alias("sha256"))
    begin = stored.select(bucket, "path", "sha256", "mtime").groupBy("bucket") if stored is not None else None
    return events.groupBy("bucket").transformWithStateInPandas(PathStates(), VERDICTS, "Update", "None", begin)


def stream_index(spark: SparkSession, changes: DataFrame, index_dir: str, model: str, encoder: Encoder, checkpoint: str, chunk_size: int = 600, overlap: int = 80, once: bool = True) -> StreamingQuery:
    """Apply a change stream batch by batch. What a path's last version was is keyed state of the stream (``path_states``), begun from the
    index as it is, so a batch reads its own events and the groups of their paths, nothing else. Batches are written by their number after those of the
    index, and states are those of the batch before, so one that is repeated after a failure writes the same again. The query's
    progress (listener or ``lastProgress``) carries the observed number of events."""
    first = _first_batch(spark, index_dir, checkpoint)
    # without what a batch that failed has written: that is repeated
    held = I.current_version(I.read_table(spark, index_dir, "documents").filter((F.col("model_id") == model) & (F.col("batch_id") < first)))

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        if not rows.filter("status IN ('created', 'updated', 'deleted')").isEmpty():
            work = I.prepared(rows.filter("status IN ('created', 'updated')"))
            I.write_batch(spark, index_dir, model, first + number, work, rows.filter("status = 'deleted'").select("path"), encoder, chunk_size, overlap)
        rows.unpersist()

    watched = changes.observe("changes", F.count("*").alias("events"), F.count_if(F.col("op") == "deleted").alias("deletions"))
    writer = path_states(watched, held).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _first_batch(spark: SparkSession, index_dir: str, checkpoint: str) -> int:
    """The number of a stream's batch 0 in the index, fixed when the stream first begins and kept beside its checkpoint."""
    path = f"{checkpoint.rstrip('/')}-first"
    try:
        return spark.read.schema("first long").json(path).first()[0]
    except AnalysisException:
        first = I.next_batch(spark, index_dir)
        spark.createDataFrame([(first,)], "first long").coalesce(1).write.json(path)
        return first


class RunProgress(StreamingQueryListener):
    """Adds up the events of a query's batches against the number that the feed holds."""

    def __init__(self, total: int):
        self.total, self.done, self.deletions, self.began = total, 0, 0, time.time()

    def onQueryStarted(self, event) -> None:
        self.began = time.time()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("changes")
        if seen is not None:
            self.done, self.deletions = self.done + seen["events"], self.deletions + seen["deletions"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def state(self) -> dict[str, float]:
        return progress(self.done, self.total, time.time() - self.began)


def progress(done: int, total: int, seconds: float) -> dict[str, float]:
    """Percentage and estimated seconds that remain."""
    share = done / total if total else 1.0
    return {"processed": done, "total": total, "percent": round(100 * share, 1), "elapsed": seconds, "remaining": round(seconds / done * (total - done), 1) if done else 0.0}
