"""ST1-ST4: Structured Streaming jobs built from the same Column logic as
the batch operators.

* ``stream_ingest``  - file stream -> normalised log rows (ST1).
* ``stream_hunt``    - compiled rules on each micro-batch, static technique
  table joined by broadcast, duplicates dropped within the watermark, rows
  without a time kept apart (ST2).
* ``stream_hourly``  - event-time windows of one hour, each written once when
  the watermark closes it (ST3).
* ``stream_burst``   - the sliding-window admission rule in order of event time,
  whatever order events arrive in (ST4).

Each ``start_*`` returns a running ``StreamingQuery``; checkpoints go to the
shared checkpoint folder, so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ravenhunt.operators.bursts import admit
from ravenhunt.operators.hunt import hunt
from ravenhunt.schemas import FINDING_SCHEMA
from ravenhunt.session import ensure_on_workers, settings

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State that grows with the stream lies on the executors' disks, within a fixed
#: memory, and a micro-batch writes only what it has changed.
STATE_ON_DISK = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _sink(df: DataFrame, out_path: str, checkpoint: str, output_mode: str = "append", available_now: bool = True):
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.outputMode(output_mode)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def start_ingest(logs_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """ST1: write the normalised stream (built by ``sources.logs.read_log_stream``)."""
    return _sink(logs_stream, out_path, checkpoint, available_now=available_now)


def epoch_writer(**paths: str):
    """A ``foreachBatch`` function that writes the rows of a micro-batch by their
    ``__to`` into one folder each, below ``epoch=<number>``. A micro-batch that
    runs again after a failure writes the same folder again, so nothing is
    there twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # several folders from one run of the batch
        try:
            for name, path in paths.items():
                batch.filter(F.col("__to") == name).drop("__to").write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")
        finally:
            batch.unpersist()

    return write


def read_epochs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What ``epoch_writer`` has written into a folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("epoch")


def _timed_once(matched: DataFrame) -> DataFrame:
    return matched.filter("timestamp is not null").dropDuplicatesWithinWatermark()


def hunt_stream(logs_stream: DataFrame, rules, techniques: DataFrame | None, watermark: str = "1 day") -> DataFrame:
    """ST2: findings of a log stream. Duplicates (equal findings, so of equal
    log rows) are dropped as matched log rows, before these unfold to findings,
    with a state that is kept for the watermark's delay only; findings without
    a time have no place in it and are left to ``untimed_findings``. The
    watermark follows the log rows, found or not."""
    return hunt(logs_stream.withWatermark("timestamp", watermark), rules, techniques, strategy="compiled", distinct=_timed_once)


def untimed_findings(logs_stream: DataFrame, rules, techniques: DataFrame | None, watermark: str = "1 day") -> DataFrame:
    """ST2's dead letters: findings of log rows without a time, as they come.
    No state could ever forget one, so duplicates are dropped on reading
    (``read_untimed``)."""
    logs = logs_stream.withWatermark("timestamp", watermark)
    return hunt(logs, rules, techniques, strategy="compiled", dedupe=False).filter("timestamp is null")


def read_untimed(spark: SparkSession, path: str) -> DataFrame:
    return read_epochs(spark, path, FINDING_SCHEMA).distinct()


def start_hunt(logs_stream: DataFrame, rules, techniques, out_path: str, checkpoint: str, watermark: str = "1 day",
               available_now: bool = True, untimed_path: str | None = None) -> StreamingQuery:
    """Findings go to ``out_path``, those without a time to ``untimed_path``
    (``<out_path>-untimed`` if not given); read them by ``read_epochs`` and ``read_untimed``."""
    timed = hunt_stream(logs_stream, rules, techniques, watermark).withColumn("__to", F.lit("timed"))
    untimed = untimed_findings(logs_stream, rules, techniques, watermark).withColumn("__to", F.lit("untimed"))
    write = epoch_writer(timed=out_path, untimed=untimed_path or f"{out_path.rstrip('/')}-untimed")
    with settings(logs_stream.sparkSession, STATE_ON_DISK):
        return _start(timed.unionByName(untimed).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write), available_now)


def hourly_counts(findings_stream: DataFrame, watermark: str | None = "1 day") -> DataFrame:
    """ST3: finding counts per one-hour event-time window. ``watermark=None``
    keeps the watermark already set upstream (e.g. by ``hunt_stream``)."""
    src = findings_stream if watermark is None else findings_stream.withWatermark("timestamp", watermark)
    return (
        src
        .groupBy(F.window("timestamp", "1 hour"))
        .agg(F.count(F.lit(1)).alias("finding_count"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "finding_count")
    )


def start_hourly(findings_stream: DataFrame, out_path: str, checkpoint: str, watermark: str | None = "1 day",
                 available_now: bool = True) -> StreamingQuery:
    """Append mode: an hour is written once, when the watermark has passed its
    end, and its state goes; a micro-batch that runs again writes the same
    folder (``epoch_writer``). Read by ``read_epochs``. An hour that the
    watermark has not passed is not there yet: a stream that ends is closed by
    a log row of a late time."""
    counts = hourly_counts(findings_stream, watermark).withColumn("__to", F.lit("hours"))
    with settings(findings_stream.sparkSession, STATE_ON_DISK):
        return _start(counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(epoch_writer(hours=out_path)), available_now)


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


HELD_AT_ONCE = 4096  # rows of a key that go to the state store at once
_BURST_STATE = T.StructType([T.StructField("admitted", T.ArrayType(T.LongType()))])


def _burst_update(max_requests: int, window_us: int, expires: bool):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # no admitted time lies within a window of the watermark
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches))
        timed = pdf["__t"].notna()
        out = [pdf[~timed].assign(admitted=None)]  # no time: neither admitted nor refused
        pdf = pdf[timed].sort_values(["__t", *[c for c in pdf.columns if c != "__t"]], kind="stable")
        flags = np.zeros(len(pdf), dtype=bool)
        for i, t in enumerate(pdf["__t"].to_numpy(dtype=np.int64).tolist()):
            admitted = [x for x in admitted if t - x < window_us]
            if len(admitted) < max_requests:
                admitted.append(t)
                flags[i] = True
        if admitted:
            state.update((admitted,))
            if expires:
                end_ms = (max(admitted) + window_us) // 1000 + 1
                state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        out.append(pdf.assign(admitted=flags))
        for part in out:
            if len(part):
                yield part.drop(columns=["__t"])

    return update


class HeldEvents(StatefulProcessor):
    """A key's events wait in list state until the watermark has passed them;
    an event-time timer at the earliest of them then folds all that are due, in
    order of time and of all columns, from the admitted times in value state."""

    def __init__(self, schema: T.StructType, ts_col: str, max_requests: int, window: int):
        self.columns, self.limit, self.window = schema.names, max_requests, window
        self.ts = schema.names.index(ts_col)  # not held: it is __t
        self.row = T.StructType([T.StructField("__t", T.LongType()), *schema.fields])
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in schema.fields]

    @classmethod
    def _plain(cls, value, whole: bool = False):
        """Pandas' and numpy's value as Spark's: nulls, whole numbers among nulls, lists."""
        if isinstance(value, np.ndarray):
            value = value.tolist()
        if isinstance(value, (list, tuple)):
            return [cls._plain(v) for v in value]
        if isinstance(value, dict):
            return {k: cls._plain(v) for k, v in value.items()}
        if value is None or pd.isna(value):
            return None
        value = value.item() if isinstance(value, np.generic) else value
        return int(value) if whole else value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.admitted = handle.getValueState("admitted", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._timer()
        first = known
        for pdf in rows:
            for at in range(0, len(pdf), HELD_AT_ONCE):
                part = pdf.iloc[at : at + HELD_AT_ONCE]  # by place: the names may be altered on the way
                rows_held = [[int(r[-1]), *map(self._plain, r[:-1], self.whole)] for r in part.itertuples(index=False, name=None)]
                for r in rows_held:
                    r[self.ts + 1] = None
                self.held.appendList([tuple(r) for r in rows_held])
                low = int(part.iloc[:, -1].min()) // 1000 + 1
                first = low if first is None else min(first, low)
        if first is not None and first != known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(first)
        yield from ()

    def _timer(self) -> int | None:
        return min((t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()]
        due = [r for r in held if r[0] // 1000 < mark]
        rest = [r for r in held if r[0] // 1000 >= mark]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.held.clear()
        state = np.array(self.admitted.get()[0] if self.admitted.exists() else [], np.int64)
        due.sort(key=lambda r: (r[0], [(v is not None, v) for v in r[1:]]))
        if due:
            flags, state = admit(np.array([r[0] for r in due], np.int64), state, self.limit, self.window)
            out = pd.DataFrame([r[1:] for r in due], columns=self.columns)
            out[self.columns[self.ts]] = pd.to_datetime([r[0] for r in due], unit="us")
            out["admitted"] = flags
            yield out
        if len(state) and (rest or state[-1] + self.window >= mark * 1000):
            self.admitted.update((state.tolist(),))
            if not rest:  # the state itself expires a window after its last time
                self.handle.registerTimer(int(state[-1] + self.window) // 1000 + 1)
        else:
            self.admitted.clear()

    def close(self) -> None:
        pass


def burst_stream(events_stream: DataFrame, key_col: str, ts_col: str, max_requests: int,
                 window_seconds: int, watermark: str | None = None) -> DataFrame:
    """ST4: per-key admission with state of at most ``max_requests`` times.

    With a ``watermark`` events are held until it has passed them and are then
    folded in order of event time (``transformWithStateInPandas``), so flags
    equal the batch operator's in whatever order and files events arrive; those
    later than the watermark are dropped, and a key's state goes once the
    watermark is a window past its last admitted event. What the watermark has
    not passed stays held: a stream that ends is closed by an event of no key
    and a late time. Needs the RocksDB state store (``start_burst`` sets it).

    Without a watermark nothing can be held: events of a key within one
    micro-batch are folded in order of time, then of all columns; across
    micro-batches, in arrival order (the micro-batch bounds the group size).

    Events without a key or time get null.
    """
    ensure_on_workers(events_stream.sparkSession)
    window = int(window_seconds * 1_000_000)
    columns = events_stream.columns
    out_schema = T.StructType(list(events_stream.schema.fields) + [T.StructField("admitted", T.BooleanType())])
    if watermark is not None:
        events_stream = events_stream.withWatermark(ts_col, watermark)
    # other times are held as numbers, so that no time zone of a worker touches them
    times = [f.name for f in out_schema.fields[:-1] if isinstance(f.dataType, T.TimestampType) and f.name != ts_col]
    if watermark is not None and times:
        events_stream = events_stream.withColumns({c: F.unix_micros(c) for c in times})
    prepared = events_stream.withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    if watermark is None:
        return prepared.groupBy(key_col).applyInPandasWithState(_burst_update(max_requests, window, False), out_schema, _BURST_STATE, "append", GroupStateTimeout.NoTimeout)
    timed = prepared.where(F.col(key_col).isNotNull() & F.col("__t").isNotNull())
    folded = timed.groupBy(key_col).transformWithStateInPandas(
        HeldEvents(events_stream.schema, ts_col, max_requests, window), T.StructType([*events_stream.schema.fields, out_schema.fields[-1]]), "Append", "EventTime")
    untimed = prepared.where(F.col(key_col).isNull() | F.col("__t").isNull()).select(*columns, F.lit(None).cast("boolean").alias("admitted"))
    both = folded.unionByName(untimed)
    return both.withColumns({c: F.timestamp_micros(c) for c in times}) if times else both



def start_burst(events_stream: DataFrame, key_col: str, ts_col: str, max_requests: int, window_seconds: int,
                out_path: str, checkpoint: str, available_now: bool = True, watermark: str | None = None) -> StreamingQuery:
    # ``transformWithState`` keeps several states of a key, which only this store can
    with settings(events_stream.sparkSession, {} if watermark is None else {PROVIDER: ROCKSDB}):
        return _sink(burst_stream(events_stream, key_col, ts_col, max_requests, window_seconds, watermark), out_path, checkpoint,
                     available_now=available_now)
