"""Sliding-window admission per key (re-aimed rate limiter).

An event is admitted when fewer than ``max_requests`` *admitted* events of
the same key lie within the previous ``window_seconds`` (strictly:
``t - t_admitted < window``); refused events do not count. The decision
depends on earlier decisions, so a window count is only an upper bound.

Exact plan, with one shuffle of the events whatever the keys are like:

1. Range-partition by (key, time) and sort: a hot key is spread over many
   tasks by time. A gap of one window empties the state, so sessions are
   independent; all that begin and end in a partition are folded there.
2. A session that goes on over partitions needs the state (at most
   ``max_requests`` admitted times) at each partition's first event. The
   partition in which it begins gives the next one's. A partition that it
   passes *through* is folded, times only, from the state that the one before
   it is thought to leave: none at first, then what the last round gave. All of
   them are folded at once, and again where the state before has changed, until
   all agree; then every start is the true one, by induction from the first.
   A state forgets its past wherever events keep below the limit for a window,
   so few rounds are enough; what has not agreed after ``ROUNDS`` rounds is
   folded one after another, from the last true state, over the times alone.
3. Every partition folds its rows from the states found, in place.

Per partition, one record of at most ``max_requests`` times reaches the
driver. Folding is vectorised: up to ``max_requests`` events are admitted in one
comparison, and refused ones are skipped by binary search. Unbounded streams use
``streaming.jobs.stream_burst``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.session import cut_lineage, drop_scratch, ensure_on_workers, scratch_table

# --- fixed values: the reference's defaults --------------------------------
DEFAULT_MAX_REQUESTS = 100
DEFAULT_WINDOW_SECONDS = 3600
# ----------------------------------------------------------------------------
ROUNDS = 6
_NONE = -(1 << 61)  # stands for "never admitted"
_FEW = 16  # limits below which a plain loop is faster


def admit(t: np.ndarray, state: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the events at the sorted times ``t`` are admitted after the
    admitted times ``state``, and the last ``limit`` admitted times then."""
    out = np.zeros(len(t), bool)
    if limit <= 0:
        return out, state
    i = 0
    if limit < _FEW:
        held = deque(state.tolist(), maxlen=limit)
        times = t.tolist()
        while i < len(times):
            if len(held) < limit or times[i] - held[0] >= window:
                held.append(times[i])
                out[i] = True
                i += 1
            else:
                i = int(np.searchsorted(t, held[0] + window))
        return out, np.array(held, np.int64)
    last = np.r_[np.full(limit - len(state), _NONE), state].astype(np.int64)
    while i < len(t):
        ahead = t[i : i + limit]
        free = ahead - last[: len(ahead)] >= window  # the next event but j needs the j-th oldest to have gone
        n = len(free) if free.all() else int(np.argmin(free))
        if n:
            out[i : i + n] = True
            last = np.r_[last[n:], ahead[:n]]
            i += n
        else:
            i = int(np.searchsorted(t, last[0] + window))
    return out, last[last > _NONE]


def live(state: np.ndarray, t: int, window: int) -> np.ndarray:
    """The admitted times that still count at ``t``."""
    return state[t - state < window]


class Sessions:
    """Folds the sorted rows of a partition, batch by batch."""

    def __init__(self, limit: int, window: int, state: np.ndarray):
        self.limit, self.window, self.state = limit, window, state
        self.key, self.time, self.rows, self.breaks = None, None, 0, 0

    def __call__(self, keys: pa.Array, t: np.ndarray) -> np.ndarray:
        coded = keys.dictionary_encode()
        code = coded.indices.to_numpy()
        new = np.r_[False, (code[1:] != code[:-1]) | (t[1:] - t[:-1] >= self.window)]
        new[0] = self.rows > 0 and (keys[0].as_py() != self.key or t[0] - self.time >= self.window)
        starts = np.unique(np.r_[0, np.flatnonzero(new)])
        ends = np.r_[starts[1:], len(t)]
        out = np.ones(len(t), bool)  # a session of up to `limit` events is admitted whole
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if a == 0 or b == len(t) or b - a > self.limit:
                state = self.state if a == 0 and not new[0] else np.empty(0, np.int64)
                out[a:b], state = admit(t[a:b], state, self.limit, self.window)
                if b == len(t):
                    self.state = state
        self.key, self.time, self.rows, self.breaks = keys[-1].as_py(), int(t[-1]), self.rows + len(t), self.breaks + int(new.sum())
        return out


_SEGMENT = "pid int, block int, first_key string, first_t long, last_key string, last_t long, through boolean, state array<long>, times array<long>"


def _segments(limit: int, window: int):
    """One record of each partition, and the times of its first session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, first, pid, block = Sessions(limit, window, np.empty(0, np.int64)), None, None, 0

        def record(*values) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types, strict=True)], names=[c.split()[0] for c in _SEGMENT.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("__t").to_numpy()
            if first is None:
                first, pid = (batch.column("__key")[0].as_py(), int(t[0])), batch.column("__pid")[0].as_py()
            fold(batch.column("__key"), t)
            if not fold.breaks:  # still its first session
                yield record(pid, block, None, None, None, None, None, None, t)
                block += 1
        if first is not None:
            yield record(pid, -1, *first, fold.key, fold.time, not fold.breaks, fold.state, None)

    return run


def _fold_through(limit: int, window: int, starts: dict[int, np.ndarray], chained: bool):
    """The states after the segments that come in order; each begins from its
    own start, or (``chained``) from the end of the one before if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, state, ends = None, np.empty(0, np.int64), []
        for batch in batches:
            for p, times in zip(batch.column("pid").to_pylist(), batch.column("times"), strict=True):
                if p != pid:
                    if pid is not None:
                        ends.append((pid, state))
                    pid, state = p, starts[p] if p in starts or not chained else state
                _, state = admit(times.values.to_numpy(), state, limit, window)
        if pid is not None:
            ends.append((pid, state))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in ends], pa.int32()), pa.array([s for _, s in ends], pa.list_(pa.int64()))], names=["pid", "state"])

    return run


def _start_states(segments: DataFrame, limit: int, window: int) -> tuple[dict[int, np.ndarray], int]:
    """The state at the first event of each partition that goes on with a
    session, and the number of rounds that it took."""
    records = sorted(segments.filter("block = -1").drop("times").collect(), key=lambda r: r["pid"])  # one of a partition
    before: dict[int, int] = {}  # partition -> the one that its first session comes from
    for a, b in zip(records, records[1:]):
        if a["last_key"] == b["first_key"] and b["first_t"] - a["last_t"] < window:
            before[b["pid"]] = a["pid"]
    at = {r["pid"]: r["first_t"] for r in records}
    none = np.empty(0, np.int64)
    through = [r["pid"] for r in records if r["through"] and r["pid"] in before]  # their end depends on their start
    ends = {r["pid"]: np.array(r["state"], np.int64) for r in records}  # right where the last session began inside
    used = dict.fromkeys(through, none)  # `ends` were folded from these
    blocks = segments.filter("block >= 0").select("pid", "block", "times")

    def needed(p: int) -> np.ndarray:
        return live(ends[before[p]], at[p], window)

    def ask(pids: list[int], starts: dict[int, np.ndarray], chains: dict[int, int] | None = None) -> None:
        rows = blocks.filter(F.col("pid").isin(pids))
        if chains is None:
            rows = rows.repartition(len(pids), "pid")
        else:
            chain = rows.sparkSession.createDataFrame(list(chains.items()), "pid int, chain int")  # a row per partition
            rows = rows.join(F.broadcast(chain), "pid").repartition(len(set(chains.values())), "chain")
        order = ["pid", "block"] if chains is None else ["chain", "pid", "block"]
        made = rows.sortWithinPartitions(*order).select("pid", "times").mapInArrow(_fold_through(limit, window, starts, chains is not None), "pid int, state array<long>")
        for r in made.collect():
            ends[r["pid"]] = np.array(r["state"], np.int64)

    rounds = 0
    while changed := {p: s for p in through if not np.array_equal(s := needed(p), used[p])}:
        rounds += 1
        if rounds <= ROUNDS:
            ask(list(changed), changed)
            used.update(changed)
        else:  # one after another, each session from where it first disagrees
            left, chains, starts = [], {}, {}
            for p in through:
                b = before[p]
                if p in changed or b in chains:
                    left.append(p)
                    chains[p] = chains.get(b, p)
                    if b not in chains:
                        starts[p] = changed[p]
            ask(left, starts, chains)
            break
    return {p: needed(p) for p in before}, rounds


def burst_flags(
    events: DataFrame,
    key_col: str,
    ts_col: str,
    max_requests: int = DEFAULT_MAX_REQUESTS,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    partitions: int | None = None,
) -> DataFrame:
    """Every event with ``admitted`` true/false (rows are kept whole; events
    without a key or time get null)."""
    spark = events.sparkSession
    ensure_on_workers(spark)
    window = int(window_seconds * 1_000_000)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__row")
    prepared = events.select(row, F.col(key_col).cast("string").alias("__key"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t"))
    timed = prepared.where(F.col("__key").isNotNull() & F.col("__t").isNotNull())
    fields = [F.col("__row").getField(c) for c in events.columns]
    ordered = timed.repartitionByRange(n, "__key", "__t").sortWithinPartitions("__key", "__t", *fields).withColumn("__pid", F.spark_partition_id())
    # Read twice: cut by a reliable checkpoint, which also keeps partitions and order.
    ordered = cut_lineage(ordered)
    segments = scratch_table(ordered.select("__pid", "__key", "__t").mapInArrow(_segments(max_requests, window), _SEGMENT), "segments")
    starts, _ = _start_states(segments, max_requests, window)
    drop_scratch(segments)
    known = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if fold is None:
                fold = Sessions(max_requests, window, known.value.get(batch.column("__pid")[0].as_py(), np.empty(0, np.int64)))
            flags = fold(batch.column("__key"), batch.column("__t").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(flags)], names=["__row", "__admitted"])

    folded = ordered.select("__row", "__key", "__t", "__pid").mapInArrow(run, f"__row {prepared.schema['__row'].dataType.simpleString()}, __admitted boolean")
    untimed = prepared.where(F.col("__key").isNull() | F.col("__t").isNull()).select("__row", F.lit(None).cast("boolean").alias("__admitted"))
    return folded.unionByName(untimed).select("__row.*", F.col("__admitted").alias("admitted"))


def burst_flags_python(rows: list[tuple], max_requests: int, window_seconds: float) -> list[bool]:
    """Plain-Python reference loop over (key, t_seconds) rows in input order
    (rows must be sorted by time within each key). Used by tests."""
    state: dict = {}
    out = []
    for key, t in rows:
        times = [x for x in state.get(key, []) if t - x < window_seconds]
        if len(times) < max_requests:
            times.append(t)
            out.append(True)
        else:
            out.append(False)
        state[key] = times
    return out
