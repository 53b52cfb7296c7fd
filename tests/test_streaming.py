"""Streams against their batch twins: event-time order, dead letters, windows that close."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ravenhunt.operators.bursts import burst_flags
from ravenhunt.operators.hunt import hunt
from ravenhunt.plans import catalog, catalog_io
from ravenhunt.plans.ruleset import rule_table, technique_table
from ravenhunt.plans.views import log_view
from ravenhunt.schemas import LOG_SCHEMA
from ravenhunt.session import scratch_path
from ravenhunt.sources.logs import read_log_stream
from ravenhunt.streaming import jobs

BASE = datetime(2024, 1, 1)


def _source(spark, schema, files):
    """A stream with a micro-batch per list of rows."""
    src = scratch_path(spark, "t-stream")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_burst_stream_in_any_order_equals_batch(spark):
    rng = random.Random(1)
    schema = "event_id long, user_id long, ts timestamp, _note string, seen timestamp, tags array<string>"
    rows = []
    for i in range(600):
        ts = None if i % 40 == 0 else BASE + timedelta(seconds=rng.randrange(15_000))
        rows.append((i, None if i % 50 == 0 else rng.randrange(4), ts, f"x{i}" if i % 3 else None, BASE - timedelta(days=i) if i % 2 else None, ["a", str(i)]))
    rng.shuffle(rows)
    end = (None, None, BASE + timedelta(days=40), None, None, None)
    stream = _source(spark, schema, [*[rows[k::4] for k in range(4)], [end]])
    out = scratch_path(spark, "t-out")
    q = jobs.start_burst(stream, "user_id", "ts", 5, 600, out, scratch_path(spark, "t-ckpt"), watermark="1 day")
    q.awaitTermination()
    got = spark.read.parquet(out).filter("event_id is not null")
    want = burst_flags(spark.createDataFrame(rows, schema), "user_id", "ts", 5, 600)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.admitted for r in got.collect()} == {True, False, None}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != jobs.ROCKSDB


def _log(ts, host, message="mimikatz.exe", process="mimikatz.exe"):
    return (ts, host, "u", process, 4688, message, None, None, "a")


RULE = {"id": "r", "title": "t", "level": "high", "tags": ["attack.t1003"], "detection": {"a": {"Image|contains": "mimikatz"}, "condition": "a"}}


def test_stream_hunt_drops_duplicates_and_keeps_rows_without_time_apart(spark):
    rules, techniques = rule_table(spark, [RULE]), technique_table(spark)
    hour = timedelta(hours=1)
    first = [_log(BASE, "h1"), _log(BASE, "h1"), _log(None, "h0"), _log(BASE + hour, "h2"), _log(BASE, "quiet", "x", "x")]
    again = [_log(BASE, "h1"), _log(None, "h0"), _log(None, "h9")]
    later = [_log(BASE + 50 * hour, "h3")]
    last = [_log(BASE + 99 * hour, "h4"), _log(BASE + 99 * hour, "h4")]
    files = [first, again, later, last]
    out = scratch_path(spark, "t-hunt")
    q = jobs.start_hunt(_source(spark, LOG_SCHEMA, files), rules, techniques, out, scratch_path(spark, "t-ckpt"), watermark="2 hours")
    q.awaitTermination()
    logs = spark.createDataFrame([r for f in files for r in f], LOG_SCHEMA)
    want = sorted(map(repr, hunt(logs, rules, techniques).collect()))
    timed, untimed = jobs.read_epochs(spark, out), jobs.read_untimed(spark, out + "-untimed")
    assert sorted(map(repr, timed.unionByName(untimed).collect())) == want
    assert sorted(r.hostname for r in untimed.collect()) == ["h0", "h9"]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) >= 2 and rows[-1] < max(rows)  # the watermark lets the state go


def test_stream_hunt_state_holds_matched_rows_on_disk(spark):
    rules = rule_table(spark, [RULE, {**RULE, "id": "r2", "title": "t2"}, {**RULE, "id": "r3", "title": "t3"}])
    rows = [_log(BASE + timedelta(minutes=i % 40), f"h{i % 40}") for i in range(60)] + [_log(BASE, "quiet", "x", "x")]
    out = scratch_path(spark, "t-hunt")
    q = jobs.start_hunt(_source(spark, LOG_SCHEMA, [rows[:30], rows[30:]]), rules, technique_table(spark), out, scratch_path(spark, "t-ckpt"))
    q.awaitTermination()
    want = hunt(spark.createDataFrame(rows, LOG_SCHEMA), rules, technique_table(spark)).collect()
    assert sorted(map(repr, jobs.read_epochs(spark, out).collect())) == sorted(map(repr, want)) and len(want) == 120
    state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) == 40  # a log row that three rules find is one row of state
    assert all(any(k.startswith("rocksdb") for k in s["customMetrics"]) for s in state)
    assert spark.conf.get(jobs.PROVIDER) != jobs.ROCKSDB
    assert not any(spark.conf.get(k, None) for k in jobs.STATE_ON_DISK if k != jobs.PROVIDER)


def _events(spark, tmp_path, props):
    rows = [(i, None if i % 10 == 1 else BASE + timedelta(minutes=i), i % 7, "error" if i % 3 else "view", 1.0, props(i)) for i in range(400)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("odd", [None, "x\r\ny", 'a,"b"\nc', "p\rq"])
def test_log_files_are_split_unless_texts_hold_line_breaks(spark, tmp_path, odd):
    sf_dir = _events(spark, tmp_path, lambda i: odd if odd and i % 5 == 0 else f'{{"k": {i}}}')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path, kind = catalog_io._log_files(spark, sf_dir, "t-logs")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).count()
    assert files <= spark.sparkContext.defaultParallelism  # not as many as the table has parts
    out = scratch_path(spark, "t-parts")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        stream = read_log_stream(spark, path, "csv", **kind).withColumns({"__part": F.spark_partition_id(), "__file": F.input_file_name()})
        jobs.start_ingest(stream, out, scratch_path(spark, "t-ckpt")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = spark.read.parquet(out)
    parts = got.select("__part", "__file").distinct().count()
    assert (parts > files) == (odd is None)
    assert sorted(map(repr, got.drop("__part", "__file").collect())) == sorted(map(repr, log_view(spark, sf_dir).collect()))


@pytest.mark.parametrize("end", ["", "\r\n\n end"])
def test_stream_hunt_query_keeps_line_breaks_and_rows_without_time(spark, tmp_path, end):
    sf_dir = _events(spark, tmp_path, lambda i: f'"{i}",{end}')
    want = catalog.QUERIES["hunt"](spark, sf_dir).collect()
    assert len(want) > 400 and any(r.timestamp is None for r in want)
    assert sorted(map(repr, catalog.QUERIES["stream_hunt"](spark, sf_dir).collect())) == sorted(map(repr, want))


def test_hours_are_written_once(spark):
    rules, techniques = rule_table(spark, [RULE]), technique_table(spark)
    rng, hour = random.Random(2), timedelta(hours=1)
    rows = [_log(BASE + timedelta(minutes=i), f"h{rng.randrange(3)}-{i}") for i in range(0, 900, 7)]
    parts = [rows[:60], rows[50:100], rows[100:], [_log(BASE + 400 * hour, "end", "x", "x")]]
    out = scratch_path(spark, "t-hours")
    found = jobs.hunt_stream(_source(spark, LOG_SCHEMA, parts), rules, techniques, watermark="3 hours")
    q = jobs.start_hourly(found, out, scratch_path(spark, "t-ckpt"), watermark=None)
    q.awaitTermination()
    got = jobs.read_epochs(spark, out).collect()
    counts = {}
    for r in rows:
        counts[r[0].replace(minute=0)] = counts.get(r[0].replace(minute=0), 0) + 1
    assert len(got) == len(counts) and {r.window_start: r.finding_count for r in got} == counts
    epochs = spark.read.parquet(out).groupBy("epoch").count().collect()
    assert len(epochs) > 1  # hours are written as they close, not all at the end
    # a micro-batch that runs again writes the same rows to the same place
    again = epochs[0]["epoch"]
    batch = spark.read.parquet(out).filter(F.col("epoch") == again).drop("epoch").withColumn("__to", F.lit("hours"))
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    jobs.epoch_writer(hours=out)(batch, again)
    assert sorted(map(repr, jobs.read_epochs(spark, out).collect())) == sorted(map(repr, got))
