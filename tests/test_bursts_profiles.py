"""W3 burst flags (batch and stream) against a plain loop; profiles."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravenhunt.operators import profile
from ravenhunt.operators import bursts
from ravenhunt.operators.bursts import burst_flags, burst_flags_python
from ravenhunt.session import scratch_path
from ravenhunt.streaming import jobs


def _events(spark, n=300, keys=4, seed=3):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = [(i, rng.randrange(keys), base + timedelta(seconds=rng.randrange(20_000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_burst_flags_equal_loop(spark):
    rows, df = _events(spark)
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = burst_flags_python([(r[1], r[2].timestamp()) for r in ordered], 5, 600)
    want_by_id = {r[0]: w for r, w in zip(ordered, want)}
    got = {r.event_id: r.admitted for r in burst_flags(df, "user_id", "ts", 5, 600).collect()}
    assert got == want_by_id and 0 < sum(want) < len(want)


def _hot(seed, pauses, n=4000):
    """Half of the events belong to one key that never stops for a window; ``pauses``: it slows down at times."""
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randrange(0, 3) if not pauses or (i // 400) % 3 else rng.randrange(20, 90)
        rows.append((i, 7, datetime(2024, 1, 1) + timedelta(seconds=t)))
        rows.append((n + i, rng.randrange(100, 140), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4 * n))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [0, 1, 3, 16, 40])
@pytest.mark.parametrize("pauses", [True, False])
@pytest.mark.parametrize("rounds", [0, 2, bursts.ROUNDS])
def test_a_key_that_never_pauses(spark, monkeypatch, limit, pauses, rounds):
    """One session over many partitions, folded in rounds, one after another, or both, equals the plain loop."""
    monkeypatch.setattr(bursts, "ROUNDS", rounds)
    asked = []
    find = bursts._start_states
    monkeypatch.setattr(bursts, "_start_states", lambda *a: asked.append(find(*a)) or asked[-1])
    rows = _hot(limit + 2 * pauses, pauses)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {r[0]: w for r, w in zip(ordered, burst_flags_python([(r[1], r[2].timestamp()) for r in ordered], limit, 100))}
    got = {r.event_id: r.admitted for r in burst_flags(df, "user_id", "ts", limit, 100, partitions=12).collect()}
    assert got == want
    starts, used = asked[0]
    assert len(starts) >= 5  # the hot session is folded by several tasks
    if pauses and rounds == bursts.ROUNDS and limit:
        assert used < len(starts)  # slower spells end what a start can change


def test_admit_equals_the_loop():
    rng = random.Random(4)
    for limit in (1, 2, 15, 16, 17, 50):
        t = np.cumsum([rng.choice([0, 0, 1, 2, 30]) for _ in range(700)]).astype(np.int64)
        want = burst_flags_python([("k", x) for x in t.tolist()], limit, 60)
        cut, state, got = sorted(rng.sample(range(700), 5)), np.empty(0, np.int64), []
        for a, b in zip([0, *cut], [*cut, 700]):
            flags, state = bursts.admit(t[a:b], state, limit, 60)
            got += flags.tolist()
        assert got == want and len(state) <= limit


def test_burst_flags_odd_rows(spark):
    rows = [(1, None, datetime(2024, 1, 1)), (2, 3, None), (3, 3, datetime(2024, 1, 1)), (3, 3, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").selectExpr("*", "'x' as __key", "1 as __row", "array(1) as __t", "2 as __pid")
    got = burst_flags(df, "user_id", "ts", 1, 60)
    assert got.columns == [*df.columns, "admitted"]
    assert sorted((r.event_id, str(r.admitted)) for r in got.collect()) == [(1, "None"), (2, "None"), (3, "False"), (3, "True")]
    assert burst_flags(df.filter("false"), "user_id", "ts").collect() == []


def test_burst_stream_equals_batch(spark):
    rows, df = _events(spark, seed=5)
    src = scratch_path(spark, "t-burst")
    df.write.parquet(src)
    out, ckpt = scratch_path(spark, "t-burst-out"), scratch_path(spark, "t-burst-ckpt")
    q = jobs.start_burst(spark.readStream.schema(df.schema).parquet(src), "user_id", "ts", 5, 600, out, ckpt)
    q.awaitTermination()
    got = {r.event_id: r.admitted for r in spark.read.parquet(out).collect()}
    want = {r.event_id: r.admitted for r in burst_flags(df, "user_id", "ts", 5, 600).collect()}
    assert got == want


def test_profile_and_narrow(spark):
    df = spark.createDataFrame(
        [(1, 100000, 1.5, "a", None, "z"), (2, -5, 2.5, "a", None, "z"), (3, 7, 3.5, "b", None, "z"),
         (4, 8, 4.5, "a", None, "z")],
        "small long, mid long, f double, cat string, n string, cat2 string",
    )
    p = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert p["small"].suggested_type == "tinyint" and p["mid"].suggested_type == "int"
    # unique ratio 0.5 is not below 0.5 -> stays text; 0.25 -> category
    assert p["f"].suggested_type == "float" and p["cat"].suggested_type == "string"
    assert p["cat2"].suggested_type == "category"
    assert p["cat"].distinct_count == 2 and p["n"].distinct_count == 0 and p["small"].row_count == 4
    approx = {r.column_name: r.distinct_count for r in profile.column_profile(df, exact=False).collect()}
    assert approx["small"] == 4
    narrow = profile.narrow_types(df)
    types = dict(narrow.dtypes)
    assert types["small"] == "tinyint" and types["mid"] == "int" and types["f"] == "float"
    assert sorted(r.small for r in narrow.collect()) == [1, 2, 3, 4]
    sizes = {r.column_name: r.bytes for r in profile.size_profile(df).collect()}
    assert sizes["cat"] == 4 and sizes["__total__"] == sum(v for k, v in sizes.items() if k != "__total__")


def test_observed_metrics(spark):
    df = spark.range(10).withColumn("risk_score", F.col("id").cast("int"))
    out, obs = profile.observed(df)
    out.write.format("noop").mode("overwrite").save()
    assert obs.get == {"row_count": 10, "max_risk": 9}


def test_burst_hot_key_across_partitions(spark):
    rng = random.Random(11)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(1200):
        hot = i % 3 == 0
        key = 0 if hot else 1 + rng.randrange(30)
        # the hot key has dense bursts separated by quiet hours
        sec = (i // 60) * 7200 + rng.randrange(900) if hot else rng.randrange(200_000)
        rows.append((i, key, base + timedelta(seconds=sec)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    ordered = sorted(rows, key=lambda r: (str(r[1]), r[2], r[0]))
    want = dict(zip((r[0] for r in ordered), burst_flags_python([(str(r[1]), r[2].timestamp()) for r in ordered], 4, 300)))
    for parts in (3, 16, 40):
        got = {r.event_id: r.admitted for r in burst_flags(df, "user_id", "ts", 4, 300, partitions=parts).collect()}
        assert got == want, parts
