"""Prefix scans against whole-series loops, and what the plans look like."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import quality, scan, tenancy
from gridspark.streaming import ingest


def rows_of(n, keys, seed=3):
    rng = random.Random(seed)
    weights = [6] + [1] * (keys - 1)  # one key has most rows
    return [(rng.choices([None, *range(1, keys)], weights)[0], i, rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]


def slow(rows):
    """(sum, lowest, last known, last known before, next known) of each row."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        s, low, last = 0, None, None
        for _, i, x in mine:
            before = last
            if x is not None:
                s, low, last = s + x, x if low is None else min(low, x), x
            out[i] = [s, low, last, before]
        after = None
        for _, i, x in reversed(mine):
            after = x if x is not None else after
            out[i].append(after)
    return out


@pytest.mark.parametrize("n,keys,chunks", [(500, 5, 7), (300, 1, 16), (40, 30, 50), (1, 1, 3), (0, 1, 3)])
def test_scans_equal_loops(spark, n, keys, chunks):
    rows = rows_of(n, keys)
    df = spark.createDataFrame(rows, "k int, i long, x long").repartition(3)
    x = F.col("x")
    cut = scan.chunked(df, ["k"], ["i"], chunks)
    got = scan.scan(cut, ["k"], ["i"], {"s": scan.total(x), "low": scan.lowest(x), "last": scan.last_known(x), "before": scan.last_known_before(x), "next": scan.next_known(x)})
    assert {r.i: [r.s, r.low, r.last, r.before, r.next] for r in got.collect()} == slow(rows) and got.count() == n


def test_a_large_series_lies_in_many_chunks_and_windows_are_of_chunks(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, 1).otherwise(F.col("id")).alias("k"), "id")
    cut = scan.chunked(df, ["k"], ["id"], 12)
    assert cut.where("k = 1").select(scan.CHUNK).distinct().count() >= 10
    out = scan.scan(cut, ["k"], ["id"], {"s": scan.total(F.col("id"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in (x for x in plan.split("\n") if "Window [" in x):
        assert scan.CHUNK in line


def test_windows_of_limited_reach(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", i, round(rng.uniform(0, 3000), 1) if i % 9 else 600.0) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, id long, at double").select("source", "id", F.timestamp_seconds("at").alias("ts"), F.lit(1000).alias("bytes"))
    got = {r.id: r for r in ingest.rate_10s(df, ["source"]).collect()}
    assert len(got) == 600
    for source, i, at in rows:
        near = [x for s, _, x in rows if s == source and at - 10 <= x <= at]
        assert got[i].window_chunks == len(near) and got[i].window_bytes == 1000 * len(near)


def test_gaps_at_the_edges_of_chunks(spark):
    rows = [("v", t, None if t % 50 not in (3, 4) else float(t)) for t in range(200)] + [("w", t, None) for t in range(9)]
    got = quality.fill_in_time(spark.createDataFrame(rows, "variable string, t int, value double"), ["variable"], "t")
    for r in got.collect():
        assert r.value == (None if r.variable == "w" else min(max(float(r.t), 3.0), 154.0))


def test_requests_beyond_the_quota_take_nothing(spark):
    """The sequence of the quota fixture: ok, ok, refused with reasons, release, ok."""
    rows = [("a", 1, "allocate", 2.0, 5.0), ("a", 2, "allocate", 3.0, 3.0), ("a", 3, "allocate", 100.0, 50.0), ("a", 4, "release", 3.0, 2.0), ("a", 5, "allocate", 1.0, 1.0), ("a", 6, "release", 50.0, None), ("b", 1, "allocate", 1.0, 0.0), (None, 9, "allocate", 1.0, None)]
    events = spark.createDataFrame(rows, "tenant_id string, event_id long, kind string, storage_tb double, jobs double")
    quotas = spark.createDataFrame([("a", 10.0, 10.0), (None, 1.0, None)], "tenant_id string, quota_storage_tb double, quota_jobs double")
    got = {(r.tenant_id, r.event_id): r for r in tenancy.allocate(events, quotas, ("storage_tb", "jobs")).collect()}
    assert [got["a", i].granted for i in range(1, 7)] == [True, True, False, True, True, True]
    assert got["a", 3].reasons == ["storage_tb: 105.00 > 10.00", "jobs: 58.00 > 10.00"] and [got["a", i].used_storage_tb for i in range(1, 7)] == [2, 5, 5, 2, 3, 0]
    assert [got["a", i].used_jobs for i in range(1, 7)] == [5, 8, 8, 6, 7, 7]
    assert not got["b", 1].granted and got[None, 9].granted and got[None, 9].used_storage_tb == 1
    assert tenancy.allocate(events.where("false"), quotas, ("storage_tb", "jobs")).count() == 0
