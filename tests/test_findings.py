"""What reviews of the third round found, on small tables."""

import tracemalloc
from collections import namedtuple

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gridspark.operators import fingerprint, similar, tenancy
from gridspark.plans import catalog
from gridspark.streaming import stateful


def compare(spark, tmp_path, name: str, tables: dict) -> list:
    """The query's rows over tables (rows and their schema), which equal its SQL's."""
    c = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = c.sql(catalog.oracle_sql()[name])
    found = sorted(df.select(*want.columns).collect(), key=str)
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want.fetchall()))
    return found


def test_rates_over_no_cells_are_zero(spark, tmp_path):
    """Every cell's price is above the threshold: there is no miss."""
    lines = [(p, s, n, 50000.0 + p) for p in range(4) for s in range(2) for n in range(3)]
    got = compare(spark, tmp_path, "roc_curve", {
        "part": ([(p, p) for p in range(4)], "p_partkey long, p_size int"),
        "supplier": ([(s, s) for s in range(2)], "s_suppkey long, s_nationkey int"),
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double"),
    })
    assert len(got) == 100 and {(r.tpr, r.fpr) for r in got} == {(1.0, 0.0)}


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_searches_hold_few_queries_at_a_time():
    """6,000 queries against 2,048 events: a matrix of all of them would be 98 MB, and several are held."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6000, 4))
    kinds = pa.int64(), pa.int64()
    events = pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array(vectors[:2048].tolist())], ["event_id", "vector"])
    full = pa.RecordBatch.from_arrays([events[0], pa.array(rng.normal(size=2048)), events[1], pa.array([[("a", 1.0)]] * 2048, pa.map_(pa.string(), pa.float64()))], ["event_id", "duration", "vector", "means"])
    Query = namedtuple("Query", "query_id duration vector means")
    rows = [Query(i, 1.0, v, {"a": 2.0}) for i, v in enumerate(vectors.tolist())]
    near, combined = fingerprint._top_of(list(range(6000)), fingerprint._unit(vectors), 3, kinds), similar._best(rows, 3, (0.6, 0.4), kinds)
    assert peak_mb(lambda: [len(b) for b in near(iter([events]))]) < 60
    assert peak_mb(lambda: [len(b) for b in combined(iter([full]))]) < 90
    top = pa.Table.from_batches(near(iter([events]))).to_pandas().groupby("query_id").event_id.apply(list)
    scores = fingerprint._unit(vectors) @ fingerprint._unit(vectors[:2048]).T
    np.fill_diagonal(scores, -2)
    assert all(sorted(top[q]) == sorted(np.argsort(-scores[q])[:3]) for q in range(0, 6000, 100))


def test_a_source_is_never_held_whole(spark):
    """400,000 records of one source: as objects they would take some hundred MB."""
    n = 400_000
    frames = lambda: (pd.DataFrame({"kind": "data", "id": range(i, i + 10_000), "at": range(n - i, n - i - 10_000, -1), "bytes": 1}) for i in range(0, n, 10_000))
    assert peak_mb(lambda: sum(1 for _ in stateful.in_order(frames()))) < 60
    got = list(stateful.in_order(frames()))
    assert len(got) == n and got[0] == ("data", n - 1, 1, 1) and got[-1] == ("data", 0, n, 1)
    records = spark.range(30_000).select(F.lit("s").alias("source"), F.lit("data").alias("kind"), "id", F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("bytes"))
    out = stateful.replay(records, stateful.Rules())
    assert "MapInArrow" in out._jdf.queryExecution().toString() and "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert out.groupBy("event").count().collect() and out.where("event = 'accepted'").count() == 30_000


def test_no_change_is_sorted_for_its_dataset(spark):
    changes = spark.range(1000).select((F.col("id") % 7).alias("dataset"), F.col("id").alias("created_at"), F.lit("patch").alias("change_type"))
    plan = tenancy.latest_versions(changes)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") >= 4


def test_edges_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            read.add(1)
            yield r.source, r.target

    pairs = [(i + 1, i) for i in range(20)] + [(0, 20), (1, 0)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).toDF("source long, target long").rdd.mapPartitions(seen), "source long, target long")
    got = tenancy.lineage(spark, edges, spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.steps for r in got.collect()} == {i: i for i in range(21)}
    assert read.value == len(pairs)
