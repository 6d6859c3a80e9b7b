"""Ingestion as a state machine: decisions, micro-batches, restarts, timers, metrics."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.streaming import stateful
from gridspark.streaming.stateful import SECOND, Rules, Source

T0 = dt.datetime(2024, 1, 1)
RECORDS = "source string, kind string, id long, ts timestamp_ntz, bytes long"


def taken(rules, records):
    s, out = Source(rules), []
    for k, (kind, seconds, size) in enumerate(records):
        out += [(e, why, session, at // SECOND, done if done is None else done // SECOND) for e, why, session, _, at, _, done in s.take(kind, k, seconds * SECOND, size)]
    return out


def test_sessions_begin_and_end():
    got = taken(Rules(idle=100), [("data", 0, 1), ("start", 1, 0), ("stop", 2, 0), ("data", 3, 1), ("stop", 4, 0), ("start", 5, 0), ("data", 6, 1), ("data", 106, 1), ("data", 207, 1)])
    assert got == [
        ("started", "data", 0, 0, None), ("accepted", None, 0, 0, 0), ("ended", "stop", 0, 2, None), ("refused", "stopped", 0, 3, None), ("started", "start", 1, 5, None), ("accepted", None, 1, 6, 6),
        ("accepted", None, 1, 106, 106), ("ended", "idle", 1, 206, None), ("started", "data", 2, 207, None), ("accepted", None, 2, 207, 207),
    ]


def test_a_stopped_source_stays_stopped_and_a_stop_first_opens_nothing():
    assert taken(Rules(idle=10), [("stop", 0, 0), ("data", 500, 1), ("start", 600, 0)]) == [("refused", "stopped", 0, 500, None), ("started", "start", 0, 600, None)]


def test_a_full_queue_refuses():
    got = taken(Rules(capacity=2, service=10), [("data", t, 1) for t in (0, 1, 2, 10, 11, 40)])
    assert [(e, why, at, done) for e, why, _, at, done in got if e != "started"] == [
        ("accepted", None, 0, 10), ("accepted", None, 1, 20), ("refused", "full", 2, None), ("accepted", None, 10, 30), ("refused", "full", 11, None), ("accepted", None, 40, 50),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["data", "data", "data", "stop", "start"]), st.integers(0, 30)), max_size=40), st.integers(1, 4), st.integers(0, 20), st.integers(1, 25))
def test_counts_add_up(steps, capacity, service, idle):
    at, records = 0, []
    for kind, gap in steps:
        at += gap
        records.append((kind, at, 1))
    got = taken(Rules(capacity, service, idle), records)
    fates = [x for x in got if x[0] in ("accepted", "refused")]
    assert len(fates) == sum(k == "data" for k, _, _ in records)
    opened, closed = sum(x[0] == "started" for x in got), sum(x[0] == "ended" for x in got)
    assert opened - closed in (0, 1)
    done = [(x[3], x[4]) for x in got if x[0] == "accepted"]
    for a, _ in done:  # never more than the capacity in the queue
        assert sum(x <= a < f for x, f in done) <= capacity or service == 0


def records(spark, n=400):
    rows = [(f"s{i % 3}", "stop" if i % 40 == 30 else "start" if i % 40 == 35 else "data", i, T0 + dt.timedelta(seconds=37 * i + (4000 if i > 250 else 0) + (i * i) % 11), i % 17) for i in range(n)]
    return rows, spark.createDataFrame(rows, RECORDS)


@pytest.mark.parametrize("lanes", [1, 3])
def test_a_stream_with_restarts_equals_the_replay(spark, tmp_path, lanes):
    rules = Rules(capacity=2, service=1500, idle=1500)
    rows, df = records(spark)
    for k in range(3):
        spark.createDataFrame(rows[k * 150 : (k + 1) * 150], RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stateful.run_ingest(spark, str(tmp_path / "in"), RECORDS, str(tmp_path / "out"), str(tmp_path / "cp"), rules, lanes)
    got = spark.read.schema(stateful.EVENTS).parquet(str(tmp_path / "out"))
    want = stateful.replay(df, rules, lanes)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.event, r.reason) for r in want.collect()} >= {("ended", "idle"), ("refused", "full"), ("refused", "stopped"), ("started", "start")}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB
    dash = {r.source: r for r in stateful.totals(want).collect()}
    assert sum(r.accepted + r.refused_full + r.refused_stopped for r in dash.values()) == sum(r[1] == "data" for r in rows)


def test_a_timer_ends_an_idle_session_without_a_record(spark, tmp_path):
    rows = [("quiet", "data", 1, T0, 5)] + [("busy", "data", 10 + i, T0 + dt.timedelta(minutes=10 * i), 5) for i in range(30)]
    spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stateful.run_ingest(spark, str(tmp_path / "in"), RECORDS, str(tmp_path / "out"), str(tmp_path / "cp"), Rules(idle=1800))
    got = spark.read.schema(stateful.EVENTS).parquet(str(tmp_path / "out")).where("event = 'ended'").collect()
    assert [(r.source, r.reason, r.at) for r in got] == [("quiet", "idle", int(T0.replace(tzinfo=dt.UTC).timestamp() + 1800) * SECOND)]


def test_nothing_and_nulls(spark):
    assert stateful.replay(spark.createDataFrame([], RECORDS), Rules()).count() == 0
    one = stateful.replay(spark.createDataFrame([(None, "data", 1, T0, None)], RECORDS), Rules()).collect()
    assert [(r.source, r.event, r.bytes) for r in one] == [(None, "started", None), (None, "accepted", 0)]


def test_chunks_fail_alone(spark):
    rows = [(1, "[1.0, null, -3]"), (2, "[1.0,"), (3, None), (4, "[]"), (5, '{"a": 1}'), (6, "[1e3]")]
    df = spark.createDataFrame(rows, "id long, payload string")
    out = stateful.chunk_summaries(df, [("n_low", lambda x: x < 0)], ["id"], clean=lambda v: F.transform(v, lambda x: F.when(x < 500, x)))
    assert [(r.id, r.status, r.points, r.n_low) for r in out.orderBy("id").collect()] == [(1, "processed", 2, 1), (2, "failed", None, None), (3, "failed", None, None), (4, "processed", 0, 0), (5, "failed", None, None), (6, "processed", 0, 0)]


def test_progress_becomes_a_table(spark, tmp_path):
    _, df = records(spark, 90)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    with stateful.measured(spark) as told:
        query = stateful.run_ingest(spark, str(tmp_path / "in"), RECORDS, str(tmp_path / "out"), str(tmp_path / "cp"), Rules(), late="1 day", name="measured")
        assert told.wait(query.runId)
    rows = told.table(spark).where("query = 'measured'")
    assert rows.agg(F.sum("rows")).first()[0] == 90 and rows.where("rows > 0").count() == 3 and rows.agg(F.max("state_rows")).first()[0] > 0
