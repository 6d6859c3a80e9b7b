"""Queries that run as streams over a table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import tenancy
from ..streaming import stateful
from . import virtual as v
from .catalog import query
from .scratch import scratch_path

RULES = stateful.Rules(capacity=3, service=1800.0, idle=4 * 3600.0)
PIECES = 3


def _at(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _records(spark, d) -> DataFrame:
    """Events as records of their type: of a hundred the 60th stops it, the 80th starts it again."""
    n = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    e = v.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 1000 + 1).alias("bytes"), n.alias("n"))
    return e.select("source", "id", "ts", "bytes", F.when(F.col("n") % 100 == 60, "stop").when(F.col("n") % 100 == 80, "start").otherwise("data").alias("kind"))


def _streamed(spark, d, name: str | None = None) -> DataFrame:
    """The records come in pieces by time; after each the stream is run, and begun again by its checkpoint for the next."""
    records = _records(spark, d)
    lo, hi = records.agg(F.min(_at()), F.max(_at())).first()
    root = scratch_path(spark, "ingest")
    for k in range(PIECES):
        piece = records.where((_at() >= lo + (hi - lo) * k // PIECES) & (_at() < (lo + (hi - lo) * (k + 1) // PIECES if k + 1 < PIECES else hi + 1)))
        piece.write.mode("append").parquet(f"{root}/in")
        stateful.run_ingest(spark, f"{root}/in", records.schema, f"{root}/out", f"{root}/checkpoint", RULES, files=1000, name=name)
    return spark.read.schema(stateful.EVENTS).parquet(f"{root}/out")


_US = stateful.SECOND
#: The state machine, a record of every source at a time.
_MACHINE = f"""rec AS (
    SELECT event_type AS source, event_id AS id, epoch_us(ts) AS tick, CAST(event_id % 1000 + 1 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n,
      CASE row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 100 WHEN 60 THEN 'stop' WHEN 80 THEN 'start' ELSE 'data' END AS kind FROM events),
  s AS (
    SELECT source, CAST(0 AS BIGINT) AS n, 'new' AS status, CAST(-1 AS BIGINT) AS session, CAST(0 AS BIGINT) AS last, CAST([] AS BIGINT[]) AS queue, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS tick, CAST(NULL AS BIGINT) AS bytes,
      'x' AS kind, CAST(NULL AS BIGINT) AS idle_at, CAST(-1 AS BIGINT) AS idle_session, FALSE AS ends, FALSE AS opens, CAST(NULL AS VARCHAR) AS fate, CAST(NULL AS BIGINT) AS finish FROM (SELECT DISTINCT source FROM rec)
    UNION ALL
    SELECT source, n, status, session, last, CASE WHEN fate = 'accepted' THEN list_append(queue, finish) ELSE queue END, id, tick, bytes, kind, idle_at, idle_session, ends, opens, fate, finish FROM (
      SELECT *, CASE WHEN fate = 'accepted' THEN greatest(tick, coalesce(queue[-1], tick)) + {round(RULES.service * _US)} END AS finish FROM (
        SELECT *, CASE WHEN kind = 'data' THEN CASE WHEN status = 'stopped' THEN 'stopped' WHEN len(queue) >= {RULES.capacity} THEN 'full' ELSE 'accepted' END END AS fate FROM (
          SELECT source, n, id, tick, bytes, kind, idle_at, idle_session, ends, opens, greatest(last, tick) AS last, CASE WHEN kind = 'stop' THEN 'stopped' WHEN opens THEN 'running' ELSE before END AS status,
            session + CASE WHEN opens THEN 1 ELSE 0 END AS session, CASE WHEN kind = 'data' THEN list_filter(queue, lambda f: f > tick) ELSE queue END AS queue FROM (
            SELECT *, kind = 'stop' AND before = 'running' AS ends, kind <> 'stop' AND before <> 'running' AND (kind = 'start' OR before <> 'stopped') AS opens FROM (
              SELECT s.source, rec.n, rec.id, rec.tick, rec.bytes, rec.kind, s.session, s.last, s.queue, s.session AS idle_session,
                CASE WHEN s.status = 'running' AND s.last + {round(RULES.idle * _US)} < rec.tick THEN s.last + {round(RULES.idle * _US)} END AS idle_at,
                CASE WHEN s.status = 'running' AND s.last + {round(RULES.idle * _US)} < rec.tick THEN 'idle' ELSE s.status END AS before
              FROM s JOIN rec ON rec.source = s.source AND rec.n = s.n + 1)))))),
  f AS (SELECT source, arg_max(status, n) AS status, arg_max(session, n) AS session, arg_max(last, n) + {round(RULES.idle * _US)} AS expiry FROM s GROUP BY source),
  found AS (
    SELECT source, 'ended' AS event, 'idle' AS reason, idle_session AS session, NULL AS id, idle_at AS tick, NULL AS bytes, NULL AS finish FROM s WHERE idle_at IS NOT NULL
    UNION ALL SELECT source, 'ended', 'idle', session, NULL, expiry, NULL, NULL FROM f WHERE status = 'running' AND expiry < (SELECT max(tick) FROM rec) - {3600 * _US}
    UNION ALL SELECT source, 'ended', 'stop', session, id, tick, NULL, NULL FROM s WHERE ends
    UNION ALL SELECT source, 'started', kind, session, id, tick, NULL, NULL FROM s WHERE opens
    UNION ALL SELECT source, 'accepted', NULL, session, id, tick, bytes, finish FROM s WHERE fate = 'accepted'
    UNION ALL SELECT source, 'refused', fate, CASE WHEN fate = 'stopped' THEN greatest(session, 0) ELSE session END, id, tick, bytes, NULL FROM s WHERE fate IN ('full', 'stopped'))"""


@query(f"WITH RECURSIVE {_MACHINE} SELECT source, event, reason, session, id, tick AS at, bytes, finish FROM found")
def ingest_stream(spark, d) -> DataFrame:
    return _streamed(spark, d).drop("lane")


@query(f"""WITH RECURSIVE {_MACHINE} SELECT source, count_if(event = 'started') AS sessions, count_if(event = 'accepted') AS accepted, count_if(event = 'refused' AND reason = 'full') AS refused_full, count_if(event = 'refused' AND reason = 'stopped') AS refused_stopped,
  CAST(coalesce(sum(CASE WHEN event = 'accepted' THEN bytes END), 0) AS BIGINT) AS bytes, count_if(event = 'ended' AND reason = 'idle') AS ended_idle FROM found GROUP BY 1""")
def ingest_dashboard(spark, d) -> DataFrame:
    return stateful.totals(stateful.replay(_records(spark, d), RULES))


@query("SELECT (SELECT count(*) FROM events) AS rows, CAST(3 AS BIGINT) AS batches, TRUE AS timed, CAST(0 AS BIGINT) AS dropped")
def stream_metrics(spark, d) -> DataFrame:
    """What a listener was told of the runs: their rows are the table's."""
    with stateful.measured(spark) as told:
        records = _records(spark, d).select(F.col("source"), "id", "ts", "bytes", "kind")
        root = scratch_path(spark, "metrics")
        for k in range(PIECES):
            records.where(F.col("id") % PIECES == k).write.mode("append").parquet(f"{root}/in")
            with stateful.rocksdb(spark):
                stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
                q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").queryName("metrics").trigger(availableNow=True).start()
                q.awaitTermination()
            told.wait(q.runId)
        rows = told.table(spark).where("query = 'metrics' AND rows > 0")
    return rows.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("batches"), F.min(F.col("rows_per_second") > 0).alias("timed"), F.sum("dropped").alias("dropped"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE [value, CASE WHEN value > 300 THEN NULL ELSE -value END, event_id % 50] END AS v FROM events)
  SELECT event_id, CASE WHEN v IS NULL THEN 'failed' ELSE 'processed' END AS status, len(list_filter(v, lambda x: x IS NOT NULL)) AS points, len(list_filter(v, lambda x: x < 0)) AS n_low, len(list_filter(v, lambda x: x > 400)) AS n_high FROM c""")
def chunk_pipeline(spark, d) -> DataFrame:
    """Chunks with their points as JSON, some of it cut off."""
    points = F.to_json(F.struct(F.array(F.col("value"), F.when(F.col("value") <= 300, -F.col("value")), (F.col("event_id") % 50).cast("double")).alias("v")))
    points = F.regexp_extract(points, r"\[.*\]", 0)
    chunks = v.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.substring(points, 1, 9)).otherwise(points).alias("payload"))
    out = stateful.chunk_summaries(chunks, [("n_low", lambda x: x < 0), ("n_high", lambda x: x > 400)], ["event_id"])
    return out.select("event_id", "status", *[F.col(c).cast("long").alias(c) for c in ("points", "n_low", "n_high")])


# Allocation against quotas, in the order of requests

_QUOTA = {"storage_tb": 4000.0, "jobs": 40.0}


@query(f"""WITH RECURSIVE q AS (
    SELECT event_id, user_id % 20 AS tenant_id, CASE WHEN event_id % 3 = 0 THEN 'release' ELSE 'allocate' END AS kind, round(value, 2) AS storage_tb, CAST(event_id % 8 AS DOUBLE) AS jobs, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
  u AS (
    SELECT DISTINCT tenant_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, TRUE AS granted, 0 AS over, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS j FROM q
    UNION ALL
    SELECT tenant_id, n, event_id, over = 0, over, CASE WHEN kind = 'release' THEN greatest(0, s - storage_tb) WHEN over = 0 THEN s + storage_tb ELSE s END, CASE WHEN kind = 'release' THEN greatest(0, j - jobs) WHEN over = 0 THEN j + jobs ELSE j END FROM (
      SELECT q.*, u.s, u.j, CASE WHEN kind = 'release' THEN 0 ELSE CASE WHEN u.s + storage_tb > {_QUOTA['storage_tb']} THEN 1 ELSE 0 END + CASE WHEN jobs > 0 AND u.j + jobs > {_QUOTA['jobs']} THEN 1 ELSE 0 END END AS over
      FROM u JOIN q ON q.tenant_id = u.tenant_id AND q.n = u.n + 1))
  SELECT event_id, tenant_id, granted, CAST(over AS BIGINT) AS n_reasons, round(s, 2) AS used_storage_tb, j AS used_jobs FROM u WHERE event_id IS NOT NULL""")
def tenant_allocation(spark, d) -> DataFrame:
    e = v.table(spark, d, "events")
    requests = e.select("event_id", (F.col("user_id") % 20).alias("tenant_id"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("allocate").alias("kind"), v.rounded(F.col("value"), 2).alias("storage_tb"), (F.col("event_id") % 8).cast("double").alias("jobs"))
    quotas = requests.select("tenant_id").distinct().select("tenant_id", *(F.lit(q).alias(f"quota_{r}") for r, q in _QUOTA.items()))
    out = tenancy.allocate(requests, quotas, tuple(_QUOTA))
    return out.select("event_id", "tenant_id", "granted", F.size("reasons").cast("long").alias("n_reasons"), v.rounded(F.col("used_storage_tb"), 2).alias("used_storage_tb"), "used_jobs")
