"""Ingestion as a keyed state machine: sessions, a bounded queue, timers, metrics.

Each source has a session state and a queue of ``capacity`` chunks, which one
worker serves in order, ``service`` seconds each. All decisions follow event time,
so that neither the cut into micro-batches nor a restart changes any of them:

* A source opens its first session with its first record that is no stop. ``stop``
  ends the session; data are refused (``stopped``) until ``start`` opens the next.
  A start while a session runs, and a stop while none does, change no session.
* A session that has had no record for ``idle`` seconds ends at that moment: by a
  timer, when the watermark passes it, or by the next record, whichever is first.
  That record, if it is data or a start, opens the next session.
* A chunk that arrives while ``capacity`` chunks wait or are served is refused
  (``full``); others are accepted, and ``finish`` is when the worker is done.

A source with very many chunks is dealt to ``lanes``, each a queue and a session of
its own; control records go to all lanes.
"""

from __future__ import annotations

import contextlib
import json
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "status string, session long, last long"
EVENTS = "source string, lane int, event string, reason string, session long, id long, at long, bytes long, finish long"
SECOND = 1_000_000
#: Events of a source that become a table at a time.
AT_ONCE = 10_000


@dataclass(frozen=True)
class Rules:
    """Seconds, and chunks that may wait or be served at once."""

    capacity: int = 10_000
    service: float = 0.0
    idle: float = 3600.0


class Source:
    """The state of one source and lane. Times are microseconds."""

    def __init__(self, rules: Rules, status: str = "new", session: int = -1, last: int = 0, queue: list[int] | None = None):
        self.rules, self.status, self.session, self.last, self.queue = rules, status, session, last, queue or []

    @property
    def expiry(self) -> int | None:
        """When the session ends if nothing comes."""
        return self.last + round(self.rules.idle * SECOND) if self.status == "running" else None

    def expire(self, now: int) -> Iterator[tuple]:
        """Ends an idle session, if its end lies before ``now``."""
        if self.expiry is not None and self.expiry < now:
            yield "ended", "idle", self.session, None, self.expiry, None, None
            self.status = "idle"

    def take(self, kind: str, id: int, at: int, size: int) -> Iterator[tuple]:
        """What a record brings about: (event, reason, session, id, at, bytes, finish)."""
        yield from self.expire(at)
        if kind == "stop":
            if self.status == "running":
                yield "ended", "stop", self.session, id, at, None, None
            self.status = "stopped"
        elif self.status != "running" and (kind == "start" or self.status != "stopped"):
            self.session, self.status = self.session + 1, "running"
            yield "started", kind, self.session, id, at, None, None
        self.last = max(self.last, at)
        if kind != "data":
            return
        self.queue = [f for f in self.queue if f > at]
        if self.status == "stopped":
            yield "refused", "stopped", max(self.session, 0), id, at, size, None
        elif len(self.queue) >= self.rules.capacity:
            yield "refused", "full", self.session, id, at, size, None
        else:
            done = max(at, self.queue[-1] if self.queue else at) + round(self.rules.service * SECOND)
            self.queue.append(done)
            yield "accepted", None, self.session, id, at, size, done


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Kind, id, at and bytes of a micro-batch's records of one source by time and
    id. They are held as numbers, 28 bytes a record, and become objects some at a time."""
    parts, known = [], {}
    for p in rows:
        codes, own = pd.factorize(p["kind"], use_na_sentinel=False)
        codes = np.array([known.setdefault(k, len(known)) for k in own], "i4")[codes]
        parts.append((codes, *(p[c].to_numpy("i8") for c in ("id", "at", "bytes"))))
    kind, id, at, size = (np.concatenate(x) for x in zip(*parts))
    names = list(known)
    del parts
    order = np.lexsort((id, at))
    for start in range(0, len(order), AT_ONCE):
        some = order[start : start + AT_ONCE]
        yield from zip((names[k] for k in kind[some]), id[some].tolist(), at[some].tolist(), size[some].tolist())


class Ingest(StatefulProcessor):
    """Value state for the session, list state for the queue, one timer for the idle end."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.queue = handle.getListState("queue", "finish long")

    def _load(self) -> Source:
        if not self.session.exists():
            return Source(self.rules)
        return Source(self.rules, *self.session.get(), [int(q[0]) for q in self.queue.get()] if self.queue.exists() else [])

    def _store(self, s: Source, before: int | None) -> None:
        self.session.update((s.status, s.session, s.last))
        self.queue.put([(f,) for f in s.queue]) if s.queue else self.queue.clear()
        if before != s.expiry:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            if s.expiry is not None:
                self.handle.registerTimer(s.expiry // 1000 + 1)

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        out = pd.DataFrame([(key[0], key[1], *f) for f in found], columns=names)
        return out.astype({"lane": "int32", "session": "Int64", "id": "Int64", "at": "Int64", "bytes": "Int64", "finish": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        before, found = s.expiry, []
        for record in in_order(rows):
            found += s.take(*record)
            if len(found) >= AT_ONCE:
                yield self._rows(key, found)
                found = []
        self._store(s, before)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        before, found = s.expiry, list(s.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000))
        if found:
            self.session.update((s.status, s.session, s.last))
        elif before is not None:  # a record has come since
            self.handle.registerTimer(before // 1000 + 1)
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def dealt(records: DataFrame, lanes: int = 1, source: str = "source", id: str = "id", ts: str = "ts") -> DataFrame:
    """Records by source and lane: data by a hash of their id, control records once for each lane."""
    lane = F.when(F.col("kind") == "data", F.array(F.pmod(F.xxhash64(id), F.lit(lanes)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(lanes - 1)))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return records.select(F.col(source).cast("string").alias("source"), F.explode(lane).alias("lane"), "kind", F.col(id).cast("long").alias("id"), at.alias("at"), F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"), F.col(ts).cast("timestamp").alias("event_time"))


def ingest(records: DataFrame, rules: Rules, lanes: int = 1, late: str = "1 hour", **names) -> DataFrame:
    """Events (columns EVENTS) of a stream of records: source, kind (start, stop,
    data), id, ts, bytes. Records of a micro-batch are taken in order of time and
    id; records more than ``late`` behind the newest are left out."""
    timed = dealt(records, lanes, **names).withWatermark("event_time", late)
    return timed.groupBy("source", "lane").transformWithStateInPandas(Ingest(rules), EVENTS, "append", "eventTime")


def replay(records: DataFrame, rules: Rules, lanes: int = 1, late: float = 3600.0, **names) -> DataFrame:
    """The same events of a finished table, a source and lane at a time; sessions
    that are idle when the newest record less ``late`` seconds is reached have ended.
    The records come sorted, so a task holds the state of one source and lane, and
    a batch of records, however many there are."""
    rows = dealt(records, lanes, **names).drop("event_time")
    end = rows.agg(F.max("at")).first()[0]
    rows = rows.repartition("source", "lane").sortWithinPartitions("source", "lane", "at", "id").select("source", "lane", "kind", "id", "at", "bytes")
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in EVENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, found = None, None, []

        def ended() -> list[tuple]:
            return [(*key, *f) for f in s.expire(int(end - late * SECOND))] if s else []

        for batch in batches:
            for source, lane, *record in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (source, lane):
                    found += ended()
                    key, s = (source, lane), Source(rules)
                found += [(*key, *f) for f in s.take(*record)]
                if len(found) >= AT_ONCE:
                    yield table(found)
                    found = []
        found += ended()
        if found:
            yield table(found)

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return rows.mapInArrow(run, EVENTS)


def totals(events: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """The dashboard: what came of each source's chunks, over its lanes."""
    n = lambda when: F.count_if(when)
    e, why = F.col("event"), F.col("reason")
    return events.groupBy(*by).agg(
        n(e == "started").alias("sessions"), n(e == "accepted").alias("accepted"), n((e == "refused") & (why == "full")).alias("refused_full"), n((e == "refused") & (why == "stopped")).alias("refused_stopped"),
        F.coalesce(F.sum(F.when(e == "accepted", F.col("bytes"))), F.lit(0)).alias("bytes"), n((e == "ended") & (why == "idle")).alias("ended_idle"),
    )


def chunk_summaries(chunks: DataFrame, checks: list, keys: list[str], payload: str = "payload", points: str = "array<double>", clean=None) -> DataFrame:
    """The pipeline of each chunk: its points from JSON, cleaned by ``clean`` (a
    function of a column) and checked (functions of a column, true where a point
    fails). status is failed where the payload is no such list, else processed;
    nothing that one chunk holds stops the others."""
    parsed = F.from_json(F.concat(F.lit('{"v":'), F.col(payload), F.lit("}")), f"v {points}").getField("v")
    values = F.filter(clean(parsed) if clean else parsed, lambda x: x.isNotNull())
    out = chunks.withColumn("_v", values)
    counts = [F.size(F.filter("_v", check)).alias(name) for name, check in checks]
    return out.select(*keys, F.when(F.col("_v").isNull(), "failed").otherwise("processed").alias("status"), F.when(F.col("_v").isNotNull(), F.size("_v")).alias("points"), *[F.when(F.col("_v").isNotNull(), c).alias(name) for c, (name, _) in zip(counts, checks)])


class Metrics(StreamingQueryListener):
    """Progress of the streams of a session as rows. The newest ``keep`` batches are
    held; ``wait`` waits until a stream's end has been told."""

    ROW = "query string, run string, batch long, at string, rows long, rows_per_second double, duration_ms long, state_rows long, dropped long"

    def __init__(self, keep: int = 10_000):
        from collections import deque

        self.rows, self.ended, self.lock = deque(maxlen=keep), {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators", [])
        row = (p.get("name"), p["runId"], p["batchId"], p["timestamp"], int(p.get("numInputRows", 0)), float(p.get("processedRowsPerSecond", 0) or 0), int(p.get("durationMs", {}).get("triggerExecution", 0)), sum(s.get("numRowsTotal", 0) for s in state), sum(s.get("numRowsDroppedByWatermark", 0) for s in state))
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def wait(self, run: str, seconds: float = 60) -> bool:
        return self._end(str(run)).wait(seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            rows = list(self.rows)
        return spark.createDataFrame(rows, self.ROW)


@contextlib.contextmanager
def measured(spark: SparkSession):
    """Within it a listener hears of all streams of the session."""
    listener = Metrics()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams begun within it keep their state in RocksDB, which list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_ingest(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, rules: Rules, lanes: int = 1, late: str = "1 hour", files: int = 1, name: str | None = None):
    """Takes what has come to ``path`` since the last run (``files`` files a batch),
    appends its events to ``out`` and ends; state is carried over by ``checkpoint``."""
    with rocksdb(spark):
        records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        writer = ingest(records, rules, lanes, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = (writer.queryName(name) if name else writer).start()
        query.awaitTermination()
    return query
