"""Ingestion of chunks: rates, sessions, counters, batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scan

#: Seconds of a source that a window of ten seconds is worked out for at once.
STRETCH = 600


def rate_10s(chunks: DataFrame, by: list[str], ts: str = "ts", size: str = "bytes") -> DataFrame:
    """Megabits a second over the ten seconds up to each chunk, of its own source
    (``by``). A single chunk in the window has no rate. A source is dealt to
    stretches of time, each with the ten seconds before it."""
    dealt = scan.neighbours(chunks.withColumn("_t", F.col(ts).cast("timestamp").cast("double")), by, F.col("_t"), 10, STRETCH)
    w = W.partitionBy(*by, "_stretch").orderBy("_t").rangeBetween(-10, 0)
    t = F.col("_t")
    total, n, first = F.sum(size).over(w), F.count(F.lit(1)).over(w), F.min(t).over(w)
    rate = F.when((n > 1) & (t > first), total * 8 / ((t - first) * 1e6)).otherwise(0.0)
    return dealt.withColumns({"window_bytes": total, "window_chunks": n, "mbps": rate}).where("_own").drop("_t", "_stretch", "_own")


def sessions(records: DataFrame, source: str = "source", order: list[str] = ["ts", "id"]) -> DataFrame:  # noqa: B006
    """Replays control and data records: ``kind`` start, stop or data, ``bytes``.
    A source runs from the beginning; a start opens a new session unless one
    runs; data while stopped are rejected. Adds session, running, accepted, and
    the counts and bytes so far in the session and in all."""
    control = F.when(F.col("kind") != "data", F.col("kind"))
    data, size = F.col("kind") == "data", F.coalesce(F.col("bytes"), F.lit(0))
    out = scan.scan(scan.chunked(records, [source], order), [source], order, {"_state": scan.last_known(control), "_before": scan.last_known_before(control)})
    running, before = F.coalesce(F.col("_state") != "stop", F.lit(True)), F.coalesce(F.col("_before") != "stop", F.lit(True))
    out = out.withColumns({"running": running, "_new": ((F.col("kind") == "start") & ~before).cast("int"), "accepted": data & running})
    one, taken, refused = F.col("accepted").cast("long"), F.when(F.col("accepted"), size).otherwise(0), (data & ~F.col("accepted")).cast("long")
    out = scan.scan(out, [source], order, {"session": scan.total(F.col("_new")), "total_chunks": scan.total(one), "total_bytes": scan.total(taken), "rejected": scan.total(refused)})
    out = scan.scan(out, [source, "session"], order, {"session_chunks": scan.total(one), "session_bytes": scan.total(taken)})
    added = ("session", "running", "accepted", "session_chunks", "session_bytes", "total_chunks", "total_bytes", "rejected")
    return out.select(*records.columns, *added)


def dashboard(replayed: DataFrame, source: str = "source", order: list[str] = ["ts", "id"]) -> DataFrame:  # noqa: B006
    """The last state of each source, as columns and as JSON."""
    last = replayed.groupBy(source).agg(F.max_by(F.struct("session", "running", "session_chunks", "session_bytes", "total_chunks", "total_bytes", "rejected"), F.struct(*order)).alias("s"))
    return last.select(source, "s.*", F.to_json("s").alias("json"))


STATE = "session long, running boolean, session_chunks long, session_bytes long, total_chunks long, total_bytes long, rejected long"


def session_stream(records: DataFrame, source: str = "source") -> DataFrame:
    """The same as a stream: state for each source, one row out for each batch
    in which it had records. Records of a batch are taken in order of time."""

    def advance(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [0, True, 0, 0, 0, 0, 0]
        rows = pd.concat(list(parts))
        for r in rows.sort_values(["ts", "id"]).itertuples():
            if r.kind == "start" and not s[1]:
                s[0], s[1], s[2], s[3] = s[0] + 1, True, 0, 0
            elif r.kind == "stop":
                s[1] = False
            elif r.kind == "data" and s[1]:
                s[2], s[3], s[4], s[5] = s[2] + 1, s[3] + int(r.bytes), s[4] + 1, s[5] + int(r.bytes)
            elif r.kind == "data":
                s[6] += 1
        state.update(tuple(s))
        names = [c.split()[0] for c in STATE.split(", ")]
        yield pd.DataFrame([[*key, *s]], columns=[source, *names])

    kind = dict(records.dtypes)[source]
    return records.groupBy(source).applyInPandasWithState(advance, f"{source} {kind}, {STATE}", STATE, "update", "NoTimeout")


def windowed(stream: DataFrame, by: list[str], ts: str = "ts", width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows, with a watermark for late data."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = timed.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def gaps(df: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Runs of activity without a pause of ``gap``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def each_batch(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs ``pipeline`` on every micro-batch and appends to ``path``, the folder
    named by the batch, so that a batch done again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_stats(chunks: DataFrame, by: list[str], ts: str = "ts", size: str = "bytes", every: int = 5) -> DataFrame:
    """Bits a second since the start of each source, at the end of each stretch of
    ``every`` seconds that brought chunks. Stretches are summed first; the running
    sum is over these."""
    t = F.floor(F.col(ts).cast("timestamp").cast("double") / every) * every
    sums = chunks.groupBy(*by, t.alias("tick")).agg(F.sum(size).alias("_b"), F.min(F.col(ts).cast("timestamp").cast("double")).alias("_t"))
    out = scan.scan(scan.chunked(sums, by, ["tick"]), by, ["tick"], {"bytes": scan.total(F.col("_b")), "_first": scan.lowest(F.col("_t"))})
    return out.select(*by, "tick", "bytes", (F.col("bytes") * 8 / (F.col("tick") + every - F.col("_first"))).alias("bps"))


def stopped(records: DataFrame, at, source: str = "source") -> DataFrame:
    """The records and a stop for every source at the time given: the manager stops them all."""
    stops = records.select(source).distinct().withColumns({"kind": F.lit("stop"), "ts": at, "bytes": F.lit(0)})
    return records.unionByName(stops, allowMissingColumns=True)


def batch_retained(batch: DataFrame, days: int, as_of, order: list[str], ts: str = "ts") -> DataFrame:
    """A whole batch, or none of it: the first row's time decides."""
    first = batch.agg(F.min_by(ts, F.struct(*order)).alias("_first"))
    return batch.crossJoin(F.broadcast(first)).where(F.col("_first") >= as_of - F.expr(f"INTERVAL {days} DAYS")).drop("_first")  # one row
