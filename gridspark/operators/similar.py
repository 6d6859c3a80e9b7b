"""Search of events by combined similarity: half the length and half the shape
make the likeness in time, the agreement of the variables' means that in space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import fingerprint

FEATURES = ("mean", "std", "min", "max", "p25", "p50", "p75", "skew", "kurt")
#: Parts of the score by time and by space.
WEIGHTS = (0.6, 0.4)


def described(df: DataFrame, event: list[str], axis: Column | None = None, variable: str = "variable") -> DataFrame:
    """A row for each event of a long table (event..., variable, value): ``vector``
    (the nine features of all its values), ``means`` by variable, and ``duration``,
    the span of ``axis`` (0 without one). Events without a finite value have no row,
    variables without one no mean."""
    out = fingerprint.event_database(df, event, variable).withColumn("vector", F.array(*(F.col(c).cast("double") for c in FEATURES)))
    out = out.select(*event, "vector", F.map_filter("means", lambda _, m: m.isNotNull()).alias("means"))
    if axis is None:
        return out.withColumn("duration", F.lit(0.0))
    return out.join(df.groupBy(*event).agg((F.max(axis) - F.min(axis)).cast("double").alias("duration")), event)


def find(events: DataFrame, queries: DataFrame, top: int = 20, weights: tuple[float, float] = WEIGHTS, block_bytes: int = fingerprint.QUERY_BYTES) -> DataFrame:
    """For each query (query_id, duration, vector, means) the ``top`` events
    (event_id, duration, vector, means) of the highest combined score, itself left
    out: query_id, event_id, score, temporal, spatial, rank. Scores count to nine
    decimals, ties go by event_id.

    A null duration is 0; vectors that are null, empty or of another length give 0
    in time; means that are null or NaN are no variable, and without a common one
    the part in space is 0. An event without id is found by no query.

    The queries are a stated set, held against all events, a block of bounded size
    at a time; a task keeps the best of what it has seen, so that a row for each
    query, place and task is shuffled and no pair.
    """
    n = F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.size("means")), F.lit(0)), F.count(F.lit(1))
    width, names, count = queries.agg(*n).first()
    room = max(1, block_bytes // (8 * (max(width, 0) + 3 * max(names, 0) + 4 * top + 1)))
    n_blocks = max(1, -(-count // room))
    kinds = dict(queries.dtypes)["query_id"], dict(events.dtypes)["event_id"]
    arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(events.schema["event_id"].dataType)
    plain = [F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("means").cast("map<string,double>").alias("means")]
    asked = queries.select("query_id", *plain).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    own = events.where("event_id IS NOT NULL").select("event_id", *plain)
    found = None
    for block in range(n_blocks):
        rows = asked.where(F.col("_block") == block).drop("_block").collect()  # one block of bounded size
        if rows:
            part = own.mapInArrow(_best(rows, top, weights, arrow), f"query_id {kinds[0]}, event_id {kinds[1]}, score double, temporal double, spatial double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.lit(None)
        return own.limit(0).select(none.cast(kinds[0]).alias("query_id"), "event_id", *(none.cast("double").alias(c) for c in ("score", "temporal", "spatial")), none.cast("int").alias("rank"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "event_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def by_pattern(events: DataFrame, pattern: DataFrame, axis: Column | None = None, top: int = 20, variable: str = "variable") -> DataFrame:
    """The events most like a dataset (variable, value): one query of id ``query``."""
    one = described(pattern.withColumn("query_id", F.lit("query")), ["query_id"], axis, variable)
    return find(events, one, top)


class _Queries:
    """A block of queries as matrices: units of the vectors by their length, means by variable."""

    def __init__(self, rows: list):
        self.ids = [r.query_id for r in rows]
        self.duration = np.array([r.duration for r in rows])
        self.units = _by_length([r.vector for r in rows])
        self.names = sorted({k for r in rows for k in (r.means or {})})
        self.means = {k: np.array([_number((r.means or {}).get(k)) for r in rows]) for k in self.names}

    def scores(self, duration: np.ndarray, vectors: dict, means: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Likeness in time and in space, a row for each query, a column for each event."""
        shape = len(self.ids), len(duration)
        d, q = duration[None], self.duration[:, None]
        length = 1 - np.minimum(np.abs(d - q) / np.maximum(np.maximum(d, q), 1.0), 1.0)
        temporal = np.zeros(shape)
        for n, (at, units) in self.units.items():
            if n in vectors:
                fits, own = vectors[n]
                angle = np.clip(units @ own.T, 0, 1)
                place = np.ix_(at, fits)
                temporal[place] = 0.5 * length[place] + 0.5 * angle
        total, common = np.zeros(shape), np.zeros(shape)
        for name, own in self.means.items():
            if name in means:
                a, b = own[:, None], means[name][None]
                with np.errstate(invalid="ignore"):
                    one = 1 - np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-10)
                both = ~np.isnan(a) & ~np.isnan(b)
                total += np.where(both, one, 0.0)
                common += both
        return temporal, np.divide(total, common, out=np.zeros(shape), where=common > 0)


def _by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length, but 0, where they stand, and their units."""
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v:
            lengths.setdefault(len(v), []).append(i)
    return {n: (np.array(at), fingerprint._unit(np.array([vectors[i] for i in at], float))) for n, at in lengths.items()}


def _number(x: float | None) -> float:
    return np.nan if x is None else x


def _best(rows: list, top: int, weights: tuple[float, float], kinds: tuple, at_once: int = fingerprint.EVENTS_AT_ONCE):
    blocks = [_Queries(rows[i : i + fingerprint.QUERIES_AT_ONCE]) for i in range(0, len(rows), fingerprint.QUERIES_AT_ONCE)]
    asked = [name for block in blocks for name in block.ids]
    variables = sorted({k for block in blocks for k in block.names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fingerprint._Top(asked, top, 2)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                ids = np.array([*batch.column(0).to_pylist(), None], object)[:-1]
                maps = [dict(m) if m else {} for m in batch.column(3).to_pylist()]
                means = {k: np.array([_number(m.get(k)) for m in maps]) for k in variables}
                duration, units = batch.column(1).to_numpy(zero_copy_only=False), _by_length(batch.column(2).to_pylist())
                first = 0
                for block in blocks:
                    temporal, spatial = block.scores(duration, units, means)
                    found.take(first, ids, np.round(weights[0] * temporal + weights[1] * spatial, 9), temporal, spatial)
                    first += len(block.ids)
        for name, (s, i, t, p) in zip(asked, found.kept):
            if len(s):
                columns = [pa.array([name] * len(s), kinds[0]), pa.array(i.tolist(), kinds[1]), *(pa.array(x, pa.float64()) for x in (s, t, p))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "event_id", "score", "temporal", "spatial"])

    return run
