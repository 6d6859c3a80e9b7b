"""Vectors as codes: an exact integer codebook for each part of them.

The vectors lie in a table of columnar blocks: for each dimension the values of
some thousand rows. A round reads the blocks as an RDD and sums up with
``treeAggregate``: distances grow dimension by dimension, ``np.add.at`` adds each
row to the int64 sums and counts of the entry it is assigned to, and these tensors
(parts x entries x components, whatever the input) merge through a tree of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, materialise
from .lookup import look_up
from .vectors import quantised, stacked

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_ROWS = 4096
#: Levels of the reduction tree.
DEPTH = 3


def column_blocks(rows: DataFrame, keep: list[str], dims: int) -> DataFrame:
    """A row for each block: lists of the columns ``keep``, and ``columns``, the
    block's int64 values dimension by dimension."""
    kinds = ", ".join(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in keep)
    arrow = [to_arrow_type(rows.schema[c].dataType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for at in range(0, some.num_rows, BLOCK_ROWS):
                part = some.slice(at, BLOCK_ROWS)
                values = np.ascontiguousarray(stacked(part.column(len(keep)), dims).T)
                lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(i).cast(t)) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([values.tobytes()], pa.binary())], [*keep, "columns"])

    return rows.select(*keep, "v").mapInArrow(run, f"{kinds}, columns binary")


def assign(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block (dims x rows) the nearest entry of each part's codebook, the
    lower of equal ones, and its squared distance: two arrays (parts x rows)."""
    parts, entries, size = codebooks.shape
    n = block.shape[1]
    codes, errors = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        distance = np.zeros((entries, n), np.int64)
        for d in range(size):
            gap = block[p * size + d][None, :] - codebooks[p, :, d][:, None]
            gap *= gap
            distance += gap
        codes[p] = distance.argmin(0)
        errors[p] = np.take_along_axis(distance, codes[p][None, :], 0)[0]
    return codes, errors


def _add(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = total
    parts, _, size = codebooks.shape
    codes, _ = assign(block, codebooks)
    for p in range(parts):
        np.add.at(sums[p], codes[p], block[p * size : (p + 1) * size].T)
        np.add.at(counts[p], codes[p], 1)
    return total


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a[0].__iadd__(b[0])
    a[1].__iadd__(b[1])
    return a


def refine(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all blocks."""
    context, dims = blocks.sparkSession.sparkContext, codebooks.shape[0] * codebooks.shape[2]
    for _ in range(rounds):
        known = context.broadcast(codebooks)

        def add(total, row, known=known):
            return _add(total, np.frombuffer(row.columns, "<i8").reshape(dims, -1), known.value)

        zero = (np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64))
        sums, counts = blocks.select("columns").rdd.treeAggregate(zero, add, _merge, DEPTH)
        used = counts > 0
        codebooks = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], codebooks)
        known.unpersist()
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes of all whole vectors of ``df`` and the codebooks (parts x entries
    x components). Columns: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component are left
    out. Vectors shorter than the longest count as filled up with zeros, and so does
    the longest where its length is no multiple of ``parts``. With fewer than
    ``entries`` rows a codebook has as many entries as there are rows; rows of equal
    key start it in the order of their vectors, rows without key last. Repeated rows
    each count and each have a row. Equal labels share a label_error, and so do null
    ones, however many there are: each row gets it by ``look_up``. An empty table
    gives an empty one. Other columns are not read. What goes through the driver are
    the codebooks alone.
    """
    named = df.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = quantised(named, "vector", ["k", "label"])
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v")
    start = [np.frombuffer(r.v, "<i8") for r in first.collect()]
    widest = rows.agg(F.max(F.octet_length("v"))).first()[0] or 0
    dims = max(1, -(-widest // 8 // parts)) * parts
    size = dims // parts
    codebooks = np.zeros((parts, len(start), size), np.int64)
    for i, v in enumerate(start):
        codebooks[:, i, :].flat[: len(v)] = v
        codebooks[:, i, :] = np.pad(v, (0, dims - len(v))).reshape(parts, size)
    blocks = materialise(column_blocks(rows, ["k", "label"], dims), "column-blocks")
    if start:
        codebooks = refine(blocks, codebooks, rounds)
    arrow = [to_arrow_type(named.schema[c].dataType) for c in ("k", "label")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for i in range(some.num_rows):
                block = np.frombuffer(some.column(2)[i].as_buffer(), "<i8").reshape(dims, -1)
                codes, errors = assign(block, codebooks)
                width = 2 if codebooks.shape[1] <= 256 else 4
                text = [c.tobytes().hex() for c in codes.T.astype(">u1" if width == 2 else ">u2")]
                lists = [some.column(j)[i].values.cast(t) for j, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(text, pa.string()), pa.array(errors.sum(0), pa.int64())], ["k", "label", "code", "error"])

    kinds = [named.schema[c].dataType.simpleString() for c in ("k", "label")]
    coded = materialise(blocks.mapInArrow(encode, f"k {kinds[0]}, label {kinds[1]}, code string, error long"), "codes")
    summed = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    out = look_up(coded, summed, "label", "label_error", "n")
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")), codebooks


def decode(codes: DataFrame, codebooks: np.ndarray, key: str = "vec_id") -> DataFrame:
    """The vectors that codes stand for: key and ``vector``, integers."""
    width = 2 if codebooks.shape[1] <= 256 else 4
    kind = to_arrow_type(codes.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(codebooks.shape[0])
        for some in batches:
            raw = b"".join(bytes.fromhex(c) for c in some.column(1).to_pylist())
            numbers = np.frombuffer(raw, ">u1" if width == 2 else ">u2").reshape(-1, len(parts)).astype(int)
            values = codebooks[parts[None, :], numbers].reshape(len(numbers), -1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]) if len(values) else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0).cast(kind), flat.cast(pa.list_(pa.int64()))], ["k", "vector"])

    out = codes.select(key, "code").mapInArrow(run, f"k {codes.schema[key].dataType.simpleString()}, vector array<long>")
    return out.withColumnRenamed("k", key)


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    return compress(documents(spark, sf_dir, "embeddings"))[0]


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rounds in SQL, a table for each."""

    def assigned(k: int) -> str:
        return f"""near{k} AS (
      SELECT vec_id, part, min(distance) AS error, arg_min(entry, distance * {entries} + entry) AS entry
      FROM (SELECT r.vec_id, r.part, b.entry, sum((r.x - b.x) * (r.x - b.x)) AS distance
            FROM pieces r JOIN book{k} b ON r.part = b.part AND r.j = b.j GROUP BY ALL)
      GROUP BY vec_id, part)"""

    steps = [f"book0 AS (SELECT part, n - 1 AS entry, j, x FROM pieces WHERE n <= {entries})"]
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""book{k + 1} AS (
      SELECT b.part, b.entry, b.j, coalesce(m.x, b.x) AS x
      FROM book{k} b LEFT JOIN (
        SELECT r.part, n.entry, r.j, CAST(floor(CAST(sum(r.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
        FROM pieces r JOIN near{k} n ON r.vec_id = n.vec_id AND r.part = n.part GROUP BY ALL) m
      ON b.part = m.part AND b.entry = m.entry AND b.j = m.j)""")
    steps.append(assigned(rounds))
    return f"""
    WITH kept AS (
      SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    flat AS (
      SELECT vec_id, n, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i, len(embedding) // {parts} AS size FROM kept),
    pieces AS (
      SELECT vec_id, n, i // size AS part, i % size AS j, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat),
    {", ".join(steps)},
    coded AS (
      SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
    SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) FROM book{rounds}) AS codebooks_sha256
    FROM kept k JOIN coded c ON k.vec_id = c.vec_id"""
