"""Vectors as integers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SCALE = 256
#: Below it scores are exact as doubles, and a hundred times a score, or a squared distance, fits a long.
LARGEST = 2.0**53


def matrix(lists: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of lists of numbers: which rows are whole (no null and no
    component that is null, NaN or infinite), and these rows as float64 vectors,
    shorter ones filled up with zeros to ``dims`` or to the longest."""
    lists = lists.cast(pa.list_(pa.float64())) if not pa.types.is_float64(lists.type.value_type) else lists
    n = len(lists)
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = np.repeat(np.arange(n), sizes)
    whole = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    whole[rows[~np.isfinite(values)]] = False
    width = int(sizes[whole].max(initial=0)) if dims is None else dims
    out = np.zeros((n, width))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = whole[rows]
    out[rows[keep], at[keep]] = values[keep]
    return whole, out[whole]


def quantised(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """The rows with a whole vector: the columns ``keep``, ``v`` (each component x
    as floor(256 x), little-endian 64-bit integers, zeros at the end left out) and
    ``norm2``, the squared length. Vectors whose squared length is no long raise
    an error."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}
    arrow = [to_arrow_type(df.schema[c].dataType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            whole, x = matrix(some.column(len(keep)))
            x = np.floor(SCALE * x)
            if len(x) and np.square(x).sum(1).max(initial=0) >= LARGEST:
                raise ValueError("a vector is too long for integer scores")
            x = x.astype("<i8")
            ends = np.where(x.any(1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0) if x.shape[1] else np.zeros(len(x), int)
            mask = pa.array(whole)
            kept = [some.column(i).filter(mask).cast(t) for i, t in enumerate(arrow)]
            v = pa.array([r[:e].tobytes() for r, e in zip(x, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, v, pa.array(np.square(x).sum(1), pa.int64())], [*keep, "v", "norm2"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return df.select(*keep, F.col(vector)).mapInArrow(run, f"{schema}, v binary, norm2 long")


def stacked(column: pa.Array, dims: int, dtype="<i8") -> np.ndarray:
    """Rows of ``quantised`` as one matrix of ``dims`` columns."""
    out = np.zeros((len(column), dims), dtype)
    for i, b in enumerate(column.to_pylist()):
        v = np.frombuffer(b, "<i8")
        out[i, : len(v)] = v
    return out
