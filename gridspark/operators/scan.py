"""Running values over long series: parallel prefix scans.

A series is cut into chunks of consecutive rows, by range partitions of its keys
and order, so that a series with a third of all rows lies in many chunks. Each chunk
is reduced to a carry (a sum, a lowest value, a last known value), the carries of a
series are scanned, one row a chunk, and the rows of a chunk are finished with the
carry of what lies before (or after) it. No window spans more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "_chunk"


@dataclass
class Fold:
    """An associative carry. ``local``: of the rows of a chunk up to (from) this one;
    ``reduce``: of a whole chunk; ``carry``: of the chunks before (after), from their
    reduced values; ``merge``: both together."""

    local: Callable[[object], Column]
    reduce: Callable[[Column], Column]
    carry: Callable[[Column, object], Column]
    merge: Callable[[Column, Column], Column]
    ahead: bool = False


def total(x: Column) -> Fold:
    """The sum up to this row; nulls add nothing."""
    return Fold(lambda w: F.sum(x).over(w), lambda _: F.sum(x), lambda r, w: F.sum(r).over(w), lambda c, v: F.coalesce(c + v, c, v, F.lit(0)))


def lowest(x: Column) -> Fold:
    return Fold(lambda w: F.min(x).over(w), lambda _: F.min(x), lambda r, w: F.min(r).over(w), lambda c, v: F.least(c, v))


def last_known(x: Column) -> Fold:
    """The last value that is not null, of this row or before."""
    return Fold(lambda w: F.last(x, True).over(w), lambda at: F.max_by(x, F.when(x.isNotNull(), at)), lambda r, w: F.last(r, True).over(w), lambda c, v: F.coalesce(v, c))


def last_known_before(x: Column) -> Fold:
    """The last value that is not null of the rows before this one."""
    known = last_known(x)
    local = lambda w: F.last(x, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return Fold(local, known.reduce, known.carry, known.merge)


def next_known(x: Column) -> Fold:
    """The first value that is not null, of this row or after."""
    return Fold(lambda w: F.first(x, True).over(w), lambda at: F.min_by(x, F.when(x.isNotNull(), at)), lambda r, w: F.first(r, True).over(w), lambda c, v: F.coalesce(v, c), ahead=True)


def chunked(df: DataFrame, by: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``df`` with the number of its chunk, written to the shared folder: boundaries
    come from samples, and all that follows must see the same ones. With fewer
    distinct orders than rows, rows of one (by, order) stay together."""
    from ..plans.scratch import materialise

    cut = df.repartitionByRange(chunks, *by, *order) if chunks else df.repartitionByRange(*by, *order)
    return materialise(cut.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def scan(df: DataFrame, by: list[str], order: list[str], folds: dict[str, Fold]) -> DataFrame:
    """A chunked ``df`` with a column for each fold, over the rows of ``by`` in the
    order of ``order``. ``by`` may be finer than the chunks' own. Null keys are keys."""
    at = F.struct(*order)
    w = W.partitionBy(*by, CHUNK).orderBy(*order)
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    out = df.withColumns({f"_l_{n}": f.local(down if f.ahead else up) for n, f in folds.items()})
    carries = df.groupBy(*by, CHUNK).agg(*(f.reduce(at).alias(f"_r_{n}") for n, f in folds.items()))
    k = W.partitionBy(*by).orderBy(CHUNK)
    before, after = k.rowsBetween(W.unboundedPreceding, -1), k.rowsBetween(1, W.unboundedFollowing)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, CHUNK])]
    carries = carries.select(*keys, *(f.carry(F.col(f"_r_{n}"), after if f.ahead else before).alias(f"_c_{n}") for n, f in folds.items()))
    on = [out[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, CHUNK])]
    out = out.join(carries, on, "left")
    return out.select(*df.columns, *(f.merge(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, f in folds.items()))


def neighbours(df: DataFrame, by: list[str], axis: Column, reach: float, width: float) -> DataFrame:
    """For windows of limited reach: rows dealt to stretches of ``width`` along the
    axis, those that the next stretch can reach back to given to it as well. Adds
    ``_stretch`` and ``_own``, false for what is only lent."""
    own = F.floor(axis / width)
    following = F.floor((axis + reach) / width)
    out = df.withColumn("_stretch", F.explode(F.sequence(own, following)))
    return out.withColumn("_own", F.col("_stretch") == own)
