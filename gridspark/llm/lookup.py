"""Joins that look a value up by a key which may be very common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is common when it has more than this share of the counted rows: fewer than 1 / HOT keys can be.
HOT = 1e-3


def look_up(df: DataFrame, table: DataFrame, key: str, value: str, counts: str) -> DataFrame:
    """``df`` with ``value`` of ``table``, which has one row a ``key`` and in
    ``counts`` how many rows of ``df`` have that key; null where it has none.

    Null keys are a key like others. Rows of common keys get the value from a
    broadcast table of fewer than 1 / HOT rows, whatever the input's size, and are
    spread over all tasks by a hash of their other columns; the others meet the
    table in a shuffle, where no key has more than that share. ``table`` is read
    three times: give a written one.
    """
    total = table.agg(F.sum(counts)).first()[0] or 0
    named = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"), (F.col(counts) > total * HOT).alias("_hot"))
    hot = F.broadcast(named.where("_hot").select(F.col("_key").alias("_hot_key"), F.col("_value").alias("_hot_value"), "_hot"))
    out = df.join(hot, df[key].eqNullSafe(F.col("_hot_key")), "left")
    spread = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).otherwise(0).cast("int")
    cold = named.where("NOT _hot").select("_key", "_value", F.lit(0).alias("_at"))
    out = out.withColumn("_spread", spread)
    out = out.join(cold, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_spread") == F.col("_at")), "left")
    return out.select(*df.columns, F.when(F.col("_hot"), F.col("_hot_value")).otherwise(F.col("_value")).alias(value))
