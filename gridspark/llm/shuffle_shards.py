"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of their key. Pass two takes one bucket at a time, puts it in an order that does
not depend on how Spark dealt it, and applies a Fisher-Yates shuffle seeded by
(seed, bucket). Buckets laid end to end form one random permutation of the
table; it is cut into equal runs, the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, running_before, scratch_path

BUCKET_BYTES = 32 << 20
MIN_BUCKETS = 1024


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order in which the ``n`` records of a bucket leave it."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def external_shuffle(
    df: DataFrame,
    key: str,
    text: str = "text",
    n_shards: int = 16,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """All columns of ``df`` and ``bucket``, ``position``, ``shard``, ``slot``.

    ``position`` is the record's place in the global permutation, ``shard`` the
    run it falls in (runs differ by one record at most) and ``slot`` its place
    in that run, gapless from 0. Reruns give the same places: they depend on
    key, text, the table's size and the seed only.

    Nulls in any column are ordinary values (a null text counts no bytes, a
    null key is a key like others). Repeated rows each get a place of their
    own. An empty table gives an empty result. Input columns named like an
    output column are replaced. Records that share key *and* text share a
    bucket, so what repeats must fit one task; equal texts under different
    keys scatter.
    """
    df = df.drop("bucket", "position", "shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    n_rows, n_bytes = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    n_buckets = max(min_buckets, -(-n_bytes // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary"))), F.lit(n_buckets)).cast("int")
    scattered = df.withColumn("bucket", bucket)
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("bucket", running_before("_n", [], ["bucket"]).alias("_start"))
    schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("position", T.LongType())])

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number, start = table["bucket"][0].as_py(), table["_start"][0].as_py()
        by = pa.table({"k": table[key], "t": table[text]}) if key != text else pa.table({"k": table[key]})
        if pc.count_distinct(by["k"], mode="all").as_py() == len(by):
            by = by.select(["k"])  # no ties: the texts need not be compared
        known = pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names])
        order = known.to_numpy()[fisher_yates(len(table), seed, number)]
        place = pa.array(np.arange(start, start + len(table), dtype=np.int64))
        return table.drop_columns(["_start"]).take(pa.array(order)).append_column("position", place)

    out = scattered.join(starts, "bucket").select(*df.columns, "bucket", "_start")
    out = out.groupBy("bucket").applyInArrow(shuffled, schema)
    shard = F.expr(f"position * {n_shards}L div {max(1, n_rows)}L")
    first = F.expr(f"(shard * {max(1, n_rows)}L + {n_shards - 1}L) div {n_shards}L")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - first)


def write_shards(df: DataFrame, path: str) -> DataFrame:
    """Writes the shards of ``external_shuffle`` as Parquet, one folder a shard,
    each bucket's run in the order of its slots, and reads them back. A task that
    is lost writes its files anew: they appear when the job commits."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def op2_external_shuffle(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = write_shards(external_shuffle(docs, "doc_id"), scratch_path(spark, "shards"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "bucket",
        "position",
    )
