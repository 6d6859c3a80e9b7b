"""Hard negatives: rows of another label almost as near an anchor as its positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, scratch_path
from .distance_keys import BLOCK_ROWS, FILE_ROWS, HIGHEST, LOWEST, build, search, search_home
from .vectors import quantised

POSITIVES = 5
NEGATIVES = 3
#: The score of a negative in hundredths of its positive's.
LEAST, MOST = 50, 95
COLUMNS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, file_rows: int = FILE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row of ``df`` where ``anchor`` holds and each of its ``positives``
    best rows of the same label: the ``negatives`` best rows of other labels with
    least * positive_score <= 100 * score <= most * positive_score.

    A score is the inner product of the vectors' components as floor(256 x); higher
    ones come first, ties by smaller key. Keys and labels are whole numbers. Rows
    with a null key, label or vector, or with a component that is null, NaN or
    infinite, take no part; shorter vectors count as filled up with zeros. Rows
    count one by one, so a repeated anchor has its rows again and a repeated
    candidate takes two ranks; no row with the anchor's own key is its positive or
    negative. Positives without negatives have no rows (with a negative score the
    bounds cross). An empty table gives an empty one. Other columns are not read.

    Three searches of a store of distance keys: the positives of the anchor's own
    file, then those of the files that the worst of them leaves open, then the
    negatives, from the annulus of the highest allowed score outwards.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    named = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("query"), F.col(vector).alias("vector"))
    rows = quantised(named.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), "vector", ["id", "label", "query"])
    store = build(rows, scratch_path(spark, "distance-keys"), file_rows, block_rows)
    if store is None:
        return spark.createDataFrame([], COLUMNS)
    home = materialise(search_home(store, spark, positives), "home")
    n = home.count()
    worst = F.when(F.size("scores") >= positives, F.element_at("scores", -1)).otherwise(LOWEST)
    open_ = home.select("*", F.array(worst).alias("lows"), F.array(F.lit(HIGHEST)).alias("highs"), F.array(F.lit(0).cast("long")).alias("tags"))
    far = search(store, open_, True, positives, n_queries=n, skip_home=True).select("number", "score", "id")
    near = home.select("number", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("number", "x.scores", "x.ids").toDF("number", "score", "id")
    best = _first(near.unionByName(far), ["number"], positives)
    best = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col("id").alias("positive")))).alias("best"))
    windows = materialise(home.join(best, "number").select(*(c for c in home.columns if c not in ("scores", "ids")), "best"), "windows")
    bounds = windows.select(
        "*",
        F.transform("best.score", lambda p: _up(p * least)).alias("lows"),
        F.transform("best.score", lambda p: _down(p * most)).alias("highs"),
        F.transform("best.rank", lambda r: r.cast("long")).alias("tags"),
    )
    found = search(store, bounds, False, negatives, n_queries=n)
    ranked = _first(found, ["number", "tag"], negatives)
    pairs = windows.select("number", F.explode("best").alias("p")).select("number", F.col("p.rank").cast("long").alias("tag"), F.col("p.positive").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = ranked.join(pairs, ["number", "tag"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _down(x: Column) -> Column:
    """x / 100, down to a whole number, without doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _up(x: Column) -> Column:
    return F.negate(_down(F.negate(x)))


def _first(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The best ``n`` of each group, which has ``n`` rows a file at most."""
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label=label)


ORACLE = """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.id % 50 = 0 AND a.id <> r.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
