"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of ``block`` words each, as many as all targets need.
Slot ``i`` stands at the golden-ratio point frac(i / phi) of the unit interval;
laid over the cumulative shares of the sources, the points give each source its
share of any stretch of the schedule. The r-th slot of a source takes the r-th
block of that source's shuffled word stream, beginning again when the stream
ends. A source's last block is trimmed to its target; where the points have left
it a few slots short (or its share is too small for any point), the blocks that
are missing follow at the end of the schedule.

DataFrame functions only. Ranks and running sums are taken in two levels (within
a chunk, and over the chunks' totals), so that a source with a third of all rows
is spread like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, running_before, shuffle_partitions, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words of a slot, and slots that are ranked together.
BLOCK = 64
CHUNK_SLOTS = 1 << 15
CELLS = 4096
#: The golden ratio's fraction in units of 2^-32.
STEP, UNIT = 2654435769, 1 << 32
SMALL_SOURCES = 100_000


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: number (1 up, by code point, null last), source,
    source_size, target.

    Targets share ``share`` times all sizes by weight; none exceeds ``most``
    times its source's size, and what others cannot take is shared again. With
    the sources in ascending order of size by weight, let level k be what is
    left for each unit of weight if all before k are full; the level rises as
    long as the next source is full below it and falls afterwards, so the level
    at which all is shared is the highest.
    """
    one = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    one = one.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
    by_fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), "number")
    full = F.coalesce(F.sum(most * F.col("source_size")).over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy("number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = one.withColumn("all", F.sum("source_size").over(everything))
    one = one.withColumn("level", (F.lit(share) * F.col("all") - full) / rest)
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.max("level").over(everything))
    return one.select("number", "source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = 17,
) -> DataFrame:
    """All columns of ``df`` and source_size, target, taken: how many of the
    row's ``size`` words the mix takes, repeats counted.

    A null source is a source like others, the last. A null size counts as 0;
    such a row, and a row of 0, takes 0. A null key is a key like others.
    Repeated rows each hold their own place in the stream. An empty table gives
    an empty one. Input columns named like an output column are replaced. The
    result depends on the rows, the seed and ``block`` only.
    """
    df = df.drop("source_size", "target", "taken")
    rows = df.withColumns(
        {
            "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")),
            "_x": F.xxhash64(*df.columns),
            "_size": F.coalesce(F.col(size), F.lit(0)).cast("long"),
        }
    )
    rows = rows.withColumn("_j", F.row_number().over(W.partitionBy("_h", "_x").orderBy("_size")))
    base = materialise(rows.select(F.col(source).alias("source"), "_h", "_x", "_j", "_size"), "mix-rows")
    targets = materialise(source_targets(base, "source", "_size", weights, share, most), "mix-sources")
    n_sources = targets.count()
    placed = _stream(base, F.broadcast(targets) if n_sources <= SMALL_SOURCES else targets)
    # What a source takes: its stream so many times whole, and once more up to a place.
    wanted, blocks = F.floor("target").cast("long"), F.ceil(F.col("source_size") / block).cast("long")
    needs = targets.where("target >= 1").select("number", wanted.alias("wanted"), "source_size", blocks.alias("blocks"))
    needs = needs.withColumn("rest", F.col("wanted") % F.col("source_size"))
    needs = materialise(needs.withColumn("needed", F.expr("(wanted div source_size) * blocks") + F.ceil(F.col("rest") / block).cast("long")), "mix-needs")
    times = _times(schedule(needs), needs, block)
    pieces = placed.where("_size > 0").select("_h", "_x", "_j", "number", F.col("_start").alias("a"), (F.col("_start") + F.col("_size")).alias("z"))
    pieces = pieces.withColumn("b", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(z - 1) div {block}"))))
    pieces = pieces.withColumn("from", F.greatest(F.lit(0), F.col("a") - F.col("b") * block)).withColumn("upto", F.least(F.lit(block), F.col("z") - F.col("b") * block))
    words = (F.col("upto") - F.col("from")) * F.col("whole") + F.greatest(F.lit(0), F.least("upto", "part") - F.col("from"))
    taken = pieces.join(times, ["number", "b"]).groupBy("_h", "_x", "_j").agg(F.sum(words).alias("taken"))
    found = placed.select("_h", "_x", "_j", "source_size", "target").join(taken, ["_h", "_x", "_j"], "left")
    out = rows.join(found, ["_h", "_x", "_j"])
    return out.select(*df.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _stream(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row's place in the shuffled word stream of its source: in the order
    of the hash, with the hash's first digits as chunk."""
    rows = base.join(targets, base["source"].eqNullSafe(targets["source"])).drop("source").withColumn("_chunk", F.substring("_h", 1, 3))
    chunks = rows.groupBy("number", "_chunk").agg(F.sum("_size").alias("_sum"))
    chunks = chunks.select("number", "_chunk", running_before("_sum", ["number"], ["_chunk"]).alias("_before"))
    within = running_before("_size", ["number", "_chunk"], ["_h", "_x", "_j"])
    rows = rows.withColumn("_within", within).join(chunks, ["number", "_chunk"])
    return rows.withColumn("_start", F.col("_before") + F.col("_within")).drop("_chunk", "_within", "_before")


def points(slot: Column) -> Column:
    """The golden-ratio point of a slot, in units of 2^-32; in steps that no slot number overflows."""
    high, low = F.call_function("div", F.pmod(slot, F.lit(UNIT)), F.lit(65536).cast("long")), F.pmod(slot, F.lit(65536))
    return F.pmod(F.pmod(high * STEP, F.lit(UNIT)) * 65536 + low * STEP, F.lit(UNIT))


def schedule(needs: DataFrame) -> DataFrame:
    """Of sources (number, needed: how many slots) the slots of the mix: number,
    slot (place in the mix) and rank (how many slots of the source come before)."""
    spark = needs.sparkSession
    total = needs.agg(F.sum("needed")).first()[0] or 0
    everything = W.orderBy("number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = F.sum("needed").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    edge = lambda cum: F.floor(cum.cast("double") / F.sum("needed").over(everything) * UNIT).cast("long")
    spans = needs.where("needed > 0").select("number", "needed", edge(upto - F.col("needed")).alias("lo"), edge(upto).alias("hi"))
    cell = UNIT // CELLS
    cells = spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}L"), F.expr(f"(hi - 1) div {cell}L"))))
    slots = spark.range(0, total, 1, max(shuffle_partitions(spark), -(-total // (1 << 20)))).withColumnRenamed("id", "slot").withColumn("x", points(F.col("slot")))
    dealt = slots.withColumn("cell", F.expr(f"x div {cell}L")).join(cells, "cell").where("x >= lo AND x < hi")
    dealt = dealt.select("number", "needed", "slot", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    counts = materialise(dealt.groupBy("number", "chunk").agg(F.count(F.lit(1)).alias("n")), "mix-chunks")
    before = counts.select("number", "chunk", running_before("n", ["number"], ["chunk"]).alias("before"))
    within = F.row_number().over(W.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["number", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).where("rank < needed").select("number", "slot", "rank")
    short = needs.join(counts.groupBy("number").agg(F.sum("n").alias("had")), "number", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < needed")
    short = short.withColumn("rank", F.explode(F.sequence("had", F.col("needed") - 1)))
    return ranked.unionByName(short.select("number", (F.lit(total) + F.col("rank") - F.col("had")).alias("slot"), "rank"))


def _times(slots: DataFrame, needs: DataFrame, block: int) -> DataFrame:
    """How often each block of a source's stream (number, b) is taken whole, and
    how many words of it besides, where it is the source's last and trimmed."""
    trimmed = (F.col("rank") == F.col("needed") - 1) & (F.col("rest") > 0)
    slots = slots.join(needs.select("number", "needed", "rest", "blocks"), "number")
    last = F.when(trimmed, F.pmod(F.col("rest") - 1, F.lit(block)) + 1)
    slots = slots.select("number", F.expr("rank % blocks").alias("b"), last.alias("last"))
    whole = F.count(F.when(F.col("last").isNull(), 1)).alias("whole")
    return slots.groupBy("number", "b").agg(whole, F.coalesce(F.max("last"), F.lit(0)).alias("part"))


def copies(size: Column, taken: Column) -> Column:
    """How many times a whole document goes into the mix: its words taken, in
    documents, to the nearest number. One without words costs nothing and stays once."""
    return F.when(size > 0, F.floor(taken / size + 0.5)).otherwise(1).cast("int")


def op6_mix(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: What the schedule comes to, without one: each source takes the first words of its repeated stream, to the word.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM d GROUP BY source),
w AS (SELECT *, CASE (number - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, sum(source_size) OVER () AS every FROM s),
l AS (
  SELECT *, (CAST({SHARE} AS DOUBLE) * CAST(every AS DOUBLE) - CAST(coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (SELECT number, source, source_size, least(CAST({MOST} * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
placed AS (
  SELECT d.*, number, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY number ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (CAST(floor(target) AS BIGINT) // source_size) + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed"""
