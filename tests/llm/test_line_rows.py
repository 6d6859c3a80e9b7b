from pyspark.sql import functions as F

from gridspark.llm import line_dedup

TEXTS = ["0123456789", "eighteen letters..", "ab" * 40, "Zeile mit Ümläuten und \U0001f600 darin, lang genug für viele", "x" * 9, " y "]


def lines(spark):
    return spark.createDataFrame([(i, i, x) for i, x in enumerate(TEXTS)], "hi long, lo long, line string")


def runs(text):
    """The UTF-16 code units of the shingles, the whole text where it is too short for one."""
    units = text.encode("utf-16-be")
    return [units[i : i + 20] for i in range(0, max(1, len(units) - 19), 2)]


def test_shingles_share_rows(spark):
    """Before, each shingle had a row of its own, and each row a look into the aggregation's table."""
    hashed = {i: {r.h for r in spark.createDataFrame([(u,) for u in runs(x)], "u binary").select(F.xxhash64("u").alias("h")).collect()} for i, x in enumerate(TEXTS[:4])}
    rows = line_dedup.shingled(line_dedup.coded(lines(spark)), "hi").collect()
    for i, x in enumerate(TEXTS[:4]):
        own = [r for r in rows if r.hi == i]
        assert len(own) == -(-len(runs(x)) // line_dedup.CHUNK)
        assert {r[f"h{k}"] for r in own for k in range(line_dedup.CHUNK)} == hashed[i]
    assert {r.hi for r in rows} == {0, 1, 2, 3}


def test_sketches_are_of_all_shingles_and_count_lines(spark):
    twice = lines(spark).unionByName(lines(spark).where("hi < 3"))
    got = {r.hi: r for r in line_dedup.sketches(twice).collect()}
    assert {i: (r.n, r.times) for i, r in got.items()} == {i: (len(x.encode("utf-16-be")) // 2 - 9, 1 + (i < 3)) for i, x in enumerate(TEXTS)}
    units = spark.createDataFrame([(i, u) for i, x in enumerate(TEXTS) for u in runs(x)], "hi long, u binary").withColumn("h", F.xxhash64("u"))
    least = units.groupBy("hi").agg(*(F.min(F.shiftright(line_dedup.order(F.col("h"), j), 32).cast("int")).alias(f"m{j}") for j in range(line_dedup.BANDS * line_dedup.ROWS)))
    node = lambda b: F.xxhash64(F.lit(b), *(f"m{b * line_dedup.ROWS + r}" for r in range(line_dedup.ROWS)))
    for r in least.select("hi", *(node(b).alias(c) for b, c in enumerate(line_dedup.NODES))).collect():
        assert [r[c] for c in line_dedup.NODES] == [got[r.hi][c] for c in line_dedup.NODES]


def test_hot_keys_are_looked_up_by_broadcast_and_others_by_join(spark):
    rows = spark.createDataFrame([(i, i % 3, 0) for i in range(30)] + [(30, 7, 0), (31, 0, 1)], "k long, hi long, lo long")
    table = spark.createDataFrame([(0, 0, "a", True), (1, 0, "b", False), (5, 0, "c", True), (0, 1, "d", False)], "hi long, lo long, name string, hot boolean")
    got = sorted((r.k, r.name) for r in line_dedup.looked_up(rows, table, "hi", "lo").collect())
    assert got == sorted([(i, "ab"[i % 3]) for i in range(30) if i % 3 < 2] + [(31, "d")])
