"""Distance keys and hard negatives against every pair by brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from gridspark.llm import distance_keys as dk
from gridspark.llm import hard_negatives as hn
from gridspark.llm.vectors import quantised

SCHEMA = "vec_id long, embedding array<float>, label int, query string, norm2 string, rank string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", "clash") for i, v, label in rows], SCHEMA)


def slow(rows, every, positives=5, negatives=3, least=50, most=95):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, label in kept:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, b, other in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            window = [(-t, k) for t, k, other in scored if other != label and least * -s <= 100 * -t <= most * -s]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(window[:negatives])]
    return Counter(out)


def clustered(seed, n, dims, labels=4, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 0.4, (centres, dims))
    return [(int(i), (c[rng.integers(centres)] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in rng.permutation(n)]


def uniform(seed, n, dims, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(0, scale, dims).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("rows,every,file_rows,block_rows", [
    (clustered(1, 900, 6), 10, 100, 9), (clustered(2, 500, 3, labels=2), 5, 1 << 18, 1000), (uniform(3, 400, 16), 8, 60, 20), (uniform(4, 300, 5, 900.0), 6, 50, 10),
])
def test_negatives_equal_brute_force(spark, rows, every, file_rows, block_rows):
    got = hn.mine(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0, file_rows=file_rows, block_rows=block_rows)
    assert got.columns == NAMES
    want = slow(rows, every)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_ties_repeated_rows_and_rows_that_take_no_part(spark):
    rows = uniform(5, 120, 2, 0.02)  # few different vectors: ties everywhere
    rows += rows[:40] + rows[:5]
    rows += [(200, None, 1), (201, [None, 1.0], 1), (202, [float("nan"), 1.0], 0), (203, [1.0, float("inf")], 0), (None, [0.1, 0.1], 1), (205, [0.1, 0.1], None), (206, [0.5], 1), (210, [], 1)]
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, file_rows=40, block_rows=7)
    assert Counter(map(tuple, got.collect())) == slow(rows, 10)


def test_one_vector_and_one_label_may_hold_a_third(spark):
    rows = clustered(6, 300, 4) + [(1000 + i, [0.3, -0.1, 0.2, 0.4], 9) for i in range(200)]
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, file_rows=50, block_rows=10)
    assert Counter(map(tuple, got.collect())) == slow(rows, 20)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)], [(0, [0.0, 0.0], 1), (10, [0.0, 0.0], 1), (3, [0.0, 0.0], 2)]])
def test_small_tables(spark, rows):
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == NAMES and Counter(map(tuple, got.collect())) == slow(rows, 10)


def test_other_bounds(spark):
    rows = clustered(7, 200, 5)
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 9 == 0, positives=2, negatives=4, least=33, most=101)
    assert Counter(map(tuple, got.collect())) == slow(rows, 9, 2, 4, 33, 101)


def stored(spark, tmp_path, rows, file_rows, block_rows):
    named = frame(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 25 == 0).alias("query"), "embedding")
    return dk.build(quantised(named, "embedding", ["id", "label", "query"]), f"file://{tmp_path}/keys", file_rows, block_rows)


def test_the_store_is_sorted_by_pivot_and_distance(spark, tmp_path):
    store = stored(spark, tmp_path, clustered(8, 1000, 6), 120, 10)
    fs, at, seen = pafs.LocalFileSystem(), (-1, 0.0), 0
    for name in sorted({r[1] for r in store.ranges}):
        file = dk.KeyFile(fs, name, store.space)
        for b in range(len(file.pivot)):
            id, _, _, v, norm2 = file.block(b)
            keys = store.space.keys(v, norm2)
            assert (keys.argmin(1) == file.pivot[b]).all() and len(id) <= 10
            d = keys[:, file.pivot[b]]
            assert (np.diff(d) >= -1e-9).all() and at <= (file.pivot[b], file.lo[b]) and abs(file.hi[b] - d[-1]) < 1e-9
            at, seen = (file.pivot[b], file.hi[b]), seen + len(id)
    assert seen == 1000 and len({r[0] for r in store.ranges}) > 4


def test_a_search_ends_before_all_blocks_are_read(spark, tmp_path):
    rows = clustered(9, 3000, 6, spread=0.02)
    store = stored(spark, tmp_path, rows, 1 << 18, 20)
    fs, names = pafs.LocalFileSystem(), sorted({r[1] for r in store.ranges})
    n = read = 0
    for name in names:
        file = dk.KeyFile(fs, name, store.space)
        n += len(file.pivot)
        id, label, v, norm2 = next(iter(file.queries()))[1:]
        file.read = 0
        one = dk.Queries(np.arange(1), id[:1], label[:1], v[:1], norm2[:1], np.arange(1), np.array([dk.LOWEST]), np.array([dk.HIGHEST]))
        w, scores, _ = file.search(one, True, 5)
        assert len(w) == 5 and (np.diff(scores) <= 0).all()
        read += file.read
    assert read < n / 2


def test_pivots_are_apart():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (40, 3))
    norm2 = (v**2).sum(1)
    p = dk.pivots_of(v, norm2, int(norm2.max()), 8)
    assert len(np.unique(p, axis=0)) == 8 and len(dk.pivots_of(v[[0, 0, 0]], norm2[[0, 0, 0]], int(norm2.max()), 8)) == 1
