"""Codebooks against a slow model, one vector at a time."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import vector_codes as vc
from gridspark.llm.vectors import matrix, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], SCHEMA)


def slow(rows, parts, entries, rounds):
    """Python integers, loops."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    size = dims // parts
    books = [[v[p * size : (p + 1) * size] for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]] for p in range(parts)]

    def nearest(v, p):
        piece = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, nearest(v, p)[1]].append(v[p * size : (p + 1) * size])
        for (p, k), got in members.items():
            books[p][k] = [sum(column) // len(got) for column in zip(*got)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], sha) for i, code, error, label in out)


def vectors(seed, n, dims, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.normal(0, spread, dims).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]


@pytest.mark.parametrize("n,dims,parts,entries,rounds", [(150, 8, 4, 8, 2), (40, 16, 16, 64, 2), (90, 6, 4, 5, 3), (64, 4, 1, 64, 1)])
def test_codes_equal_a_slow_model(spark, n, dims, parts, entries, rounds):
    rows = vectors(n, n, dims)
    rows += rows[:7] * 3  # repeated rows
    rows += [(n + 1, None, 1), (n + 2, [], 2), (n + 3, [1.0, None], 1), (n + 4, [float("nan")] * dims, 1), (n + 5, [float("-inf")] * dims, None), (n + 6, [0.5], None), (None, [0.25] * dims, None)]
    got = vc.compress(frame(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds)[0]
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == slow(rows, parts, entries, rounds)


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(i, [0.0, 0.0], 0) for i in range(4)] + [(9, [1.0, -1 / 512], 0)]
    got, books = vc.compress(frame(spark, rows), parts=2, entries=3, rounds=1)
    assert {r.code for r in got.where("vec_id < 4").collect()} == {"0101"}
    assert books[0].tolist() == [[51], [0], [0]] and books[1].tolist() == [[-1], [0], [0]]  # floor(256 / 5), floor(-1 / 5)


def test_one_vector_may_hold_most_rows(spark):
    rows = vectors(3, 60, 8) + [(1000 + i, [0.1] * 8, 7) for i in range(900)]
    got = vc.compress(frame(spark, rows), parts=4, entries=16)[0]
    assert Counter(map(tuple, got.collect())) == slow(rows, 4, 16, 2)


def test_without_whole_vectors_nothing_comes(spark):
    assert vc.compress(frame(spark, []))[0].count() == 0
    assert vc.compress(frame(spark, [(1, None, 1), (2, [None], 1)]))[0].count() == 0
    assert {r.code for r in vc.compress(frame(spark, [(1, [], 1)]))[0].collect()} == {"00" * 16}


def test_codes_stand_for_their_entries(spark):
    rows = vectors(5, 80, 8)
    codes, books = vc.compress(frame(spark, rows), parts=4, entries=16)
    back = {r.vec_id: np.array(r.vector) for r in vc.decode(codes, books).collect()}
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows}
    assert {r.vec_id: r.error for r in codes.collect()} == {i: int(((whole[i] - back[i]) ** 2).sum()) for i in whole}


def test_sums_merge_in_any_order():
    rng = np.random.default_rng(1)
    blocks, books = [rng.integers(-300, 300, (8, n)) for n in (1, 50, 7)], rng.integers(-300, 300, (4, 6, 2))
    zero = lambda: (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
    one = zero()
    for b in blocks:
        vc._add(one, b, books)
    tree = vc._merge(vc._add(zero(), blocks[2], books), vc._merge(vc._add(zero(), blocks[1], books), vc._add(zero(), blocks[0], books)))
    assert (one[0] == tree[0]).all() and (one[1] == tree[1]).all() and one[1].sum() == 4 * 58


def test_whole_vectors_and_their_floors(spark):
    lists = pa.array([[1.0, 2.0], None, [3.0, None], [], [float("inf"), 0.0], [5.0]], pa.list_(pa.float32()))
    whole, x = matrix(lists[0:])
    assert whole.tolist() == [True, False, False, True, False, True] and x.tolist() == [[1, 2], [0, 0], [5, 0]]
    whole, x = matrix(lists.slice(2, 4))
    assert whole.tolist() == [False, True, False, True] and x.tolist() == [[0], [5]]
    rows = quantised(spark.createDataFrame([(1, [0.999 / 256, -0.001, 0.0])], "id long, e array<double>"), "e", ["id"]).collect()
    assert np.frombuffer(rows[0].v, "<i8").tolist() == [0, -1] and rows[0].norm2 == 1
    with pytest.raises(Exception, match="too long"):
        quantised(spark.createDataFrame([(1, [1e30])], "id long, e array<double>"), "e", ["id"]).collect()
