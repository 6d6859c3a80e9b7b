"""Near-duplicate documents by a chosen-path set similarity join.

Texts become sets of word shingles, equal sets one vertex. Every vertex has a
sketch of minwise tokens. A tree sends a vertex down the branches of one or
two of its minwise tokens (so many that, on average, one of them is common to
two sets at the threshold); a node holds the vertices that agree on all tokens
of its path. Small nodes are compared exhaustively, others branch again, and
independent trees are repeated until the target recall. Every link is confirmed
on the full sets.

Copies of copies need not meet in all pairs: each vertex is first held against
its likeliest partner, and from then on only vertices of different components
are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialise, shuffle_partitions, trimmed
from .nodes import linked
from .shingles import minhashes, shingle_sets

SHINGLE, PERCENT = 5, 85
#: Minwise tokens of a sketch; the first of them, kept at full length, make paths.
TOKENS, PATH_TOKENS = 256, 64
TREES, ROOT_DEPTH = 20, 2
#: Nodes of so many vertices are compared exhaustively.
SMALL = 16
LEVELS = 12
#: Two sets at the threshold share that part of the tokens; pairs so many deviations below it are not compared in full.
DEVIATIONS = 5
#: Longs of a bitmap. Sets of up to ``MAPPED`` shingles have one, sets of more than ``SKETCHED`` a sketch. Two sets that
#: can be links differ less in size than these two numbers do, so both have the one or both have the other.
WORDS = 32
MAPPED, SKETCHED = 1300, 800
#: Bits of a token in a sketch.
NIBBLE = 4
#: Texts compared with one leader in a group.
GROUP = 32
_RNG = np.random.default_rng(20240501)
FACTORS = (_RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def roots(trees: int, percent: int) -> list[list[int]]:
    """The branches of all trees at the first two levels, as the tokens of their
    paths: of each tree as many as make two sets at the threshold share one."""
    n = round(trees * (100 / percent) ** ROOT_DEPTH)
    return [[(ROOT_DEPTH * i + d) % PATH_TOKENS for d in range(ROOT_DEPTH)] for i in range(n)]


def least_common(percent: int) -> int:
    """So many tokens of a sketch agree, by their few bits, in two sets at the threshold."""
    p = percent / 100 + (1 - percent / 100) / (1 << NIBBLE)
    return max(0, int(TOKENS * p - DEVIATIONS * (TOKENS * p * (1 - p)) ** 0.5))


#: What a vertex is judged by, all longs.
BITS, SKETCH = [f"w{i}" for i in range(WORDS)], [f"s{i}" for i in range(TOKENS * NIBBLE // 64)]


def with_sets(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text, and vertex (a digest of the shingle set, null for
    an empty one), n_shingles, path (the first tokens), ``BITS`` (which of 2,048
    values the shingles' hashes take, 0 for large sets) and ``SKETCH`` (the last
    bits of all tokens, 0 for small sets)."""
    kept = [f for f in df.schema.fields if f.name != text]
    added = [T.StructField("vertex", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("path", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in BITS + SKETCH)]
    schema = T.StructType([*kept, *added])
    at, keep = df.columns.index(text), [i for i, c in enumerate(df.columns) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, paths, longs = [], [], [], np.zeros((batch.num_rows, len(BITS + SKETCH)), np.int64)
            for i, items in enumerate(shingle_sets(batch.column(at), SHINGLE)):
                n = len(items)
                digests.append(digest_of(items))
                sizes.append(n)
                tokens = minhashes(items, FACTORS if n > SKETCHED else FACTORS[:PATH_TOKENS]) if n else None
                paths.append(None if tokens is None else tokens[:PATH_TOKENS].tobytes())
                if 0 < n <= MAPPED:
                    longs[i, :WORDS] = bitmap(items)
                if n > SKETCHED:
                    longs[i, WORDS:] = nibbles(tokens)
            arrays = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(paths, pa.binary()), *map(pa.array, longs.T.copy())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], [f.name for f in schema.fields])

    return df.mapInArrow(trimmed(run), schema)


def bitmap(items: np.ndarray) -> np.ndarray:
    taken = np.zeros(64 * WORDS, np.uint8)
    taken[(items % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(taken).view(np.int64)


def nibbles(tokens: np.ndarray) -> np.ndarray:
    low = (tokens & ((1 << NIBBLE) - 1)).astype(np.uint8)
    return (low[::2] << NIBBLE | low[1::2]).view(np.int64)


def alike(percent: int):
    """Whether two sets can be links, and how many in a thousand of their shingles
    (or tokens) may be common. A value that one set's hashes take and the other's
    don't belongs to a shingle of one of them only, so bitmaps rule no link out;
    sketches rule out what is ``DEVIATIONS`` deviations below the threshold."""

    def judge(one: Callable[[str], Column], other: Callable[[str], Column]) -> tuple[Column, Column]:
        n = one("n_shingles") + other("n_shingles")
        sizes = F.least(one("n_shingles"), other("n_shingles")) * 100 >= F.greatest(one("n_shingles"), other("n_shingles")) * percent
        differ, equal = F.lit(0), F.lit(TOKENS)
        for c in BITS:
            differ = differ + F.bit_count(one(c).bitwiseXOR(other(c)))
        for c in SKETCH:
            x = one(c).bitwiseXOR(other(c))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            equal = equal - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
        mapped = F.greatest(one("n_shingles"), other("n_shingles")) <= MAPPED
        possible = F.when(mapped, differ * (100 + percent) <= n * (100 - percent)).otherwise(equal >= least_common(percent))
        common = F.when(mapped, F.floor(1000 * (n - differ) / (n + differ))).otherwise(F.floor(equal * 1000 / TOKENS))
        return sizes & possible, common

    return judge


def digest_of(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, vertex, digest (of
    the text) and stays.

    Documents are linked where 100 * |intersection| >= percent * |union| of
    their shingle sets; ``component_id`` is the smallest key reachable by links.
    A text of fewer words than a shingle, but not none, has its whole sequence
    as the one shingle. A null or empty text, or one without words, has no
    shingles, is linked with nothing and has its own key as component.

    ``stays`` is true for the first row of each component by (key, digest) and for
    every row without shingles, so of a component one document stays.

    A null key is no smallest key unless all of the component are null.
    Repeated rows are equal sets and each keep their row, with the same values;
    ties need no order. An empty table gives an empty one. Other columns are not
    read.
    """
    docs = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    base = materialise(with_sets(docs, "t"), "sets")
    vertices = base.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min(F.struct(F.col("k").isNull().alias("unknown"), "k", "x")).alias("first"), F.first(F.struct("n_shingles", "path", *BITS, *SKETCH)).alias("of"))
    vertices = materialise(vertices.select("vertex", "first", "of.*"), "vertices")
    token = lambda c: F.substring("path", 4 * c + 1, 4)
    branches = [F.xxhash64(F.lit(i), *map(token, tokens)) for i, tokens in enumerate(roots(trees, percent))]
    rows = vertices.select(F.explode(F.array(*branches)).alias("node"), "vertex")
    tokens = vertices.select("vertex", F.transform(F.sequence(F.lit(0), F.lit(PATH_TOKENS - 1)), lambda i: F.substring("path", 4 * i + 1, F.lit(4))).alias("tokens"))
    label, _ = linked(
        rows,
        vertices.select("vertex", "n_shingles", *BITS, *SKETCH),
        alike(percent),
        lambda some: materialise(tokens.join(some, "vertex"), "tokens"),
        PATH_TOKENS,
        percent,
        SMALL,
        LEVELS,
        lambda pairs: texts_of(pairs, vertices, docs),
        lambda pairs, texts: confirmed(pairs, texts, percent),
    )

    member = label.select(F.col("id").alias("vertex"), "component")
    member = member.unionByName(label.select(F.col("component").alias("vertex"), "component").distinct())
    named = member.join(vertices.select("vertex", "first"), "vertex")
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    named = member.join(smallest, "component").select("vertex", "least")
    ids = vertices.select("vertex", "first").join(named, "vertex", "left").select("vertex", F.coalesce("least", "first").alias("least"))
    out = base.select("k", "x", "n_shingles", "vertex").join(ids, "vertex", "left")
    alone = F.col("vertex").isNull()
    stays = alone | (F.col("k").eqNullSafe(F.col("least.k")) & F.col("x").eqNullSafe(F.col("least.x")))
    return out.select(F.col("k").alias(key), "n_shingles", F.when(alone, F.col("k")).otherwise(F.col("least.k")).alias("component_id"), "vertex", F.col("x").alias("digest"), stays.alias("stays"))


def texts_of(pairs: DataFrame, vertices: DataFrame, docs: DataFrame) -> DataFrame:
    """vertex and text of one document of each vertex in the pairs. A text comes
    by its document's key and digest."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    wanted = wanted.join(vertices.select("vertex", F.col("first.k").alias("key"), F.col("first.x").alias("digest")), "vertex")
    return materialise(docs.join(wanted, docs["k"].eqNullSafe(wanted["key"]) & (docs["x"] == wanted["digest"])).select("vertex", "t"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs, by the full sets. Pairs are grouped by their first
    vertex, in groups of about ``GROUP``; a group is its leader's text and those
    to be held against it."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.expr(f"n div {GROUP}L + 1"))
    salted = pairs.join(counts, "a").select(F.xxhash64("a", salt).alias("g"), "a", "b")
    want = salted.select("g", F.lit(1).alias("part"), F.col("b").alias("vertex"), "a")
    want = want.unionByName(salted.select("g", F.lit(0).alias("part"), F.col("a").alias("vertex"), "a").distinct())
    texts = want.join(texts, "vertex").select("g", "part", "vertex", "a", "t")
    texts = texts.repartition(shuffle_partitions(pairs.sparkSession), "g").sortWithinPartitions("g", "a", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            ends: tuple[list, list] = ([], [])
            part, vs, leaders = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for p, v, a, items in zip(part, vs, leaders, shingle_sets(batch.column(4), SHINGLE)):
                if digest_of(items) != v:
                    continue
                if p == 0:
                    leader, own = a, items
                elif a == leader:
                    common = len(own) + len(items) - len(np.union1d(own, items))
                    if 100 * common >= percent * (len(own) + len(items) - common):
                        ends[0].append(a)
                        ends[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], ["a", "b"])

    return materialise(texts.mapInArrow(trimmed(run), "a binary, b binary"), "links")


def op9_near_dedup(spark, sf_dir) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
