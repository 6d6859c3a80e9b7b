"""Vectors stored by one-dimensional distance keys, searched by inner product.

With M the greatest length of any vector, x is augmented by sqrt(M^2 - |x|^2) and
a query q by 0: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the greatest inner
products are the smallest distances. Each x' belongs to its nearest pivot; the
store is sorted by (pivot, distance to it) and cut into files of blocks. By the
triangle inequality a vector at distance r of q' has its key within r of the
distance of q' to the pivot, so a search reads blocks in the order of their least
possible distance, an interval around q's own key that grows on both sides, and
ends when no block that is left can hold a better vector than the k-th found.

A window bounds the score from both sides: above, the search begins at an inner
annulus; below, it has an end even where fewer than k vectors are found.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, trimmed
from .vectors import stacked

#: Rows that pivots are chosen from (those of the smallest hashes, whatever the input), and pivots.
PIVOT_SAMPLE = 512
PIVOTS = 32
#: Rows of a block, and of a file at most by estimate.
BLOCK_ROWS = 1000
FILE_ROWS = 1 << 18
#: Queries searched together.
QUERY_ROWS = 256
LOWEST, HIGHEST = -(1 << 62), 1 << 62


@dataclass
class Space:
    """What every task knows: pivots (augmented), M^2 and how vectors are stored."""

    pivots: np.ndarray
    top: int
    dims: int
    dtype: str

    @property
    def exact(self):
        """Sums of products are integers up to M^2 on the way as well: this type has them all."""
        return np.float32 if self.top + 1 < 1 << 24 else np.float64

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1 + np.sqrt(self.top))

    def keys(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Distances of stored vectors to all pivots."""
        inner = v.astype(float) @ self.pivots[:, :-1].T + np.sqrt(self.top - norm2)[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(0, 2.0 * (self.top - inner)))

    def gaps(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots."""
        return np.sqrt(np.maximum(0, norm2[:, None] + self.top - 2.0 * (v.astype(float) @ self.pivots[:, :-1].T)))

    def radius(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which queries of such lengths have these scores."""
        return np.sqrt(np.maximum(0, norm2.astype(float) + self.top - 2.0 * score))


def pivots_of(v: np.ndarray, norm2: np.ndarray, top: int, n: int = PIVOTS) -> np.ndarray:
    """Farthest first: each next pivot is the row farthest from all before it."""
    x = np.column_stack([v.astype(float), np.sqrt(top - norm2)])
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


@dataclass
class Store:
    space: Space
    path: str
    #: Number of the file, its name, pivot, least and greatest key of the pivot in it: some 60 bytes for FILE_ROWS rows.
    ranges: list[tuple[int, str, int, float, float]]
    n: int


def build(rows: DataFrame, path: str, file_rows: int = FILE_ROWS, block_rows: int = BLOCK_ROWS) -> Store | None:
    """Stores ``rows`` (id long, label long, query boolean, v, norm2 as
    ``vectors.quantised`` has them) under ``path``; None if there are none.

    The range partitions are by (pivot, key, id), so that vectors met again and
    again are spread over files as well.
    """
    spark = rows.sparkSession
    n, top, widest = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.octet_length("v"))).first()
    if not n:
        return None
    dims, largest = max(1, widest // 8), int(np.sqrt(top)) + 1
    dtype = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    sample = rows.select("v", "norm2").orderBy(F.xxhash64("id", "v"), "v").limit(PIVOT_SAMPLE).toArrow()
    pivots = pivots_of(stacked(sample.column(0), dims), sample.column(1).to_numpy(), top)
    space = Space(pivots, top, dims, dtype)
    width = np.dtype(dtype).itemsize * dims

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            v = stacked(some.column(3), dims)
            keys = space.keys(v, some.column(4).to_numpy())
            pivot = keys.argmin(1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(v), [None, pa.py_buffer(v.astype(dtype).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot.astype(np.int32)), pa.array(keys[np.arange(len(v)), pivot]), *some.columns[:3], packed.cast(pa.binary()), some.column(4)],
                ["pivot", "dist", "id", "label", "query", "v", "norm2"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, writer = TaskContext.get().partitionId(), None
        for some in batches:
            if writer is None:
                writer = KeyFileWriter(fs, f"{root}/part-{part:06d}-{uuid.uuid4().hex[:12]}.arrow", width, block_rows)
            writer.add(some)
        if writer is not None:
            found = [(part, writer.path, *r) for r in writer.close()]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["file", "name", "pivot", "lo", "hi"])

    files = max(-(-n // file_rows), min(shuffle_partitions(spark), -(-n // (4 * block_rows))))
    schema = "pivot int, dist double, id long, label long, query boolean, v binary, norm2 long"
    sorted_rows = rows.select("id", "label", "query", "v", "norm2").mapInArrow(keyed, schema).repartitionByRange(files, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    ranges = materialise(sorted_rows.mapInArrow(trimmed(write), "file int, name string, pivot int, lo double, hi double"), "key-ranges")
    return Store(space, path, [tuple(r) for r in ranges.orderBy("file", "pivot").collect()], n)


class KeyFileWriter:
    """One file of the store: blocks of one pivot each, sorted by key, and their
    directory in a second file. The name appears when both are complete."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int, block_rows: int):
        self.fs, self.path, self.blocks, self.block_rows = fs, path, [], block_rows
        self.sink = fs.open_output_stream(f"{path}.tmp")
        self.schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("query", pa.bool_()), ("v", pa.binary(width)), ("norm2", pa.int64())])
        self.out = pa.ipc.new_file(self.sink, self.schema)

    def add(self, rows: pa.RecordBatch) -> None:
        pivot, dist = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, self.block_rows):
                n = min(self.block_rows, b - at)
                self.out.write_batch(pa.RecordBatch.from_arrays([rows.column(i).slice(at, n).cast(self.schema.field(i - 2).type) for i in range(2, 7)], schema=self.schema))
                self.blocks.append((int(pivot[at]), float(dist[at]), float(dist[at + n - 1]), n))

    def close(self) -> list[tuple[int, float, float]]:
        self.out.close()
        self.sink.close()
        pivot, lo, hi, n = (np.array(c) for c in zip(*self.blocks))
        held = io.BytesIO()
        np.savez(held, pivot=pivot, lo=lo, hi=hi, n=n)
        with self.fs.open_output_stream(f"{self.path}.keys") as f:
            f.write(held.getvalue())
        self.fs.move(f"{self.path}.tmp", self.path)
        return [(int(p), float(lo[pivot == p].min()), float(hi[pivot == p].max())) for p in np.unique(pivot)]


@dataclass
class Queries:
    """Queries searched together. A window belongs to a query and asks for the
    best ``k`` vectors with low <= score <= high."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm2: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray


class KeyFile:
    def __init__(self, fs: pafs.FileSystem, path: str, space: Space):
        self.space = space
        self.source = fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        with fs.open_input_stream(f"{path}.keys") as f:
            keys = np.load(io.BytesIO(f.read()))
            self.pivot, self.lo, self.hi = keys["pivot"], keys["lo"], keys["hi"]
        self.read = 0

    def close(self) -> None:
        self.source.close()

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """id, label, query, vectors, norm2."""
        self.read += 1
        some = self.file.get_batch(b)
        v = np.frombuffer(some.column(3).buffers()[1], self.space.dtype, count=some.num_rows * self.space.dims).reshape(some.num_rows, -1)
        return some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).to_numpy(zero_copy_only=False), v, some.column(4).to_numpy()

    def queries(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows marked as queries, numbered within the file, in the order of keys, QUERY_ROWS at most at once."""
        held, n, first = [], 0, 0
        for b in range(len(self.pivot)):
            id, label, query, v, norm2 = self.block(b)
            if query.any():
                held.append([a[query] for a in (id, label, v, norm2)])
                n += len(held[-1][0])
            while n >= QUERY_ROWS or n and b + 1 == len(self.pivot):
                whole = [np.concatenate(c) for c in zip(*held)]
                yield first, *(c[:QUERY_ROWS] for c in whole)
                first += min(n, QUERY_ROWS)
                held, n = [[c[QUERY_ROWS:] for c in whole]], max(0, n - QUERY_ROWS)

    def search(self, q: Queries, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the windows the best ``k`` of this file among the rows of the
        query's label (``same``) or of other labels, rows of the query's own id
        left out: window, score and id of each, the best first, ties by id."""
        space, m = self.space, len(q.of)
        scores, ids = np.full((m, k), LOWEST, np.int64), np.full((m, k), np.iinfo(np.int64).max)
        gaps = space.gaps(q.v, q.norm2)[:, self.pivot]
        least = np.maximum(0, np.maximum(gaps - self.hi, self.lo - gaps))[q.of] - space.slack
        most = (gaps + self.hi)[q.of] + space.slack
        norm2, v = q.norm2[q.of], q.v.astype(space.exact)
        inner = space.radius(norm2, np.minimum(q.high, space.top))
        inner = np.where(q.high >= HIGHEST, 0.0, inner)
        floor = q.low.copy()
        outer = np.where(floor > LOWEST, space.radius(norm2, np.maximum(floor, -space.top).astype(float)), np.inf)
        nearest = least.min(0)
        for b in np.argsort(nearest, kind="stable"):
            if nearest[b] > outer.max():
                break  # no block that is left can hold a better vector, for any window
            open_ = np.flatnonzero((least[:, b] <= outer) & (most[:, b] >= inner) & (floor <= q.high))
            if not len(open_):
                continue
            id, label, _, x, _ = self.block(b)
            which, place = np.unique(q.of[open_], return_inverse=True)
            s = v[which] @ x.astype(space.exact).T
            fits = (label[None, :] == q.label[which][:, None]) == same
            fits &= id[None, :] != q.id[which][:, None]
            s, fits = s[place], fits[place]
            # bounds as floats lose nothing: scores are integers from -M^2 to M^2, which the type has exactly
            fits &= s >= np.clip(floor[open_], -space.top - 1, space.top + 1).astype(s.dtype)[:, None]
            fits &= s <= np.clip(q.high[open_], -space.top - 1, space.top + 1).astype(s.dtype)[:, None]
            r, c = np.nonzero(fits)
            if not len(r):
                continue
            touched = np.unique(open_[r])
            _best(scores, ids, touched, open_[r], s[r, c].astype(np.int64), id[c])
            floor[touched] = np.maximum(q.low[touched], scores[touched, -1])
            full = touched[floor[touched] > LOWEST]
            outer[full] = space.radius(norm2[full], floor[full].astype(float))
        w, r = np.nonzero(scores > LOWEST)
        return w, scores[w, r], ids[w, r]


def _best(scores: np.ndarray, ids: np.ndarray, touched: np.ndarray, row: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
    """Merges new (row, score, id) into the best of the rows ``touched``."""
    k = scores.shape[1]
    row = np.concatenate([row, np.repeat(touched, k)])
    score = np.concatenate([score, scores[touched].ravel()])
    id = np.concatenate([id, ids[touched].ravel()])
    order = np.lexsort((id, -score, row))
    row, score, id = row[order], score[order], id[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    take = rank < k
    scores[row[take], rank[take]], ids[row[take], rank[take]] = score[take], id[take]


HOME = "number long, file int, id long, label long, v binary, norm2 long, scores array<long>, ids array<long>"


def search_home(store: Store, spark, k: int, same: bool = True) -> DataFrame:
    """Every query's best ``k`` of its own file, where its nearest keys are: a
    first bound for the other files. Columns of HOME; number tells queries apart."""
    space, path = store.space, store.path
    names = sorted({(r[0], r[1]) for r in store.ranges})
    files = spark.createDataFrame(names, "file int, name string").repartition(max(shuffle_partitions(spark), 1), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for some in batches:
            for number, name in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                file = KeyFile(fs, name, space)
                for first, id, label, v, norm2 in file.queries():
                    m = len(id)
                    q = Queries(np.arange(m), id, label, v, norm2, np.arange(m), np.full(m, LOWEST), np.full(m, HIGHEST))
                    w, s, i = file.search(q, same, k)
                    ends = np.searchsorted(w, np.arange(m + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.int64(number) << 32) + first + np.arange(m)), pa.array(np.full(m, number, np.int32)), pa.array(id), pa.array(label), pa.array([r.tobytes() for r in v.astype(space.dtype)], pa.binary()), pa.array(norm2)]
                        + [pa.ListArray.from_arrays(ends, pa.array(a, pa.int64())) for a in (s, i)],
                        [c.split()[0] for c in HOME.split(", ")],
                    )
                file.close()

    return files.mapInArrow(trimmed(run), HOME)


DEALT = "to int, name string, number long, id long, label long, v binary, norm2 long, lows array<long>, highs array<long>, tags array<long>"


def deal(store: Store, queries: DataFrame, skip_home: bool) -> DataFrame:
    """``queries`` (number, file, id, label, v, norm2, lows, highs, tags: lists of
    the windows' bounds and of a number that the result carries) for every file
    that can hold a vector within a window; windows that it cannot are left out."""
    space = store.space
    names = sorted({(r[0], r[1]) for r in store.ranges})
    place = {f: i for i, (f, _) in enumerate(names)}
    at, pivot = np.array([place[r[0]] for r in store.ranges]), np.array([r[2] for r in store.ranges])
    lo, hi = np.array([r[3] for r in store.ranges]), np.array([r[4] for r in store.ranges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                some = whole.slice(start, QUERY_ROWS)
                v = np.frombuffer(b"".join(some.column(4).to_pylist()), space.dtype).reshape(some.num_rows, -1)
                norm2 = some.column(5).to_numpy()
                lows, highs, tags = (some.column(i).to_pylist() for i in (6, 7, 8))
                of = np.repeat(np.arange(some.num_rows), [len(x) for x in lows])
                low, high, tag = (np.array([y for x in c for y in x], np.int64) for c in (lows, highs, tags))
                outer = np.where(low > LOWEST, space.radius(norm2[of], np.maximum(low, -space.top)), np.inf)
                inner = np.where(high < HIGHEST, space.radius(norm2[of], np.minimum(high, space.top)), 0)
                gaps = space.gaps(v, norm2)[:, pivot]
                least = np.maximum(0, np.maximum(gaps - hi, lo - gaps))[of] - space.slack
                meets = (least <= outer[:, None]) & ((gaps + hi)[of] + space.slack >= inner[:, None]) & (low <= high)[:, None]
                home = some.column(1).to_pylist()
                for f, (number, name) in enumerate(names):
                    w = np.flatnonzero(meets[:, at == f].any(1))
                    if skip_home:
                        w = w[[home[i] != number for i in of[w]]] if len(w) else w
                    if not len(w):
                        continue
                    rows, starts = np.unique(of[w], return_index=True)
                    ends = np.r_[starts, len(w)].astype(np.int32)
                    taken = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), number, np.int32)), pa.array([name] * len(rows)), taken.column(0), *taken.columns[2:6]] + [pa.ListArray.from_arrays(ends, pa.array(a[w])) for a in (low, high, tag)],
                        [c.split()[0] for c in DEALT.split(", ")],
                    )

    wanted = queries.select("number", "file", "id", "label", "v", "norm2", "lows", "highs", "tags")
    return wanted.mapInArrow(run, DEALT)


FOUND = "number long, anchor long, tag long, low long, high long, score long, id long"


def search(store: Store, queries: DataFrame, same: bool, k: int, chunk_rows: int = 1 << 16, n_queries: int | None = None, skip_home: bool = False) -> DataFrame:
    """The best ``k`` of each file for each window (columns of FOUND); the best of
    all files are among them. A task has a file and up to about ``chunk_rows`` of
    its queries, which stream by: neither all queries nor all vectors of a
    partition are held."""
    space, path = store.space, store.path
    chunks = max(1, -(-(n_queries or 1) // chunk_rows))
    dealt = deal(store, queries, skip_home).withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)))
    dealt = dealt.repartition(shuffle_partitions(queries.sparkSession), "to", "chunk").sortWithinPartitions("to", "chunk", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        at = file = None
        for whole in batches:
            names = whole.column(1).to_pylist()
            start = 0
            while start < len(names):
                end = start + 1
                while end < len(names) and names[end] == names[start] and end - start < QUERY_ROWS:
                    end += 1
                if names[start] != at:
                    if file is not None:
                        file.close()
                    at, file = names[start], KeyFile(fs, names[start], space)
                some = whole.slice(start, end - start)
                start = end
                number, id, label, norm2 = (some.column(i).to_numpy() for i in (2, 3, 4, 6))
                v = np.frombuffer(b"".join(some.column(5).to_pylist()), space.dtype).reshape(len(id), -1)
                lists = [some.column(i).to_pylist() for i in (7, 8, 9)]
                low, high, tag = (np.array([y for x in c for y in x], np.int64) for c in lists)
                of = np.repeat(np.arange(len(id)), [len(x) for x in lists[0]])
                w, s, i = file.search(Queries(number, id, label, v, norm2, of, low, high), same, k)
                columns = (number[of[w]], id[of[w]], tag[w], low[w], high[w], s, i)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])
        if file is not None:
            file.close()

    return dealt.drop("chunk").mapInArrow(trimmed(run), FOUND)
