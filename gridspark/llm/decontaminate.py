"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their lower-cased words joined by single spaces, with a space at
either end, so that a window of words occurs in a text exactly where its own
string occurs. Windows are searched in groups of like length. In each group a
shift table tells, for the block of bytes that ends at the current position, how
far the search may jump without passing an occurrence; at shift 0 the bucket of
that block (the suffix hash of the windows' first ``m`` bytes) gives the
candidates, which are compared directly.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, discard, documents, materialise, trimmed

WINDOW = 13
#: Item texts are searched for in groups of so many bytes at most; each group is one pass over the texts. A worker's
#: tables take about 150 bytes for a byte of items, 300 MB for a group.
GROUP_BYTES = 2 << 20
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_FOLD)) if text else []


def joined(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode("utf-8", "surrogatepass")


def windows_of(words: list[str], n: int = WINDOW) -> Iterator[list[str]]:
    if words:
        for i in range(max(1, len(words) - n + 1)):
            yield words[i : i + n]


class WuManber:
    """Search for byte strings ``patterns`` (string to its set of owners)."""

    def __init__(self, patterns: dict[bytes, set[int]]):
        self.owners = patterns
        self.groups = []
        # A group's jump is bounded by its shortest pattern: each group spans one doubling of the length.
        by_length: dict[int, list[bytes]] = {}
        for p in patterns:
            by_length.setdefault(len(p).bit_length(), []).append(p)
        for group in by_length.values():
            m = min(map(len, group))
            # The block is long enough that few blocks of a text are in the table, short enough to leave wide jumps.
            block = max(2, min(12, m // 3)) if m >= 3 else 1
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, list[bytes]] = {}
            for p in group:
                for end in range(block, m + 1):
                    b = p[end - block : end]
                    if shift.get(b, m) > m - end:
                        shift[b] = m - end
                bucket.setdefault(p[m - block : m], []).append(p)
            self.groups.append((m, block, m - block + 1, shift, bucket))

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Every occurrence: where it starts, and the pattern."""
        n = len(text)
        for m, block, most, shift, bucket in self.groups:
            jump, i = shift.get, m
            while i <= n:
                b = text[i - block : i]
                s = jump(b, most)
                if s:
                    i += s
                    continue
                for p in bucket[b]:
                    if text.startswith(p, i - m):
                        yield i - m, p
                i += 1


def spans_in(search: WuManber, n_words: int, text: bytes) -> tuple[np.ndarray, set[int]]:
    """Which words lie in an occurrence, and the items of which a window occurs."""
    hit, items, starts = np.zeros(n_words, bool), set(), None
    for at, p in search.find(text):
        if starts is None:  # where each word's leading space is
            starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = int(np.searchsorted(starts, at))
        hit[first : first + p.count(b" ") - 1] = True
        items |= search.owners[p]
    return hit, items


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def find_contamination(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """All columns of ``df`` and n_words, n_hit, hit_spans, n_items, hit_items, items_sha256, contaminated.

    A document word inside an occurrence of any window of ``window``
    consecutive words of an item is hit; an item of fewer words, but not none,
    is one window. ``hit_spans`` holds the runs of hit words (first word, words),
    ``hit_items`` the ids of the items, as sorted strings. A document is
    contaminated where at least a twentieth of its words are hit.

    The items go to the executors in groups of ``group_bytes`` of text at most,
    by a hash; more items mean more groups, each one more pass over the texts, which
    reads what the pass before has written and adds to its columns. So a task runs
    one search whatever the items, and two copies of the texts are on disk at most.
    No item is left out, and no two tables are joined.

    A null or empty text, or one without words, has n_words 0 and is never
    contaminated. Items with a null or wordless text match nothing; a null
    item id counts as the string ``null``. Repeated items count once, repeated
    documents each get their row. Empty tables are fine on either side. Input
    columns named like an output column are replaced.
    """
    df = df.drop(*({"n_words", "n_hit", "hit_spans", "n_items", "hit_items", "items_sha256", "contaminated", "_seen"} - {text}))
    own = df.columns
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())])
    seen = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    written = None
    for group in _groups(items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")), group_bytes):
        if "_seen" in df.columns:  # one search a task: the pass before is written, and what it read is deleted
            df = materialise(df, "searched")
            discard(written)
            written = df
        df = _searched(df, df.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex, text, window, seen, "_seen" in df.columns)
    if "_seen" not in df.columns:  # no items: words are still counted
        df = _searched(df, df.sparkSession.sparkContext.broadcast([]), uuid.uuid4().hex, text, window, seen, False)
    n_hit = F.aggregate("_seen.spans", F.lit(0).cast("long"), lambda total, s: total + s["words"])
    return df.select(
        *own,
        "_seen.n_words",
        n_hit.alias("n_hit"),
        F.col("_seen.spans").alias("hit_spans"),
        F.size("_seen.items").cast("long").alias("n_items"),
        F.col("_seen.items").alias("hit_items"),
        F.sha2(F.array_join("_seen.items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("_seen.n_words"))).alias("contaminated"),
    )


def _groups(items: DataFrame, group_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of bounded size: one group is on the driver at a time."""
    items = items.where(F.col("t").isNotNull()).select(F.coalesce(F.col("i").cast("string"), F.lit("null")).alias("i"), "t").distinct()
    size = F.octet_length("t").cast("long") + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // group_bytes))
    if n > 1:  # hashing evens the groups out; they are read back from a table, once each
        items = materialise(items.withColumn("g", F.pmod(F.xxhash64("i", "t"), F.lit(n))), "items")
    for g in range(n):
        rows = (items if n == 1 else items.where(F.col("g") == g)).select("i", "t").collect()
        if rows:
            yield [(r.i, r.t) for r in rows]


def _searched(df: DataFrame, group, key: str, text: str, window: int, seen: T.StructType, further: bool) -> DataFrame:
    schema = df.schema if further else T.StructType([*df.schema.fields, T.StructField("_seen", seen)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wm, names = _compiled(group, key, window)
        for batch in batches:
            texts = batch[text] if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(text))
            before = batch.column(batch.schema.get_field_index("_seen")) if further else None
            out = []
            for k, t in enumerate(texts):
                words = words_of(t.as_py())
                hit, items = spans_in(wm, len(words), joined(words)) if words else (np.zeros(0, bool), set())
                found = {names[i] for i in items}
                if further:
                    old = before[k].as_py()
                    for s in old["spans"]:
                        hit[s["start"] : s["start"] + s["words"]] = True
                    found |= set(old["items"])
                edge = np.flatnonzero(np.diff(hit, prepend=False, append=False)) if hit.any() else ()
                spans = [{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                out.append({"n_words": len(words), "spans": spans, "items": sorted(found)})
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_seen"]
            kept = [n for n in batch.schema.names if n != "_seen"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _SEEN)], [*kept, "_seen"])

    return df.mapInArrow(trimmed(search), schema)


_SEEN = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), ("items", pa.list_(pa.string()))])
_cache: dict[str, tuple[WuManber, list[str]]] = {}


def _compiled(group, key: str, window: int) -> tuple[WuManber, list[str]]:
    """The search for a broadcast group; a worker keeps the latest."""
    if key not in _cache:
        patterns: dict[bytes, set[int]] = {}
        names = sorted({i for i, _ in group.value})
        number = {n: k for k, n in enumerate(names)}
        for i, t in group.value:
            for w in windows_of(words_of(t), window):
                patterns.setdefault(joined(w), set()).add(number[i])
        _cache.clear()
        _cache[key] = WuManber(patterns), names
    return _cache[key]


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = find_contamination(docs, documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN lengths ON len(w) >= n)),
occ AS (SELECT k, i, n, item FROM places JOIN win USING (n, s)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM occ) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)"""
