"""Language-model scores of whole texts, next to a unigram base.

The corpus is packed into chunks of some megabytes of text, each with its
distinct words and their subword ids. Counts of the words go round by the word:
from every chunk to the sum over the corpus, and back to the chunks, one row for
a word and chunk; a word of very many chunks is dealt to several tasks, and summed
in two levels. So no task holds the whole vocabulary, and texts are shuffled
once, compressed. The score of a word mixes the attention model's probability of
its ids with the word's share of all training words. The model's symbols, and how often one follows another, come
from all training documents. So do the attention's weights, trained where the chunks
lie; what each chunk changes is averaged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .attention_lm import ROUNDS, AttentionLM
from .common import SPACES, discard, documents, held_out, materialise, trimmed
from .shingles import CHUNK_BYTES, _fold, span_hashes, word_spans
from .token_files import WordTokenizer

#: Text of a chunk.
PACK_BYTES = 12 << 20
#: Changes of so many tasks are added up at a time.
SUMMED = 64
#: Chunks whose rows of one word meet in one task.
SPREAD = 1000
#: The attention model's part in the probability of a word; the rest is the word's own frequency.
MODEL_PART = 0.95
IDS_AT_ONCE = 1 << 18
_breaks = np.zeros(256, bool)
_breaks[[ord(c) for c in SPACES]] = True


class Texts:
    """The words of some texts: hash of each, in the order of the texts."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.data = _fold[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        starts, ends, hashes, first = [], [], [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            a, part = offsets[first], self.data[offsets[first] : offsets[last]]
            s, e = word_spans(part, offsets[first : last + 1] - a, _breaks)
            hashes.append(span_hashes(part, s, e))
            starts.append(s + a)
            ends.append(e + a)
            first = last
        self.starts, self.ends, hashes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, hashes))
        self.edges = np.searchsorted(self.starts, offsets)
        _, self.first, self.word = np.unique(hashes, return_index=True, return_inverse=True)

    def distinct(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[self.first].tolist(), self.ends[self.first].tolist())]


def packed(docs: DataFrame, tokenizer: str, pack_bytes: int) -> DataFrame:
    """Of documents (k, held, t): chunk, docs (an Arrow stream of k, held and the
    places of each text's words among the chunk's), words and counts
    (of training documents), ids of the words, id_counts and n_train."""
    key = to_arrow_type(docs.schema["k"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, z, number, task = _words_of(tokenizer), zstandard.ZstdCompressor(3), 0, TaskContext.get().partitionId()
        held, size = [], 0

        def row() -> pa.RecordBatch:
            ks, hs, ts = zip(*held)
            texts = Texts(list(ts))
            train = np.repeat(~np.array(hs, bool), np.diff(texts.edges))
            n = np.bincount(texts.word[train], minlength=len(texts.first)).astype("<u4")
            words = texts.distinct()
            # The frequent ones first: the tokenizer remembers them for the chunks that follow.
            order = np.argsort(-np.bincount(texts.word, minlength=len(words)), kind="stable").tolist()
            ids: list[bytes] = [b""] * len(words)
            for i, found in zip(order, tokens.words([words[i].decode("utf-8", "replace") for i in order])):
                ids[i] = found
            width = np.dtype(tokens.dtype).itemsize
            lengths = np.array([len(i) // width for i in ids], "<u4")
            pool = np.frombuffer(b"".join(ids), tokens.dtype)
            counts = np.bincount(pool, weights=np.repeat(n, lengths))
            some = np.flatnonzero(counts)
            sink = pa.BufferOutputStream()
            table = pa.table({"k": pa.array(ks, key), "held": pa.array(hs), "words": pa.ListArray.from_arrays(pa.array(texts.edges, pa.int32()), pa.array(texts.word, pa.int32()))})
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            lists = pa.array([words], pa.list_(pa.binary()))
            values = [
                pa.array([task << 32 | number], pa.int64()),
                pa.array([z.compress(sink.getvalue())], pa.binary()),
                lists,
                pa.array([n.tolist()], pa.list_(pa.int64())),
                pa.array([z.compress(struct.pack("<Q", len(lengths)) + lengths.tobytes() + pool.astype("<u4").tobytes())], pa.binary()),
                pa.array([list(zip(some.tolist(), counts[some].astype(int).tolist()))], pa.map_(pa.int32(), pa.int64())),
                pa.array([int(np.sum(~np.array(hs, bool)))], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(values, ["chunk", "docs", "words", "counts", "ids", "id_counts", "n_train"])

        for batch in batches:
            for k, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py()
                held.append((k, h, t))
                size += len(t or b"") + 16
                if size >= pack_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    return docs.mapInArrow(trimmed(pack), "chunk long, docs binary, words array<binary>, counts array<long>, ids binary, id_counts map<int, long>, n_train long")


def score_texts(
    df: DataFrame,
    learn,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    pack_bytes: int = PACK_BYTES,
    spread: int = SPREAD,
) -> DataFrame:
    """One row per document: ``key``, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    ``learn`` gives, for the key column, whether a document may be learned from.
    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A to Z folded, and one end.
    base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over them; c, N, V
    count the tokens of all training documents. score is the log10 probability of
    the words and the end: of each, ``MODEL_PART`` of what the attention model gives
    its subword ids after all before them, and the rest of c / N, which is 0 for
    words that training has not met.

    A null or empty text has the end as its only token. A null key is a key like
    others; keys may be of any type. Repeated rows are counted, and scored, each for itself. Without
    training documents N and V are 0, the model knows no ids and is the whole score. An empty table
    gives an empty one. Other columns are not read.
    """
    docs = df.select(F.col(key).alias("k"), (~learn(F.col(key))).alias("held"), F.col(text).cast("binary").alias("t"))
    chunks = materialise(packed(docs, tokenizer, pack_bytes), "chunks")
    n_train, n_chunks = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-n_chunks // spread))
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select("chunk", "i", "w.words", "w.counts")
    words = words.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(groups))).repartition("words", "g")
    sums = words.groupBy("words", "g").agg(F.sum("counts").alias("c"), F.min("chunk").alias("first"))
    if groups > 1:
        sums = sums.select("words", "g").join(sums.groupBy("words").agg(F.sum("c").alias("c"), F.min("first").alias("first")), "words")
    counted = words.select("chunk", "i", "words", "g").join(sums, ["words", "g"])
    counted = materialise(counted.select("chunk", "i", "c", (F.col("chunk") == F.col("first")).alias("once")), "counts")
    n, v = counted.where("once").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = n + n_train, v + (n_train > 0)

    ids = np.zeros(_words_of(tokenizer).model.get_vocab_size(with_added_tokens=True))
    for r in chunks.select(F.explode("id_counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        ids[r.id] = r.n
    ids[end_id] = n_train
    model = docs.sparkSession.sparkContext.broadcast(_trained(chunks, ids, end_id))
    floor = n + 0.5 * (v + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        place, c = right["i"].to_numpy(), right["c"].to_numpy()
        for blob, pool in zip(left["docs"], left["ids"]):
            table, word, edges, lengths, flat = _opened(blob.as_py(), pool.as_py(), end_id)
            count = np.zeros(len(lengths), np.int64)
            count[place] = c
            count[-1] = n_train
            out.append(_scored(table, word, edges, count, lengths, flat, model.value, floor, n))
        return pa.concat_tables(out)

    kind = docs.schema["k"].dataType.simpleString()
    pairs = chunks.select("chunk", "docs", "ids").groupBy("chunk").cogroup(counted.select("chunk", "i", "c").groupBy("chunk"))
    scored = pairs.applyInArrow(score, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("k", key)


def _scored(table: pa.Table, words: np.ndarray, edges: np.ndarray, count: np.ndarray, lengths: np.ndarray, flat: np.ndarray, model: AttentionLM, floor: float, n: int) -> pa.Table:
    n_docs = table.num_rows
    word = np.insert(words, edges[1:], len(count) - 1)  # an end after each text's words
    first = edges[:-1] + np.arange(n_docs)
    base = np.add.reduceat(np.log10((count + 0.5) / floor)[word], first)
    known = np.add.reduceat((count > 0)[word].astype(np.int64), first)
    begin = np.cumsum(lengths) - lengths
    per_doc = np.add.reduceat(lengths[word], first)
    scores, at = [], 0
    stops = np.cumsum(per_doc)
    while at < n_docs:
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + IDS_AT_ONCE, "right")))
        w = word[first[at] : first[to] if to < n_docs else len(word)]
        own = lengths[w]
        place = np.repeat(begin[w] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        each = np.add.reduceat(model.log10_of_ids(flat[place], per_doc[at:to]), np.cumsum(own) - own)
        scores.append(np.add.reduceat(_mixed(each, count[w], n), first[at:to] - first[at]))
        at = to
    n_tokens = np.diff(np.append(first, len(word)))
    columns = [table["k"], table["held"], pa.array(n_tokens), pa.array(known), pa.array(np.full(n_docs, n)), pa.array(base), pa.array(np.concatenate(scores))]
    return pa.table(columns, ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _mixed(model: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The log10 probability of each word, from the model's and its count of ``n``."""
    if not n:
        return model
    with np.errstate(divide="ignore"):
        own = np.log((1 - MODEL_PART) / n * count)
    return np.logaddexp(model * np.log(10) + np.log(MODEL_PART), own) / np.log(10)


def _opened(blob: bytes, pool: bytes, end_id: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's documents, the places of all their words and where each text's
    begin, and the ids of the words laid end to end with their numbers, the end last."""
    z = zstandard.ZstdDecompressor()
    table = pa.ipc.open_stream(z.decompress(blob)).read_all().combine_chunks()
    lists = table["words"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    raw = z.decompress(pool)
    size = struct.unpack_from("<Q", raw)[0]
    lengths = np.append(np.frombuffer(raw, "<u4", size, 8), 1).astype(np.int64)
    flat = np.append(np.frombuffer(raw, "<u4", -1, 8 + 4 * size), end_id).astype(np.int64)
    return table, lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64), lengths, flat


def _learnt(blob: bytes, pool: bytes, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk's training documents laid end to end, each with the end, and how many each has."""
    table, words, edges, lengths, flat = _opened(blob, pool, end_id)
    word = np.insert(words, edges[1:], len(lengths) - 1)
    learn = ~np.array(table["held"].to_pylist(), bool)
    per_doc = np.add.reduceat(lengths[word], edges[:-1] + np.arange(table.num_rows))[learn]
    word = word[np.repeat(learn, np.diff(edges) + 1)]
    own, begin = lengths[word], np.cumsum(lengths) - lengths
    return flat[np.repeat(begin[word] - (np.cumsum(own) - own), own) + np.arange(own.sum())], per_doc


def _successors(chunks: DataFrame, symbol: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a symbol follows another in all training documents: the one
    before, the one after, the number. Each task sums its chunks first; the
    result is bounded by the square of the symbols."""
    shared, n = chunks.sparkSession.sparkContext.broadcast(symbol), int(symbol.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob, pool in zip(batch.column(0), batch.column(1)):
                ids, _ = _learnt(blob.as_py(), pool.as_py(), end_id)
                x = np.full(len(ids) + 1, symbol_of(end_id), np.int64)
                x[1:] = shared.value[ids]
                total = np.zeros(n * n, np.uint32) if total is None else total
                codes = np.sort((x[:-1] * n + x[1:]).astype(np.uint32))
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
                total[codes[first]] += np.diff(np.append(first, len(codes))).astype(np.uint32)
        codes = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
        for i in range(0, len(codes), 1 << 16):
            some = codes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], ["code", "n"])

    def symbol_of(i: int) -> int:
        return int(shared.value[i])

    sums = chunks.select("docs", "ids").mapInArrow(trimmed(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    codes, times = (sums[c].to_numpy() for c in ("code", "n"))
    return codes // n, codes % n, times


def _trained(chunks: DataFrame, counts: np.ndarray, end_id: int) -> AttentionLM:
    model = AttentionLM(len(counts), end_id).tables(counts, lambda symbol: _successors(chunks, symbol, end_id))
    for step in range(ROUNDS):
        model.moved(_changes(chunks, model, step, end_id))
    return model


def _changes(chunks: DataFrame, model: AttentionLM, step: int, end_id: int) -> np.ndarray | None:
    """The sum of what training on every chunk changes: one row of numbers, of the
    same size for any corpus. Rows are added up some at a time, in as many levels
    as it takes."""
    shared = chunks.sparkSession.sparkContext.broadcast(model.learner())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob, pool in zip(batch.column(0), batch.column(1)):
                ids, sizes = _learnt(blob.as_py(), pool.as_py(), end_id)
                change = shared.value.deltas(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [], step)
                if change is not None:
                    total = change.astype("f8") if total is None else total + change
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype("f4").tobytes()], pa.binary())], ["part", "change"])

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = np.sum([np.frombuffer(c.as_py(), "f4") for c in rows["change"]], axis=0, dtype="f8").astype("f4")
        return pa.table({"part": pa.array([rows["part"][0].as_py() // SUMMED], pa.int64()), "change": pa.array([total.tobytes()], pa.binary())})

    changes = materialise(chunks.select("docs", "ids").mapInArrow(trimmed(learn), "part long, change binary"), "changes")
    shared.destroy()
    while changes.count() > 1:
        before, number = changes, F.expr(f"part div {SUMMED}L")
        changes = materialise(before.groupBy(number.alias("g")).applyInArrow(summed, "part long, change binary"), "changes")
        discard(before)
    found = changes.first()
    discard(changes)
    return np.frombuffer(found.change, "f4") if found else None


_tokenizers: dict[str, WordTokenizer] = {}


def _words_of(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path, 200_000)
    return _tokenizers[path]


def op4_attention_lm(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    return score_texts(docs, lambda key: ~held_out(key, 5, 1), public_tokenizers.path("word_bpe_49k.json"), 49407)
