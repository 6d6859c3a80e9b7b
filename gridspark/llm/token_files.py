"""Token ids as Arrow files of equal-length sequences.

The ids of a run of documents, in ascending order of their key, form one stream.
It is cut into sequences of ``length`` ids; a record batch holds a fixed number
of them as fixed-size lists, with a mask of the same shape (the last sequence of
a file is padded, and masked). Because every batch has the same shape, sequence
``i`` is at a known place, and reading it from a memory-mapped file copies
nothing. A second file says where in the stream each document lies.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, materialise, running_before, scratch_path, shuffle_partitions, trimmed

LENGTH = 1024
BATCH = 256
FILE_TOKENS = 32 << 20
CACHED_WORDS = 400_000
SMALL_BATCH = 512


class WordTokenizer:
    """Ids of whole texts, by a tokenizer that treats white space as a word's end.

    Texts are cut at spaces and line feeds, and the ids of each piece are kept in
    a bounded memory of pieces: no token of this tokenizer spans white space, so
    the ids of a text are those of its pieces. What does not hold for every
    vocabulary is checked once: that two words give the same ids together.
    """

    def __init__(self, path: str, capacity: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.capacity = capacity
        self.dtype = np.uint16 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {"": b""}
        self.pack = [struct.Struct(f"={n}{np.dtype(self.dtype).char}").pack for n in range(65)]
        self.stops = {c: self._whole(c) for c in ".,"}
        self.ends_word = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        for token, k in self.model.get_vocab(with_added_tokens=True).items():
            self.ends_word[k] = token.endswith("</w>")
        self.piecewise = all(self._whole(f"{a}{s}{b}") == self._whole(a) + self._whole(b) for s in " \n" for a in ("the", "x.", "9") for b in ("one", "'s", ",")) and all(
            self.ends_word[ids := np.frombuffer(self._whole(w), self.dtype)].sum() == 1 and [t.id for t in self.model.model.tokenize(w)] == ids.tolist() for w in ("the", "zqxjk")
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        if not self.piecewise:
            return [self._whole(t) for t in texts]
        known, cut = self.known, [t.replace("\n", " ").split(" ") for t in texts]
        fresh = set()
        for pieces in cut:
            fresh.update(pieces)
        fresh = [p for p in fresh if p not in known]
        self._learn(fresh)
        out = [b"".join([known[p] for p in pieces]) for pieces in cut]
        if len(known) > self.capacity:  # full: what this call added goes again
            for p in fresh:
                del known[p]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space in them, each as bytes of ``dtype``.
        Of new words the first are kept, as many as there is room for."""
        if not self.piecewise:
            return [self._whole(w) for w in words]
        fresh = [w for w in words if w not in self.known]
        self._learn(fresh)
        out = [self.known[w] for w in words]
        over = len(self.known) - self.capacity
        if over > 0:
            for w in fresh[-over:]:
                self.known.pop(w, None)  # two words of bad bytes may read alike
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new pieces. Of a word before one stop or comma, or of other
        case, those of the word are used; ASCII words go to the model as they
        are (nothing in front of it would change them), other words many at a
        time, as each ends with its one end-of-word id."""
        known, new, tails, rest = self.known, {}, [], []
        for p in fresh:
            word = p.lower() if p.isascii() else p
            tail = word[-1] if word[-1] in ".," else ""
            word = word[:-1] if tail else word
            if not word.isalpha():
                rest.append(p)
                continue
            if word not in known and word not in new:
                new[word] = b""
            tails.append((p, word, tail))
        tokenize, pack = self.model.model.tokenize, self.pack
        others = []
        for w in new:
            if w.isascii():
                new[w] = pack[len(ids := [t.id for t in tokenize(w)])](*ids) if len(w) < 64 else self._whole(w)
            else:
                others.append(w)
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                new.update(zip(some, (x.tobytes() for x in np.split(ids, ends[:-1]))))
            else:  # a letter whose lower case is no letter alone
                new.update((w, self._whole(w)) for w in some)
        for p, word, tail in tails:
            ids = new[word] if word in new else known[word]
            known[p] = ids + self.stops[tail] if tail else ids
        for p in rest:
            known[p] = self._whole(p)


class SequenceWriter:
    """Writes one file of sequences and its index; both appear whole or not at all."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype, length: int, batch: int):
        self.fs, self.path, self.dtype, self.length, self.batch = fs, path, np.dtype(dtype), length, batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self.sink = fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held, self.n, self.docs = [], 0, 0, []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.docs.append((key, self.n, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.length * self.batch:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        ids, full = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype), self.length * self.batch
        while len(ids) >= full or final and len(ids):
            part, ids = ids[:full], ids[full:]
            mask = np.ones(len(part) + -len(part) % self.length, bool)
            mask[len(part) :] = False
            part = np.concatenate((part, np.zeros(len(mask) - len(part), self.dtype)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (part, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n_held = [ids], len(ids)

    def close(self, key_type: pa.DataType) -> tuple[str, int, int]:
        self._write(final=True)
        self.out.close()
        self.sink.close()
        index = pa.table({"key": pa.array([d[0] for d in self.docs], key_type), "start": pa.array([d[1] for d in self.docs], pa.int64()), "n": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(f"{self.temp}.index") as f, pa.ipc.new_file(f, index.schema) as out:
            out.write_table(index, 65536)
        self.fs.move(f"{self.temp}.index", f"{self.path}.index")
        self.fs.move(self.temp, self.path)
        return self.path, len(self.docs), self.n


class SequenceFile:
    """Random access to the sequences and the token stream of a file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat = -1, None
        if self.file.num_record_batches:
            self.batch = self.file.get_batch(0).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file's memory) and mask of sequence ``i``."""
        b = self.file.get_batch(i // self.batch)
        ids, mask = (b.column(k).slice(i % self.batch, 1).flatten() for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the stream."""
        parts = []
        while n > 0:
            full = self.length * self.batch
            if start // full != self.at:
                self.at = start // full
                self.flat = self.file.get_batch(self.at).column(0).flatten().to_numpy(zero_copy_only=True)
            part = self.flat[start % full : start % full + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_sequences(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    batch: int = BATCH,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Writes the ids of all whole texts under ``path`` and returns the list of
    files: part, number, file, n_docs, n_tokens.

    Documents are in ascending order of ``key`` (null first, ties by text) within
    a file and from file to file. A null text is an empty one: its end id alone.
    Repeated rows are each written. An empty table gives no files. Other columns
    are not read, whatever their names. A task that is run again writes files of
    the same name and content; nothing is listed before it is complete.
    """
    kind = to_arrow_type(df.schema[key].dataType)
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), "k").sortWithinPartitions("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, number, words, writer, done = TaskContext.get().partitionId(), 0, _tokenizer(tokenizer), None, []
        end = np.array([end_id], words.dtype)
        for whole in batches:
            for at in range(0, whole.num_rows, SMALL_BATCH):
                some = whole.slice(at, SMALL_BATCH)
                for k, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist())):
                    if writer is None:
                        writer = SequenceWriter(fs, f"{root}/part-{part:06d}-{number:05d}.arrow", words.dtype, length, batch)
                    writer.add(k, np.concatenate((np.frombuffer(ids, words.dtype), end)))
                    if writer.n >= file_tokens:
                        done.append((part, number, *writer.close(kind)))
                        writer, number = None, number + 1
        if writer is not None:
            done.append((part, number, *writer.close(kind)))
        columns = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "number", "file", "n_docs", "n_tokens"])

    files = rows.mapInArrow(trimmed(write), "part int, number int, file string, n_docs long, n_tokens long")
    return materialise(files, "token-files")


def read_documents(files: DataFrame, path: str, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """One row per document, read back from the files: its key, start (ids of all
    documents before it), n_tokens and ids_crc32, the CRC of its ids as
    little-endian unsigned 32-bit integers."""
    first = running_before("n_tokens", [], ["part", "number"])
    listed = files.select("part", "number", "file", first.alias("first")).repartition(shuffle_partitions(files.sparkSession), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for some in batches:
            for file, base in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                stored = SequenceFile(fs, file)
                with fs.open_input_file(f"{file}.index") as f:
                    index = pa.ipc.open_file(f)
                    for b in range(index.num_record_batches):
                        docs = index.get_batch(b)
                        starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crcs = [zlib.crc32(stored.tokens(int(s), int(n)).astype("<u4")) for s, n in zip(starts, counts)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(trimmed(read), f"key {key_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_table(spark, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(spark, "sequences")
    files = write_sequences(docs.select("doc_id", "text"), path, tokenizer, 1)
    return read_documents(files, path, key_type=dict(docs.dtypes)["doc_id"])


def op8_token_files(spark, sf_dir) -> DataFrame:
    return token_table(spark, documents(spark, sf_dir))
