"""Convolutional text classifier.

Words are hashed twice; a word's vector is the sum of a row of either table, so
that two words share a vector only where both hashes agree. Filters of several
widths slide over the vectors, the strongest response of each filter in the
whole text is kept, and a logistic layer gives a score. The model is trained in
numpy on a bounded sample of labelled rows; all weights start at random but for
one column of the tables, which starts at the words' log odds. A part of the
sample is held back from training: it tells when to stop, the score is calibrated
on it, and so is a threshold for each language.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, held_out, materialise, remove, scratch_path, trimmed
from .shingles import hashed_words

#: The classifier learns from so many labelled rows at most, the first by hash of their id, and from so many bytes of text.
SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
#: A text of more than this part of the sample's bytes is not learned from, so that a few long ones don't fill it.
LONGEST_PART = 16
BITS, SIZE, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
#: Training ends when the loss on the rows held back has not fallen for ``PATIENCE`` epochs, and keeps the best epoch's weights.
EPOCHS, PATIENCE, BATCH, RATE = 40, 3, 32, 0.1
#: Every so-manieth row of the sample is kept from training, for calibration.
CALIBRATION = 4
THRESHOLD = 0.3
ROWS_AT_ONCE = 256
#: A language with fewer toxic rows in the calibration part has the threshold of all.
LEAST_TOXIC = 10
_breaks = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def word_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of both tables for the words of runs of texts, and each text's first word."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    for words, edges in hashed_words(lowered, _breaks):
        yield (words & np.uint64((1 << BITS) - 1)).astype(np.int32), (words >> np.uint64(64 - BITS)).astype(np.int32), edges


@dataclass
class TextCNN:
    seed: int = 7
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.first, self.second = (rng.normal(0, 0.01, (1 << BITS, SIZE)).astype("f4") for _ in range(2))
        self.filters = [rng.normal(0, 0.3 / w, (w * SIZE, FILTERS)).astype("f4") for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, "f4") for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype("f4")
        self.bias = np.float32(-2)
        self.scale, self.offset = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.threshold = THRESHOLD

    def responses(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Vectors of the words, and each width's responses at each place."""
        x = self.first[a] + self.second[b]
        found = []
        for w, f, shift in zip(WIDTHS, self.filters, self.shift):
            n = max(0, len(x) - w + 1)
            y = x[:n] @ f[:SIZE] + shift
            for i in range(1, w):
                y += x[i : i + n] @ f[i * SIZE : (i + 1) * SIZE]
            found.append(y)
        return x, found

    def pooled(self, a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Strongest response of each filter in each text; 0 where there is none above."""
        _, found = self.responses(a, b)
        out = np.zeros((len(edges) - 1, len(WIDTHS) * FILTERS), "f4")
        for k, (w, y) in enumerate(zip(WIDTHS, found)):
            for i in range(1, w):  # windows that reach into the next text
                over = edges[1:] - i
                y[over[(over >= 0) & (over < len(y))]] = 0
            full = np.flatnonzero(np.minimum(edges[1:], len(y)) > edges[:-1])
            if len(full):
                part = np.maximum.reduceat(y, edges[:-1][full], axis=0)
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(part, 0)
        return out

    def logits(self, texts: pa.Array) -> np.ndarray:
        parts = [self.pooled(a, b, e) @ self.out + self.bias for a, b, e in word_buckets(texts)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.scale * self.logits(texts) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    # Training

    def fit(self, texts: pa.Array, labels: np.ndarray, langs: list[str | None], epochs: int = EPOCHS) -> TextCNN:
        """Trains on the rows and calibrates on every fourth. Without rows of
        both labels the model stays as it began, which scores low throughout."""
        if len(set(labels.tolist())) < 2:
            return self
        docs = [(a[s:e], b[s:e]) for a, b, edges in word_buckets(texts) for s, e in zip(edges[:-1], edges[1:])]
        apart = np.arange(len(docs)) % CALIBRATION == CALIBRATION - 1
        if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
            apart[:] = False  # too few: train and calibrate on all
        learn = np.flatnonzero(~apart)
        rows = np.flatnonzero(apart) if apart.any() else learn.copy()
        self._begin([docs[i] for i in learn], labels[learn])
        rng = np.random.default_rng(self.seed)
        sums = {id(p): np.full(p.shape, 1e-6, "f4") for p in self._weights()}
        best, since, kept, z = np.inf, 0, None, None
        for epoch in range(epochs):
            rng.shuffle(learn)
            for at in range(0, len(learn), BATCH):
                self._step([docs[i] for i in learn[at : at + BATCH]], labels[learn[at : at + BATCH]], sums, RATE / (1 + epoch / 2))
            now = np.array([self._logit(*docs[i]) for i in rows])
            loss = float(np.mean(np.logaddexp(0, np.where(labels[rows] == 1, -now, now))))
            since = 0 if loss < best else since + 1
            if loss < best:
                best, kept, z = loss, ([p.copy() for p in self._weights()], self.bias), now
            if since == PATIENCE:
                break
        for p, was in zip(self._weights(), kept[0]):
            p[...] = was
        self.bias = kept[1]
        self._calibrate(z, labels[rows], [langs[i] for i in rows])
        return self

    def _weights(self) -> list[np.ndarray]:
        return [self.first, self.second, *self.filters, *self.shift, self.out]

    def to_bytes(self) -> bytes:
        """Everything that a score needs; of the same size whatever it learned from."""
        sink = io.BytesIO()
        rest = {"bias": float(self.bias), "scale": self.scale, "offset": self.offset, "threshold": self.threshold, "thresholds": self.thresholds}
        np.savez(sink, *self._weights(), rest=np.frombuffer(json.dumps(rest).encode(), np.uint8))
        return sink.getvalue()

    @staticmethod
    def settings(data: bytes) -> dict:
        """All but the weights."""
        return json.loads(np.load(io.BytesIO(data))["rest"].tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> TextCNN:
        model, found = cls(), np.load(io.BytesIO(data))
        for i, p in enumerate(model._weights()):
            p[...] = found[f"arr_{i}"]
        rest = cls.settings(data)
        model.bias = np.float32(rest.pop("bias"))
        for name, value in rest.items():
            setattr(model, name, value)
        return model

    def _begin(self, docs: list, labels: np.ndarray) -> None:
        """First column of both tables: how much oftener toxic texts have the row
        (log odds, shrunk); the first filter of each width starts out reading it."""
        n = np.bincount(labels, minlength=2)[:2]
        for table, k in ((self.first, 0), (self.second, 1)):
            seen = np.zeros((2, len(table)))
            for d, label in zip(docs, labels):
                seen[label, np.unique(d[k])] += 1
            odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
            odds[seen.sum(axis=0) < 2] = 0
            table[:, 0] = np.maximum(odds, 0) / 4
        for f in self.filters:
            f[:, 0] = 0
            f[::SIZE, 0] = 1
        self.out[::FILTERS] = 0.5

    def _logit(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(self.pooled(a, b, np.array([0, len(a)]))[0] @ self.out + self.bias)

    def _step(self, docs: list, labels: np.ndarray, sums: dict, rate: float) -> None:
        """One Adagrad step; the gradient of a pooled response flows to its one window."""
        a, b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        edges = np.concatenate(([0], np.cumsum([len(d[0]) for d in docs])))
        x, found = self.responses(a, b)
        pooled, place = np.zeros((len(docs), len(self.out)), "f4"), np.zeros((len(docs), len(self.out)), np.int64)
        for k, (w, y) in enumerate(zip(WIDTHS, found)):
            span = slice(k * FILTERS, (k + 1) * FILTERS)
            for d in range(len(docs)):
                part = y[edges[d] : edges[d + 1] - w + 1]
                if edges[d + 1] - edges[d] >= w:
                    place[d, span] = edges[d] + part.argmax(axis=0)
                    pooled[d, span] = np.maximum(part.max(axis=0), 0)
        z = np.clip(pooled @ self.out + self.bias, -30, 30)
        error = ((1 / (1 + np.exp(-z)) - labels) / len(docs)).astype("f4")
        back = error[:, None] * self.out * (pooled > 0)
        self._move(self.out, pooled.T @ error + 1e-5 * self.out, sums, rate)
        self.bias -= np.float32(rate) * error.sum()
        rows, grads = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g, at = back[:, k * FILTERS : (k + 1) * FILTERS], place[:, k * FILTERS : (k + 1) * FILTERS]
            windows = x[(at[:, :, None] + np.arange(w)) % max(1, len(x))].reshape(*at.shape, w * SIZE) if len(x) else np.zeros((*at.shape, w * SIZE), "f4")
            into = g[:, :, None] * f.T[None]
            live = g != 0
            for i in range(w):
                rows.append((at + i)[live])
                grads.append(into[:, :, i * SIZE : (i + 1) * SIZE][live])
            self._move(f, np.einsum("df,dfs->sf", g, windows) + 1e-5 * f, sums, rate)
            self._move(self.shift[k], g.sum(axis=0), sums, rate)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        for table, bucket in ((self.first, a), (self.second, b)):
            if len(rows):
                own, which = np.unique(bucket[rows], return_inverse=True)
                total = np.zeros((len(own), SIZE), "f4")
                np.add.at(total, which, grads)
                s = sums[id(table)]
                s[own] += total**2
                table[own] -= rate * total / np.sqrt(s[own])

    @staticmethod
    def _move(p: np.ndarray, g: np.ndarray, sums: dict, rate: float) -> None:
        s = sums[id(p)]
        s += g**2
        p -= rate * g / np.sqrt(s)

    def _calibrate(self, z: np.ndarray, labels: np.ndarray, langs: list) -> None:
        """Score: a logistic curve over the logit, fitted to softened labels.
        Threshold of a language: the middle of the gap at which its F1 is best."""
        n = np.bincount(labels, minlength=2)
        goal = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        centre = np.array([1.0, 0.0])
        x = np.stack((z, np.ones_like(z)), axis=1)
        theta = centre.copy()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (p - goal) + 1e-2 * (theta - centre)
            theta = theta - np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(2), gradient)
            if np.abs(gradient).max() < 1e-8:
                break
        if theta[0] > 0:
            self.scale, self.offset = float(theta[0]), float(theta[1])
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -40, 40)))
        self.threshold = best_threshold(p, labels)
        for lang in sorted({v for v in langs if v is not None}):
            own = np.array([v == lang for v in langs])
            if labels[own].sum() >= LEAST_TOXIC:
                self.thresholds[lang] = best_threshold(p[own], labels[own])


def best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """Where F1 is best; of equal ones the lowest, in the middle to the next score below."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + labels.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = len(f1) - 1 - int(np.argmax(f1[::-1])) if len(f1) else 0
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float((p[k] + below) / 2) if len(p) else THRESHOLD


@dataclass(frozen=True)
class StoredModel:
    """A model in a file of the shared folder, where the task that trained it put
    it and every task that scores reads it: its 17 MB never pass the driver, which
    would hold several copies to collect and to broadcast them."""

    path: str | None  # none: nothing was learned
    settings: dict

    def open(self) -> TextCNN:
        if self.path is None:
            return TextCNN()
        fs, at = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(at) as f:
            return TextCNN.from_bytes(f.read())


def train(docs: DataFrame, labels: DataFrame, usable, *args, **kwargs) -> bytes:
    """The model of ``train_stored`` itself (``TextCNN.to_bytes``)."""
    found = train_stored(docs, labels, usable, *args, **kwargs)
    data = found.open().to_bytes()
    if found.path is not None:
        remove(docs.sparkSession, found.path)
    return data


def train_stored(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> StoredModel:
    """The model from the first ``sample`` labelled rows by
    hash of their id, as far as their texts stay within ``sample_bytes``; one task
    trains it, and writes the weights to a file. Texts of more than a
    ``LONGEST_PART``-th of ``sample_bytes`` are passed over, those after them are not.
    ``usable`` is the condition on the key for learning from a row. Rows of null
    label are not used; a key with both labels counts as toxic. Repeated rows of
    a key count as one where their texts are equal."""
    known = labels.where(F.col(label).isNotNull() & usable(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"), F.xxhash64(text).alias("x"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    sizes = rows.select("k", "x", "size").join(F.broadcast(chosen), "k").distinct()  # ``sample`` pairs of numbers at most are broadcast
    sizes = sizes.where(F.col("size") <= sample_bytes // LONGEST_PART)
    first = sizes.withColumn("h", F.xxhash64("k")).orderBy("h", "k", "x").limit(sample)
    upto = F.sum("size").over(W.orderBy("h", "k", "x").rowsBetween(W.unboundedPreceding, 0))
    first = materialise(first.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("k", "x", "y"), "sample")
    texts = rows.join(F.broadcast(first), ["k", "x"]).groupBy("k", "x").agg(F.first("t").alias("t"), F.min("lang").alias("lang"), F.max("y").alias("y"))
    texts = texts.select(F.xxhash64("k").alias("h"), "x", "t", F.col("lang").cast("string").alias("lang"), F.col("y").cast("long").alias("y"))
    path = scratch_path(docs.sparkSession, "model")
    trained = materialise(texts.coalesce(1).mapInArrow(trimmed(lambda batches: _learned(batches, path)), "settings string"), "settings")
    found = trained.first()
    for table in (first, trained):
        discard(table)
    return StoredModel(path, json.loads(found.settings)) if found else StoredModel(None, TextCNN.settings(TextCNN().to_bytes()))


def _learned(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes what is learned from all rows (h, x, t, lang, y), in an order that does
    not depend on how they came, and gives the settings; nothing where there are none."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, sort_keys=[("h", "ascending"), ("x", "ascending")]))
        table = table.take(pa.array(np.random.default_rng(11).permutation(len(table))))
        texts = pa.chunked_array([c.cast(pa.large_string()) for c in table["t"].chunks], pa.large_string()).combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        y = table["y"].to_numpy().astype(np.int64).clip(0, 1)
        model = TextCNN().fit(texts, y, table["lang"].to_pylist())
        data = model.to_bytes()
        fs, at = pafs.FileSystem.from_uri(path)
        own = f"{at}.{uuid.uuid4().hex}"  # a task may run again, or twice at once
        with fs.open_output_stream(own) as f:
            f.write(data)
        fs.move(own, at)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(TextCNN.settings(data))])], ["settings"])


def classify(df: DataFrame, model: bytes | StoredModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``df`` and score (of the whole text alone), threshold (of
    the row's language, or of all) and toxic (score at least the threshold).

    A null text scores as an empty one: no filter responds. A null or unknown
    language has the threshold of all. Each row stands alone, so repeated rows
    and ties agree; an empty table gives an empty one. Input columns named like
    an output column are replaced.
    """
    df = df.drop("score")
    if isinstance(model, StoredModel):
        own, opened = model.settings, model.open
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)
        own, opened = TextCNN.settings(model), lambda: TextCNN.from_bytes(shared.value)
    limits, limit = own["thresholds"], own["threshold"]
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened()
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            scores = model.score(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    threshold = F.lit(limit)
    if lang in df.columns:
        for name, value in limits.items():
            threshold = F.when(F.col(lang) == name, value).otherwise(threshold)
    out = df.mapInArrow(trimmed(run), schema).withColumn("threshold", threshold)
    return out.withColumn("toxic", F.col("score") >= F.col("threshold"))


def corpus_model(spark, docs: DataFrame, sf_dir: str) -> StoredModel:
    return train_stored(docs, documents(spark, sf_dir, "labels"), lambda key: ~held_out(key, 4, 2))


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = classify(docs.select("doc_id", "text", "lang"), corpus_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")
