"""A causal self-attention model of subword ids, in numpy.

Frequent ids form the vocabulary, the others share one symbol. Symbols fall into
classes by the company they keep. One layer of attention looks back over a
window: its weights come from queries and keys of the symbols and from their
distance, its values change the scores that the latest symbol gives each class.
The probability of an id is that of its class in this context, times that of its
symbol in the class after the latest symbol, times its share of the symbol.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 32, 24
SYMBOLS, CLASSES = 4096, 64
KEY, VALUE = 8, 16
WINDOWS_AT_ONCE = 256
#: Rounds of training: in each, every part of the corpus starts from the same weights and the mean of all changes is taken.
#: A round meets every training text, so one is enough.
ROUNDS, RATE, BATCH = 1, 0.125, 256
WEIGHTS = ("query", "key", "value", "out", "distance", "start")
PER_SYMBOL = ("query", "key", "value", "start")
MASKED = np.float32(-1e9)


def window_starts(n: int) -> int:
    """How many windows score ``n`` ids."""
    return 1 + max(0, -(-(n - WINDOW) // STRIDE))


def windows(previous: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the inputs of every window of texts laid end to end, and which
    of them score: windows of a text overlap where they start ``stride`` apart, and each
    place scores in one. A place past the text's end repeats its last and scores nowhere."""
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    first = np.repeat(np.cumsum(lengths) - lengths, counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = number[:, None] * stride + np.arange(WINDOW)
    length = np.repeat(lengths, counts)[:, None]
    scores = (inside < length) & ((number[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - stride))
    return first[:, None] + np.minimum(inside, length - 1), scores


def _row_sums(x: np.ndarray) -> np.ndarray:
    """As a product: numpy's own sums over short rows take several times as long."""
    return x @ np.ones(x.shape[1], x.dtype)


def _alike(u: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct values of ``u``; and for each number of places that values have:
    the places, a row for each such value, and where these values stand among the distinct ones."""
    order = np.argsort(u.astype(np.uint16) if len(u) and u.max() < 1 << 16 else u, kind="stable")
    edges = np.flatnonzero(np.append(True, u[order][1:] != u[order][:-1]))
    sizes = np.diff(np.append(edges, len(u)))
    by_size = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(sizes[by_size]) > 0)).tolist()
    steps, groups = np.arange(len(u)), []
    for a, b in zip(cuts, [*cuts[1:], len(by_size)]):
        which = by_size[a:b]
        groups.append((order[edges[which][:, None] + steps[: sizes[which[0]]]], which))
    return u[order[edges]], groups


def _group_sums(g: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sums of the rows of ``g`` over equal values, as ``_alike`` gives them."""
    total = np.empty((n, g.shape[1]), g.dtype)
    for places, which in groups:
        rows = g.take(places, axis=0)
        total[which] = rows[:, 0] if places.shape[1] == 1 else np.add.reduce(rows, axis=1)
    return total


class AttentionLM:
    """Learns from texts given as arrays of ids that end in ``end_id``: first the
    tables, from counts of the whole corpus, then the weights, from texts that may
    lie in many places (``deltas`` there, ``moved`` with their sum)."""

    def __init__(self, n_ids: int, end_id: int, seed: int = 3):
        self.n_ids, self.end_id, self.seed = n_ids, end_id, seed

    def fit(self, texts: list[np.ndarray], counts: np.ndarray) -> AttentionLM:
        """From texts that are all there is."""

        def successors(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = symbol[np.concatenate(texts) if texts else np.zeros(0, np.int64)]
            return self._before(x, np.array([len(t) for t in texts], np.int64)), x, np.ones(len(x))

        self.tables(counts, successors)
        for step in range(ROUNDS):
            self.moved(self.deltas(texts, step))
        return self

    def tables(self, counts: np.ndarray, successors) -> AttentionLM:
        """``counts`` is how often each id stands in the whole training corpus.
        ``successors`` takes the symbols of all ids and gives how often one
        follows another in the corpus: arrays of the one before, the one after
        and the number."""
        kept = np.argsort(-counts, kind="stable")[: SYMBOLS - 1]
        kept = kept[counts[kept] > 0]
        if self.end_id not in kept:
            kept = np.append(kept[: SYMBOLS - 2], self.end_id)
        self.symbol = np.zeros(self.n_ids, np.int32)  # 0: all others
        self.symbol[kept] = np.arange(1, len(kept) + 1)
        n = len(kept) + 1
        others = np.where(self.symbol == 0, counts + 0.01, 0)
        share = np.ones(self.n_ids)
        share[self.symbol == 0] = (others / max(others.sum(), 1e-9))[self.symbol == 0]
        self.log_share = np.log10(np.maximum(share, 1e-300)).astype("f4")
        pairs = np.zeros((n, n), "f4")
        one, other, times = successors(self.symbol)
        np.add.at(pairs, (one, other), np.asarray(times, "f4"))
        self.of_class = self._classes(pairs)
        self.n_classes = int(self.of_class.max()) + 1
        self._tables(pairs, counts)
        rng = np.random.default_rng(self.seed)
        self.query, self.key = (rng.normal(0, 0.3, (n, KEY)).astype("f4") for _ in range(2))
        self.value = rng.normal(0, 0.3, (n, VALUE)).astype("f4")
        self.out = np.zeros((VALUE, self.n_classes), "f4")
        self.distance = np.zeros(WINDOW, "f4")
        return self

    def learner(self) -> AttentionLM:
        """What ``deltas`` needs: the model without the tables that only scoring reads."""
        small = AttentionLM(self.n_ids, self.end_id, self.seed)
        for name in ("symbol", "of_class", "n_classes", *WEIGHTS):
            setattr(small, name, getattr(self, name))
        return small

    def deltas(self, texts: list[np.ndarray], step: int) -> np.ndarray | None:
        """What training on these texts would change, as one row of numbers that
        adds up with those of other texts: changes times how often a symbol was
        met, and how often. The model stays as it is."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return None
        before = {name: getattr(self, name).copy() for name in WEIGHTS}
        x = self.symbol[np.concatenate(texts)]
        lengths = np.array([len(t) for t in texts], np.int64)
        n_windows, met = self._train(self._before(x, lengths), x, lengths, np.random.default_rng([self.seed, step]), RATE / (1 + step))
        parts = [np.array([n_windows], "f4"), met.astype("f4")]
        for name in WEIGHTS:
            change = getattr(self, name) - before[name]
            times = met[:, None] if name in PER_SYMBOL else n_windows
            parts.append((change * times).astype("f4").ravel())
            setattr(self, name, before[name])
        return np.concatenate(parts)

    def moved(self, total: np.ndarray | None) -> None:
        """Takes the mean of all changes, each symbol's by how often it was met."""
        if total is None:
            return
        n_windows, at = total[0], 1 + len(self.of_class)
        met = np.maximum(total[1:at], 1)[:, None]
        for name in WEIGHTS:
            p = getattr(self, name)
            change = total[at : at + p.size].reshape(p.shape)
            setattr(self, name, p + (change / (met if name in PER_SYMBOL else n_windows)).astype("f4"))
            at += p.size

    def _before(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The symbol before each one; a text begins after an end."""
        before = np.empty_like(x)
        before[1:] = x[:-1]
        ends = np.cumsum(lengths) - lengths
        before[ends[lengths > 0]] = self.symbol[self.end_id]
        return before

    def _classes(self, pairs: np.ndarray) -> np.ndarray:
        """Spherical k-means over the frequent neighbours on either side."""
        n, count = len(pairs), pairs.sum(axis=0)
        top = np.argsort(-count, kind="stable")[:256]
        around = np.concatenate((pairs.T[:, top], pairs[:, top]), axis=1)
        f = np.sqrt((around + 1e-3) / (around.sum(axis=1, keepdims=True) + 1))
        f /= np.linalg.norm(f, axis=1, keepdims=True)
        weight = np.sqrt(count + 1)
        rng = np.random.default_rng(self.seed)
        k = min(CLASSES, n)
        centre = f[rng.choice(n, k, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            label = (f @ centre.T).argmax(axis=1)
            centre = np.zeros_like(centre)
            np.add.at(centre, label, f * weight[:, None])
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
        return np.unique((f @ centre.T).argmax(axis=1), return_inverse=True)[1].astype(np.int32)

    def _tables(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        """Log probabilities of a symbol in its class after another, and of the
        classes after a symbol (where the training starts)."""
        n = len(pairs)
        total = np.bincount(self.symbol, weights=counts + 0.01, minlength=n)
        inside = total / np.bincount(self.of_class, weights=total, minlength=self.n_classes)[self.of_class]
        follow, kinds = np.zeros((n, self.n_classes), "f4"), np.zeros((n, self.n_classes), "f4")
        for c in range(self.n_classes):
            own = pairs[:, self.of_class == c]
            follow[:, c] = own.sum(axis=1)
            kinds[:, c] = 1 + (own > 0).sum(axis=1)  # the more kinds follow, the less their counts say (Witten and Bell)
        lower = kinds[:, self.of_class]
        pairs = (pairs + lower * inside.astype("f4")) / (follow[:, self.of_class] + lower)
        self.pair = np.log10(pairs).astype("f2")
        rate = follow.sum(axis=0) + 0.5
        rate /= rate.sum()
        seen = 1 + (follow > 0).sum(axis=1, keepdims=True).astype("f4")
        self.start = np.log((follow + seen * rate) / (follow.sum(axis=1, keepdims=True) + seen)).astype("f4")

    def _attend(self, x: np.ndarray) -> tuple:
        q, k, v = (np.take(p, x, axis=0) for p in (self.query, self.key, self.value))
        s = q @ k.transpose(0, 2, 1)
        s += self._bias()
        np.exp(np.minimum(s, 60, out=s), out=s)
        s *= (1 / _row_sums(s.reshape(-1, WINDOW))).reshape(*x.shape, 1)
        return q, k, v, s, s @ v

    def _bias(self) -> np.ndarray:
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
        return np.where(gap >= 0, self.distance[np.maximum(gap, 0)], MASKED).astype("f4")

    def _train(self, before: np.ndarray, x: np.ndarray, lengths: np.ndarray, rng, rate: float) -> tuple[int, np.ndarray]:
        """Adagrad on the class predictions of windows side by side, each place once;
        how many windows there were, and how often each symbol was met."""
        at, scores = windows(before, lengths, WINDOW)
        goal = self.of_class[x]
        sums = {name: np.full(getattr(self, name).shape, 1e-4, "f4") for name in WEIGHTS}
        gap = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0).ravel()
        met = np.zeros(len(self.of_class), np.int64)
        order = rng.permutation(len(at))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            place, live = at[rows].ravel(), scores[rows].ravel()
            u = before[place]
            weight = live * np.float32(32 / live.sum())
            q, k, v, a, c = self._attend(u.reshape(-1, WINDOW))
            flat = c.reshape(-1, VALUE)
            p = flat @ self.out
            p += np.take(self.start, u, axis=0)
            np.exp(np.minimum(p, 60, out=p), out=p)
            p *= (weight / _row_sums(p))[:, None]
            p[np.arange(len(u)), goal[place]] -= weight
            d = p @ self.out.T
            dc = d.reshape(c.shape)
            ds = dc @ v.transpose(0, 2, 1)
            ds -= np.einsum("ij,ij->i", d, flat).reshape(*ds.shape[:2], 1)  # as c is the mean of v by a
            ds *= a
            self._move("out", flat.T @ p, sums, rate)
            self._move("distance", np.bincount(gap, weights=ds.sum(axis=0).ravel(), minlength=WINDOW).astype("f4"), sums, rate)
            own, groups = _alike(u)
            for rows_of, at_own in groups:
                met[own[at_own]] += rows_of.shape[1]
            every = np.concatenate([g.reshape(len(u), -1) for g in (ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc, p)], axis=1)
            total, at_column = _group_sums(every, groups, len(own)), 0
            for name in PER_SYMBOL:
                width = getattr(self, name).shape[1]
                self._move(name, total[:, at_column : at_column + width], sums, rate, own)
                at_column += width
        return len(at), met

    def _move(self, name: str, g: np.ndarray, sums: dict, rate: float, rows=slice(None)) -> None:
        s, p = sums[name], getattr(self, name)
        s[rows] += g**2
        p[rows] -= rate * g / np.sqrt(s[rows])

    def log10_probability(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each of the texts laid end to end (each at least its end id)."""
        total = self.log10_of_ids(ids, lengths)
        return np.add.reduceat(total, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)

    def log10_of_ids(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each id, after those of its text before it."""
        x = self.symbol[ids]
        before = self._before(x, lengths)
        total = (self.pair[before, x] + self.log_share[ids]).astype("f8")
        at, scores = windows(before, lengths)
        goal = self.of_class[x]
        first = scores[:, 0]
        # All but a text's first window score their last places only: the others are looked back at, and look back at nothing.
        for some, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), WINDOW - STRIDE)):
            bias = self._bias()[skip:]
            for i in range(0, len(some), WINDOWS_AT_ONCE):
                place = at[some[i : i + WINDOWS_AT_ONCE]]
                u = before[place]
                live = np.flatnonzero(scores[some[i : i + WINDOWS_AT_ONCE], skip:])
                own = place[:, skip:].ravel()
                s = np.take(self.query, u[:, skip:], axis=0) @ np.take(self.key, u, axis=0).transpose(0, 2, 1)
                s += bias
                np.exp(np.minimum(s, 60, out=s), out=s)
                c = (s @ np.take(self.value, u, axis=0)).reshape(-1, VALUE)
                c *= (1 / _row_sums(s.reshape(-1, WINDOW)))[:, None]
                if len(live) < len(own):
                    own, c = own[live], c[live]
                z = c @ self.out
                z += np.take(self.start, before[own], axis=0)
                picked = z[np.arange(len(own)), goal[own]]
                np.exp(np.minimum(z, 60, out=z), out=z)
                total[own] += (picked - np.log(_row_sums(z))) / np.log(10)
        return total
