"""Masked pseudo-likelihood: every token predicted from both sides.

Network.  The most frequent words are classes of their own: ``LEAST`` at least, and so many that they grow with the cube
root of the vocabulary counted over all texts (:func:`own_words`); other words share a sixteenth as many rest classes by their last two bytes,
within which a word has its exact share of the corpus counts.  A window network (embeddings of the ``SIDE`` words to either side, by
place; a tanh layer; a softmax of two levels over the classes: cluster, then class in it) gives P(class | both sides).  It
is trained in numpy where the texts lie: each task starts from the same weights, whose biases are the classes'
frequencies, and goes once through its texts by Adagrad, with the window of every token; the tasks' weights are averaged
by their windows.  A task has at least ``SHARE`` bytes of text for each byte of weights, so averaging stays a fraction of
the input; weights travel in slices, and each slice is summed in one task as it comes.

Counts.  The exact counts of every word and of every pair of neighbours (:func:`pair_counts`) correct the network where
the corpus has seen more than its classes tell.  A token is predicted from all other tokens: its own occurrence is taken
off the counts.  From each side a word w beside x has (n(x, w) + ALPHA * b) / (n(x) + ALPHA), n without the token itself
and b the network's P(w | both sides).  P(w | both sides) is LEAD * b + (1 - LEAD) * the mean of the two sides, which sums
to 1 over all words; LEAD is above one half at every size of corpus, so the network leads.  A text's score is the sum of
log P over its tokens.  Texts that occur again are helped by their copies.  A text's end counts as a word, once a text.
:func:`held_out_likelihood` scores other texts by the counts of a corpus that they are not in; there a word never seen
counts as half a sighting in its class.

Words and pairs are known by 48 bits of a hash and the number of their part, parts holding about ``PART`` keys: a key
meets another with a probability of 1e-8, at any size.

What comes to the driver: the frequent words and one set of weights (65 numbers a class; 10^10 different words make
57,000 classes and 15 MB), and the class counts.  A task holds one set of weights with its gradients' squares, one
part's keys, or one piece of texts (``PIECE`` bytes, or one longer text) with its counts; a longer text's windows go
through the network ``CHUNK`` at a time.  The table is read twice in one order, as files are; a piece that differs the
second time raises an error.

Defined cases.  A text that is null or has no words has n_tokens 0, pll 0 and null pll_per_token.  A one-word text
is predicted from its two ends.  Repeated rows count as often as they come and are scored alike.  Very long texts are
scored whole.  An empty table gives no rows.  Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashes_of, keep, mix, pieces, release, word_bounds, word_hashes

_U = np.uint64
#: Words with a class of their own, at least and for each cube root of the vocabulary; words to either side.
LEAST, OWN, SIDE = 3840, 25.0, 2
WIDTH, HIDDEN, BATCH, CHUNK, RATE = 8, 32, 4096, 1 << 15, 0.05
#: Rows of a small product.
ROWS = 256
#: Keys of a part, bytes of a piece, and how many sightings of a neighbour the network's word is worth.
PART, PIECE, ALPHA = 2_000_000, 4_000_000, 2.0
#: The network's share of each prediction.
LEAD = 0.6
#: Bytes of text to a byte of weights in a training task, and numbers in a slice of weights.
SHARE, SLICE = 8, 1024
_END_WORD = _U(0x5851F42D4C957F2D)


def own_words(vocabulary: int) -> int:
    """How many words have a class of their own."""
    return max(LEAST, int(np.ceil(OWN * vocabulary ** (1 / 3))))


def _tails(texts: pa.Array) -> np.ndarray:
    """A hash of each word's last two bytes."""
    return _tails_of(*word_bounds(texts)[:3])


def _tails_of(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    last = starts + lengths - 1
    return mix(chars[last].astype(np.uint64) * _U(257) + np.where(lengths > 1, chars[last - 1], 0).astype(np.uint64) + _U(1))


@dataclass
class WindowNet:
    """P(class | the words to both sides), classes numbered cluster by cluster."""

    own: np.ndarray  # sorted hashes of words with a class of their own
    order: np.ndarray  # and their classes
    clusters: int
    members: int  # classes in a cluster
    rest: int  # classes that all other words share
    weights: list[np.ndarray]  # embeddings by place, hidden, its bias, clusters, their bias, members, their bias
    size: np.ndarray | None = None  # tokens by class

    def __post_init__(self) -> None:
        # One array holds the clusters' weights and, as a last row, their bias; another one the members', for one product a cluster.
        w = self.weights
        self.outer, self.inner = np.concatenate((w[3], w[4][None])), np.concatenate((w[5], w[6][:, None]), 1)
        self.weights = [*w[:3], self.outer[:-1], self.outer[-1], self.inner[:, :-1], self.inner[:, -1]]
        self._kept: dict[str, np.ndarray] = {}

    def _room(self, of: str, n: int, *shape: int) -> np.ndarray:
        """An array to fill, the same from batch to batch, as memory that is new each time costs as much as the sums."""
        got = self._kept.get(of)
        if got is None or len(got) < n or got.shape[1:] != shape:
            got = self._kept[of] = np.empty((n, *shape), np.float32)
        return got[:n]

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, tokens: int, seed: int = 1) -> WindowNet:
        """Untrained: ``words`` by falling ``counts``, the biases their frequencies among ``tokens``."""
        rest = 16 + len(words) // 16
        n = len(words) + rest
        members = int(np.ceil(np.sqrt(n)))
        clusters = -(-n // members)
        rng = np.random.default_rng(seed)
        freq = np.zeros(clusters * members)
        freq[: len(words)] = counts
        freq[len(words) : n] = max(float(tokens - counts.sum()), 1.0) / rest
        freq[:n] += 1e-6 * max(tokens, 1) / n
        with np.errstate(divide="ignore"):
            inner = np.maximum(np.log(freq.reshape(clusters, members)), -80.0)
        inner[freq.reshape(clusters, members) == 0] = -1e9  # numbers that no class has
        outer = np.log(freq.reshape(clusters, members).sum(1))
        # The last embedding is the text's end.
        w = [rng.normal(0, 0.3, (2 * SIDE, clusters * members + 1, WIDTH)), rng.normal(0, 0.2, (2 * SIDE * WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.05, (HIDDEN, clusters)), outer - outer.max(), rng.normal(0, 0.05, (clusters, HIDDEN, members)), inner - inner.max(1, keepdims=True)]
        by = np.argsort(words)
        return cls(words[by], by, clusters, members, rest, [x.astype(np.float32) for x in w])

    def classes(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        rest = len(self.own) + (tails % _U(self.rest)).astype(np.int64)
        if not len(self.own):
            return rest
        # From where the own words of its first bits begin, each word goes on past smaller ones, of which there are few.
        first, shift, most = self._starts()
        at = first.take(hashes >> shift)
        for _ in range(most):
            at += self.own.take(at, mode="clip") < hashes
        return np.where(self.own.take(at, mode="clip") == hashes, self.order.take(at, mode="clip"), rest)

    def _starts(self) -> tuple[np.ndarray, np.uint64, int]:
        """By their first bits: how many own words come before; how many bits are left; the most own words of the same ones."""
        bits = min(20, len(self.own).bit_length() + 4)
        shift = _U(64 - bits)
        first = np.searchsorted(self.own, np.arange(1 << bits, dtype=np.uint64) << shift)
        return first, shift, int(np.diff(first, append=len(self.own)).max())

    def windows(self, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(tokens, 2 * SIDE): the classes around each token, the end's beyond its text."""
        end = self.clusters * self.members
        out = np.full((len(cls), 2 * SIDE), end, np.int32)
        for j in range(1, min(SIDE, len(cls) - 1) + 1):
            same = row[j:] == row[:-j]
            out[j:, SIDE - j] = np.where(same, cls[:-j], end)
            out[:-j, SIDE + j - 1] = np.where(same, cls[j:], end)
        return out

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = around + np.arange(2 * SIDE) * self.weights[0].shape[1]
        x = self._room("x", len(around), 2 * SIDE, WIDTH)
        x = self.weights[0].reshape(-1, WIDTH).take(places, 0, x, "clip").reshape(-1, 2 * SIDE * WIDTH)
        h = _times(x, self.weights[1], self._room("h", len(x), HIDDEN))
        h += self.weights[2]
        return x, np.tanh(h, out=h)

    def _with_1(self, h: np.ndarray) -> np.ndarray:
        """``h`` with a last column of 1."""
        out = self._room("with_1", len(h), HIDDEN + 1)
        out[:, :-1], out[:, -1] = h, 1
        return out

    def _clusters(self, h: np.ndarray) -> np.ndarray:
        """Each cluster's logit (a column) in each window."""
        return _times(h, self.outer, self._room("clusters", len(h), self.clusters))

    def log_p(self, around: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.empty(len(cls))
        for at in range(0, len(cls), CHUNK):
            out[at : at + CHUNK] = self._log_p(around[at : at + CHUNK], cls[at : at + CHUNK])
        return out

    def _log_p(self, around: np.ndarray, cls: np.ndarray) -> np.ndarray:
        # By clusters, so that each one's rows lie together; BATCH rows at a time stay near the processor.
        clusters, low = cls // self.members, self.low()
        by = _order(clusters)
        out = np.empty(len(cls))
        for at in range(0, len(cls), BATCH):
            some = by[at : at + BATCH]
            group = clusters.take(some)
            place = cls.take(some) - group * self.members
            h = self._with_1(self.hidden(around.take(some, 0))[1])
            out[some] = _log_of(self._clusters(h), group, low) + _log_of(self._members(h, _groups(group)), place, low)
        return out

    def _members(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """The logits (columns) of the classes in each window's cluster; ``h`` with a last column of 1, windows by clusters."""
        z = self._room("members", len(h), self.members)
        for k, a, b in runs:
            (np.dot if b - a < 2 * ROWS else _times)(h[a:b], self.inner[k], z[a:b])
        return z

    def low(self) -> bool:
        """Whether no logit can be so large that its exponential needs a shift; the hidden layer's values are within 1."""
        outer, inner = np.abs(self.weights[3]).sum(0), np.abs(self.weights[5]).sum(1)
        most = max((outer + self.weights[4]).max(), (inner + self.weights[6]).max())
        least = min((self.weights[4] - outer).max(), (self.weights[6] - inner).max(1).min())
        return bool(most < 40 and least > -40)

    def learn(self, around: np.ndarray, cls: np.ndarray, seen: list[np.ndarray], low: bool | None = None) -> None:
        """One Adagrad step on the mean log-likelihood; ``seen``: the squares so far, ``low``: what :meth:`low` tells."""
        low = self.low() if low is None else low
        group = cls // self.members
        by = _order(group)
        around, group = around.take(by, 0), group.take(by)
        place = cls.take(by) - group * self.members
        x, h = self.hidden(around)
        w, n = self.weights, len(cls)
        with_1, runs = self._with_1(h), _groups(group)
        dz, d = _slope(self._clusters(with_1), group, low), _slope(self._members(with_1, runs), place, low)
        dh = _times(dz, w[3].T.copy(), self._room("dh", *h.shape))
        inner, back = self._room("inner", len(runs), *self.inner.shape[1:]), self._room("back", *h.shape)
        turned = self._room("turned", self.clusters, self.members, HIDDEN)
        np.copyto(turned, w[5].transpose(0, 2, 1))
        for i, (k, a, b) in enumerate(runs):
            some = d[a:b]
            if b - a < 2 * ROWS:
                np.dot(with_1[a:b].T, some, inner[i])
                np.dot(some, turned[k], back[a:b])
            else:
                _turned_times(with_1[a:b], some, inner[i])
                _times(some, turned[k], back[a:b])
        dh += back
        h *= h
        dh -= np.multiply(dh, h, out=h)
        dx = _times(dh, w[1].T.copy(), self._room("dx", *x.shape))
        # Embeddings and clusters that the batch doesn't have get no gradient, and stay as they are.
        met, number = _numbers((around + np.arange(2 * SIDE) * w[0].shape[1]).ravel(), 2 * SIDE * w[0].shape[1])
        g = np.empty((len(met), WIDTH), np.float32)
        for i, column in enumerate(dx.reshape(-1, WIDTH).T.astype(np.float64, order="C")):
            g[:, i] = np.bincount(number, column, len(met))
        _step(w[0].reshape(-1, WIDTH), seen[0].reshape(-1, WIDTH), g, met)
        outer = _turned_times(with_1, dz, np.empty_like(self.outer))
        for i, g in ((1, _turned_times(x, dh, np.empty_like(w[1]))), (2, np.ones(n, np.float32) @ dh), (3, outer[:-1]), (4, outer[-1])):
            _step(w[i], seen[i], g)
        some = None if len(runs) == self.clusters else np.array([k for k, *_ in runs])
        _step(w[5], seen[5], inner[:, :-1], some)
        _step(w[6], seen[6], inner[:, -1], some)


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a @ b``, ROWS rows at a time: OpenBLAS packs nothing for products so small, which halved their time here."""
    if len(a) < 2 * ROWS:
        return np.dot(a, b, out)
    n = len(a) // ROWS * ROWS
    np.matmul(a[:n].reshape(-1, ROWS, a.shape[1]), b, out=out[:n].reshape(-1, ROWS, out.shape[1]))
    if n < len(a):
        np.dot(a[n:], b, out[n:])
    return out


def _turned_times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a.T @ b`` likewise, the rows' sums added up."""
    if len(a) < 2 * ROWS:
        return np.dot(a.T, b, out)
    n = len(a) // ROWS * ROWS
    np.matmul(a[:n].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, ROWS, b.shape[1])).sum(0, out=out)
    if n < len(a):
        out += a[n:].T @ b[n:]
    return out


def _numbers(of: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, all below ``most``, and the place of each number among them."""
    there = np.zeros(most, bool)
    there[of] = True
    kinds = np.flatnonzero(there)
    place = np.empty(most, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place.take(of, mode="clip")


def _step(weight: np.ndarray, seen: np.ndarray, g: np.ndarray, some: np.ndarray | None = None) -> None:
    """Adagrad on the whole array, or on some of its rows."""
    step = g * g
    if some is None:
        seen += step
        np.sqrt(seen, out=step)
    else:
        step += seen.take(some, 0)
        _put(seen, some, step)
        np.sqrt(step, out=step)
    np.divide(g, step, out=step)
    step *= RATE
    if some is None:
        weight += step
    else:
        step += weight.take(some, 0)
        _put(weight, some, step)


def _put(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``to[at] = rows``; where it can, rows are copied whole, which is faster than number by number."""
    if to.flags.c_contiguous and to.ndim == 2:
        whole = np.dtype((np.void, to.shape[1] * to.itemsize))
        to.view(whole)[:, 0][at] = rows.view(whole)[:, 0]
    else:
        to[at] = rows


def _log_of(z: np.ndarray, at: np.ndarray, low: bool) -> np.ndarray:
    """Of each row's log-softmax the value at its place; ``low``: the exponentials need no shift."""
    if not low:
        z -= z.max(1, keepdims=True)
    own = z.reshape(-1).take(np.arange(len(at)) * z.shape[1] + at)
    return own - np.log(_sums(np.exp(z, out=z)))


def _sums(z: np.ndarray) -> np.ndarray:
    """The sum of each row; a product is faster than a sum of short rows."""
    return z @ np.ones(z.shape[1], z.dtype)


def _slope(z: np.ndarray, at: np.ndarray, low: bool) -> np.ndarray:
    """The gradient by z of the mean of :func:`_log_of`."""
    n = len(at)
    if not low:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (-1 / (n * _sums(z)))[:, None]
    z.reshape(-1)[np.arange(n) * z.shape[1] + at] += z.dtype.type(1 / n)
    return z


def _order(of: np.ndarray) -> np.ndarray:
    """An order that brings equal numbers together; short numbers are sorted faster."""
    return np.argsort(of.astype(np.uint16) if of.max(initial=0) < 1 << 16 else of, kind="stable")


def _begins(ordered: np.ndarray) -> np.ndarray:
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return np.flatnonzero(first)


def _groups(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one number: it, where its run begins and where it ends."""
    begins = _begins(ordered)
    return list(zip(ordered[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(ordered)], strict=True))


def _summed(rows: DataFrame, tasks: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of rows (slice, n, weights, size) the sum of n, the mean weights by n and the summed sizes; a task sums its slices as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, n, w, z in zip(*(batch.column(c) for c in ("slice", "n", "weights", "size")), strict=True):
                w, z = np.frombuffer(w.as_buffer(), np.float32), np.frombuffer(z.as_buffer(), np.int64)
                own = sums.setdefault(at.as_py(), [0, np.zeros(len(w)), np.zeros(len(z), np.int64)])
                own[0] += n.as_py()
                own[1] += w * float(n.as_py())
                own[2] += z
        for at, (n, w, z) in sums.items():
            mean = (w / max(n, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary())], ["slice", "n", "weights", "size"])

    got = sorted(rows.repartition(tasks, "slice").mapInArrow(run, _SLICES).collect(), key=lambda r: r["slice"])
    weights, size = (np.frombuffer(b"".join(r[c] for r in got), k) for c, k in (("weights", np.float32), ("size", np.int64)))
    return (got[0]["n"] if got else 0), weights, size


_SLICES = "slice int, n long, weights binary, size binary"


def train(texts: DataFrame, model: WindowNet, length: int = 0) -> WindowNet:
    """``model`` trained on ``texts`` (text, of ``length`` bytes in all), with the counts of its classes over all of them."""
    shapes = [x.shape for x in model.weights]
    total = sum(x.size for x in model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(model, weights=[x.copy() for x in model.weights])
        seen, n, steps, low = [np.full_like(x, 1e-8) for x in own.weights], 0, 0, False
        size = np.zeros(own.clusters * own.members, np.int64)
        for batch in batches:
            for _, part in pieces(batch.column("text")):
                bounds = word_bounds(part)
                row = bounds[3]
                cls = own.classes(hashes_of(*bounds[:3]), _tails_of(*bounds[:3]))
                size += np.bincount(cls, minlength=len(size))
                around = own.windows(cls, row)
                mixed = np.random.default_rng(len(cls)).permutation(len(cls))
                for at in range(0, len(cls), BATCH):
                    # A step moves no weight by more than RATE, so no logit by more than 1.65: within 40 they stay within 67.
                    if steps % 16 == 0:
                        low = own.low()
                    steps += 1
                    some = mixed[at : at + BATCH]
                    own.learn(around.take(some, 0), cls.take(some), seen, low)
                n += len(cls)
        flat = np.concatenate([x.ravel() for x in own.weights])
        # Slice i of the weights has slice i of the counts beside it, as long as there are any.
        for i in range(-(-len(flat) // SLICE)):
            of = slice(i * SLICE, (i + 1) * SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[of].tobytes()], pa.binary()), pa.array([size[of].tobytes()], pa.binary())], ["slice", "n", "weights", "size"])

    least = texts.sparkSession.sparkContext.defaultParallelism
    some = texts.coalesce(max(least, length // (SHARE * 4 * total)))
    n, flat, size = _summed(some.mapInArrow(run, _SLICES), min(2048, max(1, total // (SLICE * 64))))
    if not len(size):
        size = np.zeros(model.clusters * model.members, np.int64)
    if not n:
        return replace(model, size=size)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return replace(model, weights=[flat[e - int(np.prod(s)) : e].reshape(s).copy() for s, e in zip(shapes, ends, strict=True)], size=size)


@dataclass
class _Pairs:
    """The keys of one piece's words and pairs, and each token's place among them."""

    keys: np.ndarray  # words, the end once a text, the pair to each token's left, the pair of each last token and the end
    same: np.ndarray  # of each token but the first: whether it goes on with the text of the one before
    last: np.ndarray  # the last token of each text

    @classmethod
    def of(cls, h: np.ndarray, row: np.ndarray) -> _Pairs:
        same = row[1:] == row[:-1]
        last = np.flatnonzero(np.append(~same, True)) if len(h) else np.zeros(0, np.int64)
        word, end = mix(h), np.full(len(last), _END_WORD)
        ends = mix(end)
        left = np.empty_like(word)
        left[:1], left[1:] = ends[:1], np.where(same, word[:-1], mix(np.array([_END_WORD])))
        return cls(np.concatenate((word, ends, _pair(left, h), _pair(word[last], end))), same, last)

    def sides(self, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """From each key's count: of each token, its own, its neighbours' (left, right) and its pairs' (left, right)."""
        m = len(self.keys) - 2 * len(self.last) >> 1
        word, end, pair, closing = np.split(n, np.cumsum([m, len(self.last), m]))
        left, right, after = np.empty_like(word), np.empty_like(word), np.empty_like(word)
        left[:1], left[1:] = end[:1], np.where(self.same, word[:-1], end[0])
        right[:-1], after[:-1] = word[1:], pair[1:]
        right[self.last], after[self.last] = end, closing
        return word, left, right, pair, after


def _pair(mixed: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a word, given mixed, and the word ``b`` to its right."""
    with np.errstate(over="ignore"):
        return mix(mixed * _U(0x9E3779B97F4A7C15) + b)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Pieces of the task's texts, numbered alike in each reading."""
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        for start, part in pieces(batch.column("text"), PIECE):
            yield at, batch.column("doc_id").slice(start, len(part)), part
            at += 1


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them.

    Each key's first bits are sorted together with its place, as numbers are sorted several times as fast as places by
    numbers.  Where keys differ in later bits alone and came in another order, they are sorted the usual way."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    bits = _U(max(1, (len(keys) - 1).bit_length()))
    both = np.arange(len(keys), dtype=np.uint64)
    both |= keys >> bits << bits
    both.sort()
    both &= (_U(1) << bits) - _U(1)
    order = both.view(np.int64)
    ordered = keys.take(order)
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(keys, return_inverse=True)
    first = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def _mark(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(keys)).astype(np.int64)) if len(keys) else 0


def pair_counts(rows: DataFrame, bits: int, corpus: DataFrame | None = None) -> DataFrame:
    """(piece, part, mark, wide, counts): the counts of each piece's distinct keys in order, by 2 ** ``bits`` parts.

    The counts are those of ``rows`` themselves or, where it is given, of ``corpus`` alone."""

    alone = corpus is None

    def send(batches: Iterator[pa.RecordBatch], asks: bool = True, tells: bool = alone) -> Iterator[pa.RecordBatch]:
        for piece, _, texts in _numbered(batches):
            piece = piece if asks else -1
            keys, n = np.unique(_Pairs.of(*word_hashes(texts)).keys, return_counts=True)
            mark, part = _mark(keys), (keys >> _U(1)) >> _U(63 - bits)
            cut = np.flatnonzero(np.diff(part)) + 1
            begins = np.append(0, cut) if len(keys) else cut
            low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]
            out = [(int(part[i]), low[i:j].tobytes(), (n[i:j] * tells).astype(np.int32).tobytes()) for i, j in zip(begins, np.append(cut, len(keys)), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([piece] * len(out), pa.int64()), pa.array([mark] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["part", "piece", "mark", "keys", "n"])

    def add(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        low = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, 2:] = low
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int32)
        _, place = _kinds(keys.view(np.uint64)[:, 0])
        total = np.bincount(place, n).astype(np.int64)[place]
        ends = np.cumsum([len(b) // 6 for b in blobs])
        small = total.astype(np.uint32) if total.max(initial=0) < 1 << 32 else total
        out = pa.table({"piece": table.column("piece"), "part": table.column("part"), "mark": table.column("mark"), "wide": pa.array([small.itemsize] * len(blobs), pa.int32()), "counts": pa.array([small[j - len(b) // 6 : j].tobytes() for b, j in zip(blobs, ends, strict=True)], pa.binary())})
        return out if alone else out.filter(pc.greater_equal(out.column("piece"), 0))

    kinds = "part long, piece long, mark long, keys binary, n binary"
    sent = rows.mapInArrow(send, kinds)
    if corpus is not None:
        sent = sent.unionAll(corpus.mapInArrow(lambda batches: send(batches, False, True), kinds))
    return sent.groupBy("part").applyInArrow(add, "piece long, part long, mark long, wide int, counts binary")


def frequent_words(texts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of the most frequent words (:func:`own_words`), their exact counts, and the tokens of all texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column("text"), PIECE):
                words, n = np.unique(word_hashes(part)[0], return_counts=True)
                to = (words >> _U(1)) >> _U(63 - bits)
                cuts = np.append(np.append(0, np.flatnonzero(np.diff(to)) + 1), len(words)) if len(words) else np.zeros(1, int)
                some = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in some], pa.int64()), pa.array([words[a:b].tobytes() for a, b in some], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in some], pa.binary())], ["part", "words", "n"])

    def add(table: pa.Table) -> pa.Table:
        words, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("words", np.uint64), ("n", np.int64)))
        kinds, back = np.unique(words, return_inverse=True)
        total = np.bincount(back, n).astype(np.int64)
        # Parts are dealt by hash, so the vocabulary is about this part's as often as there are parts; four times that is enough.
        top = np.lexsort((kinds, -total))[: own_words(len(kinds) << (bits + 2))]
        # In a row of their own stand the part's words and what they have together.
        return pa.table({"word": pa.array(np.append(kinds[top].view(np.int64), len(kinds))), "n": pa.array(np.append(total[top], total.sum())), "sum": pa.array([False] * len(top) + [True])})

    found = keep(texts.mapInArrow(send, "part long, words binary, n binary").groupBy("part").applyInArrow(add, "word long, n long, sum boolean"), "words")
    tokens, vocabulary = (x or 0 for x in found.where("sum").agg(F.sum("n"), F.sum("word")).first())
    top = found.where("not sum").orderBy(F.desc("n"), "word").limit(own_words(vocabulary)).collect()
    release(found)
    return np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64), int(tokens)


def fit(docs: DataFrame) -> WindowNet:
    """The network of all texts of ``docs``."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words, counts, tokens = frequent_words(texts, max(0, int(np.ceil(np.log2(max(1, length / 32_000_000))))))
    return train(texts, WindowNet.of(words, counts, tokens), length)


def corpus_likelihood(docs: DataFrame, model: WindowNet) -> DataFrame:
    """doc_id, n_tokens, pll, pll_per_token of every document of the corpus that ``model`` is of."""
    return _scored(docs, model, None).drop("pll_counts")


def held_out_likelihood(docs: DataFrame, model: WindowNet, corpus: DataFrame) -> DataFrame:
    """The same of documents outside ``corpus``, which ``model`` is of; pll_counts: by the pair counts without the network."""
    return _scored(docs, model, corpus)


def _scored(docs: DataFrame, model: WindowNet, corpus: DataFrame | None) -> DataFrame:
    own = int(corpus is None)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    known = None if corpus is None else corpus.select(F.lit(None).cast("long").alias("doc_id"), text)
    all_tokens = int(model.size.sum())
    bits = max(0, int(np.ceil(np.log2(max(1, 2 * all_tokens / PART)))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, texts in _numbered(batches):
            one = pa.array([0, len(texts)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, texts.cast(pa.string()))], ["piece", "ids", "texts"])

    def score(packed: pa.Table, counted: pa.Table) -> pa.Table:
        ids, texts = (packed.column(c).combine_chunks().flatten() for c in ("ids", "texts"))
        bounds = word_bounds(texts)
        hashes, tails, row = hashes_of(*bounds[:3]), _tails_of(*bounds[:3]), bounds[3]
        del bounds
        at = _Pairs.of(hashes, row)
        keys, place = _kinds(at.keys)
        parts = sorted(zip(*(counted.column(c).to_pylist() for c in ("part", "mark", "wide", "counts")), strict=True))
        n = np.concatenate([np.frombuffer(c, np.uint32 if w == 4 else np.int64).astype(np.float64) for *_, w, c in parts] or [np.zeros(0)])
        if packed.num_rows != 1 or len(n) != len(keys) or {p[1] for p in parts} - {_mark(keys)}:
            raise RuntimeError("the documents came in another order when they were read again")
        tokens, pll, plain = np.zeros(len(texts), np.int64), np.zeros(len(texts)), None
        if len(n):
            word, left, right, before, after = at.sides(n[place])
            del keys, place, at
            cls = model.classes(hashes, tails)
            b = np.exp(model.log_p(model.windows(cls, row), cls))
            if own:
                b = np.where(cls < len(model.own), b, b * word / np.maximum(model.size[cls], 1))
            else:
                b = np.where(cls < len(model.own), b, b * np.maximum(word, 0.5) / (model.size[cls] + 0.5))

            def sides(b: np.ndarray) -> np.ndarray:
                return ((before - own + ALPHA * b) / (left - own + ALPHA) + (after - own + ALPHA * b) / (right - own + ALPHA)) / 2

            tokens = np.bincount(row, minlength=len(texts))
            pll = np.bincount(row, np.log(LEAD * b + (1 - LEAD) * sides(b)), len(texts))
            if not own:
                plain = np.bincount(row, np.log(sides(np.maximum(word, 0.5) / (all_tokens + 0.5))), len(texts))
        mean = pa.array(np.divide(pll, tokens, out=np.zeros(len(pll)), where=tokens > 0), mask=tokens == 0)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(tokens, pa.int64()), "pll": pa.array(pll), "pll_per_token": mean, "pll_counts": pa.array([None] * len(texts) if own else np.zeros(len(texts)) if plain is None else plain, pa.float64())})

    packed = rows.mapInArrow(pack, "piece long, ids array<long>, texts array<string>")
    return packed.groupBy("piece").cogroup(pair_counts(rows, bits, known).groupBy("piece")).applyInArrow(score, "doc_id long, n_tokens long, pll double, pll_per_token double, pll_counts double")
