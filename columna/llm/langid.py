"""Language identification by a linear-chain conditional random field over words.

The words of a text are a chain; each has features: the word itself (the lexicon), its first one to three and
last one to three bytes (affixes), and its n-grams of two and three bytes, hashed into ``buckets`` weights for
each language.  Transitions between the languages of neighbouring words are learned too.  Forward-backward
gives each word the probability of each language, so that a text may switch its language anywhere.

Training.  Per language at most about ``per_lang`` labelled texts are sampled (by seeded hash; texts over
``most_bytes`` bytes are left out of this sample only).  All languages are learned.  The driver holds at most ``most_sample`` bytes of them: beyond that fewer are drawn.  Each gives up to ``spans`` runs of 8 to 40 words, spread
over the whole text, and runs of all languages are shuffled into code-switched sequences whose words' languages
are known; on these the log-likelihood is maximised by Adagrad in numpy.

Prediction.  All words of a text count: the prediction is the language with the largest mean probability over the
words, which is the score; ties go to the smaller code.  Chains are cut into blocks of ``BLOCK`` words: a block's
transfer matrix carries the messages of forward-backward past it, so that blocks run side by side and a text of
any length takes few steps.  A text of over ``RUN`` bytes is also cut at blanks into parts of about that size, read
once for their transfer matrices and once for the marginals; a task holds the text and one part's features.

Defined cases.  A text that is null or has no letter is ``und`` with score 0, as is every text if nothing could
be learned.  Rows without doc_id are not held out and take no part in training.  Repeated rows are predicted
alike.  Very long texts are read whole, by parts.  An empty table gives no rows.  Prediction reads the text alone;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix, pieces, word_bounds, word_hashes

_U = np.uint64
#: Words of a block, blocks side by side, and bytes of text whose features are held at once.
BLOCK, SIDE, RUN = 512, 1024, 1_000_000
_BLANK = frozenset(b" \t\n\v\f\r")


def features(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of every word."""
    n = len(starts)
    number = np.arange(n)
    found, words = [hashes % _U(buckets)], [number]
    owner = np.repeat(number, lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(chars))  # bytes from here to the word's end
    at_start = np.zeros(len(chars), bool)
    at_start[starts] = True
    c = chars.astype(np.uint64) + _U(1)
    gram = c.copy()
    with np.errstate(over="ignore"):
        for g in (1, 2, 3):
            if g > 1:
                gram = gram[:-1] * _U(257) + c[g - 1 :]
            k = len(gram)
            whole = left[:k] >= g
            for kind, here in ((1, at_start[:k] & whole), (2, left[:k] == g), (3, whole if g > 1 else None)):
                if here is not None:
                    i = np.flatnonzero(here)
                    found.append(mix(gram[i] * _U(31) + _U(kind * 8 + g)) % _U(buckets))
                    words.append(owner[i])
    return np.concatenate(found).astype(np.int64), np.concatenate(words)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each word's row, its number among the distinct words, and the bytes, starts, lengths and hashes of those."""
    chars, starts, lengths, row = word_bounds(texts)
    hashes, _ = word_hashes(texts)
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    size = lengths[first]
    begun = np.cumsum(size) - size
    index = np.repeat(starts[first] - begun, size) + np.arange(int(size.sum()))
    return row, back, (chars[index] if len(index) else chars[:0], begun, size, kinds)


@dataclass
class Crf:
    """``weights``: buckets x languages; ``transitions`` and ``start``: log-potentials."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        chars, starts, lengths, hashes = words
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        bucket, word = features(chars, starts, lengths, hashes, len(self.weights))
        return np.stack([np.bincount(word, self.weights[bucket, k], len(starts)) for k in range(len(self.langs))], 1)

    def mean_marginals(self, texts: pa.Array) -> np.ndarray:
        """For each text the mean over its words of each language's probability."""
        return self.means(texts)[:, :-1]

    def means(self, texts: pa.Array) -> np.ndarray:
        """The same with one more column: the mean of each word's largest probability."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        if self.langs:
            for at, run in pieces(texts, RUN):
                if len(run) == 1 and (parts := _parts(run)):
                    out[at] = self._long(parts)
                else:
                    total, words, _ = self._run(run)
                    out[at : at + len(run)] = total / np.maximum(words, 1)[:, None]
        return out

    def _long(self, parts: list[pa.Array]) -> np.ndarray:
        """The mean of one text in parts."""
        k = len(self.langs)
        forward, passed = [None], []
        for part in parts:
            passed.append(self._run(part, forward[-1], whole=False)[2])
            forward.append(passed[-1][0])
        back, closing = np.ones(k), [np.ones(k)]
        for _, transfer in reversed(passed):
            back = transfer @ back
            back = back / back.sum()
            closing.append(back)
        closing.reverse()
        total, words = np.zeros(k + 1), 0
        for i, part in enumerate(parts):
            t, n, _ = self._run(part, forward[i], closing[i + 1])
            total, words = total + t[0], words + int(n[0])
        return total / max(words, 1)

    def _run(self, texts: pa.Array, opening: np.ndarray | None = None, closing: np.ndarray | None = None, whole: bool = True) -> tuple:
        """Sums of marginals and counts of words of each text; or, for one text, (message past it, transfer matrix).

        ``opening``: the message from before the (one) text, if it goes on with another; ``closing``: from behind it.
        """
        k = len(self.langs)
        row, word, kinds = distinct_words(texts)
        potential = self.emissions(kinds)
        potential = np.exp(potential - potential.max(1, keepdims=True)) if len(potential) else potential
        words = np.bincount(row, minlength=len(texts))
        begun = np.cumsum(words) - words
        count = -(-words // BLOCK)
        owner = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = begun[owner] + number * BLOCK
        size = np.minimum(BLOCK, words[owner] - number * BLOCK)
        ahead, behind = np.zeros((len(owner), k)), np.ones((len(owner), k))
        fresh = number == 0
        if opening is not None and len(owner):
            ahead[0], fresh = opening, np.zeros(len(owner), bool)
        if closing is not None and len(owner):
            behind[-1] = closing
        carry = np.exp(self.start) if opening is None else opening
        product = np.eye(k)
        several = np.flatnonzero((count[owner] > 1) | (not whole))
        if len(several):
            transfer = self._transfers(potential, word, start[several], size[several], fresh[several])
            for i, b in enumerate(several.tolist()):
                if fresh[b]:  # from the start on: every state begins as the start does
                    carry = np.exp(self.start) @ transfer[i]
                    carry = carry / carry.sum()
                    product = np.tile(carry, (k, 1))
                else:
                    if number[b]:
                        ahead[b] = carry
                    carry = carry @ transfer[i]
                    carry = carry / carry.sum()
                    product = product @ transfer[i]
                    product = product / product.sum()
            for i in range(len(several) - 1, 0, -1):
                b = several[i]
                if number[b]:
                    back = transfer[i] @ behind[b]
                    behind[b - 1] = back / back.sum()
        if not whole:
            return None, None, (carry if len(owner) else opening if opening is not None else None, product)
        marginal = np.zeros((len(owner), k + 1))
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), SIDE):
            some = order[at : at + SIDE]
            marginal[some] = self._chains(potential, word, start[some], size[some], ahead[some], behind[some], fresh[some])
        total = np.zeros((len(texts), k + 1))
        np.add.at(total, owner, marginal)
        return total, words, None

    def _transfers(self, potential: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """For each block the matrix that takes the message before it to the one at its end, but for its scale."""
        a, k = np.exp(self.transitions), len(self.langs)
        out = np.empty((len(start), k, k))
        order = np.argsort(-size, kind="stable")
        s, n = start[order], size[order]
        now = np.where(fresh[order][:, None, None], np.eye(k), a)  # no transition leads to a chain's first word
        for t in range(int(n[0])):
            live = int(np.searchsorted(-n, -t, "left"))
            step = (now[:live].reshape(-1, k) @ a).reshape(-1, k, k) if t else now
            step = step * potential[word[s[:live] + t]][:, None, :]
            now[:live] = step / step.sum((1, 2), keepdims=True)
        out[order] = now
        return out

    def _chains(self, potential: np.ndarray, word: np.ndarray, begun: np.ndarray, size: np.ndarray, ahead: np.ndarray, behind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Forward-backward over blocks of falling length: the sums of marginals and, last, of the largest ones."""
        a, k = np.exp(self.transitions), len(self.langs)
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # blocks longer than t
        offset = np.concatenate(([0], np.cumsum(live)))
        forward, seen = np.empty((int(offset[-1]), k)), np.empty((int(offset[-1]), k))
        now = np.where(fresh[:, None], np.exp(self.start), ahead @ a)
        for t in range(int(size[0])):
            n = live[t]
            e = potential[word[begun[:n] + t]]
            now = (now[:n] @ a if t else now) * e
            now /= now.sum(1, keepdims=True)
            forward[offset[t] : offset[t + 1]], seen[offset[t] : offset[t + 1]] = now, e
        total, back = np.zeros((len(size), k + 1)), behind.copy()
        at = a.T.copy()
        for t in range(int(size[0]) - 1, -1, -1):
            n = live[t]
            g = forward[offset[t] : offset[t + 1]] * back[:n]
            g /= g.sum(1, keepdims=True)
            total[:n, :k] += g
            total[:n, k] += g.max(1)
            if t:
                b = (seen[offset[t] : offset[t + 1]] * back[:n]) @ at
                back[:n] = b / b.sum(1, keepdims=True)
        return total


def _parts(text: pa.Array) -> list[pa.Array]:
    """The one text cut at blanks into parts of about ``RUN`` bytes; none if it is no longer than that."""
    whole = text[0].as_buffer() if text[0].is_valid else None
    if whole is None or whole.size <= RUN:
        return []
    data, out, at = memoryview(whole), [], 0
    while at < len(data):
        to = min(len(data), at + RUN)
        while to < len(data) and data[to] not in _BLANK:
            to += 1
        out.append(pa.array([bytes(data[at:to]).decode("utf-8", "surrogatepass")], pa.large_string()))
        at = to
    return out


def train(texts: list[str], labels: list[str], buckets: int = 1 << 17, spans: int = 40, length: int = 128, batch: int = 128, epochs: int = 3, rate: float = 0.4, decay: float = 1e-5, seed: int = 3) -> Crf:
    """A model of the languages among ``labels``."""
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    model = Crf(langs, np.zeros((buckets, k)), np.zeros((k, k)), np.zeros(k))
    row, word, kinds = distinct_words(pa.array(texts, pa.large_string()))
    if k < 2 or not len(row):
        return model
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    runs: list[list[np.ndarray]] = [[] for _ in langs]
    for i, lang in enumerate(labels):
        a, b = int(bounds[i]), int(bounds[i + 1])
        cuts = [a]
        while cuts[-1] < b:
            cuts.append(min(b, cuts[-1] + int(rng.integers(8, 41))))
        own = [word[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        pick = rng.permutation(len(own))[:spans]
        runs[langs.index(lang)].extend(own[j] for j in pick)
    most = max(map(len, runs))
    tokens, truth = [], []
    mixed = [(r, j) for j, own in enumerate(runs) if own for r in (own[i % len(own)] for i in range(min(most, 3 * len(own))))]
    for i in rng.permutation(len(mixed)):
        r, j = mixed[i]
        tokens.append(r)
        truth.append(np.full(len(r), j))
    tokens, truth = np.concatenate(tokens), np.concatenate(truth)
    n = len(tokens) // length
    if not n:
        length, n = len(tokens), 1
    tokens, truth = tokens[: n * length].reshape(n, length), truth[: n * length].reshape(n, length)
    chars, starts, size, hashes = kinds
    bucket, owner = features(chars, starts, size, hashes, buckets)
    by = np.argsort(owner, kind="stable")
    bucket, count = bucket[by], np.bincount(owner, minlength=len(starts))
    first = np.cumsum(count) - count
    g2 = [np.full_like(model.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(n), -(-n // batch)):
            w, y = tokens[some], truth[some]
            uniq, back = np.unique(w, return_inverse=True)
            own = count[uniq]
            feat = bucket[np.repeat(first[uniq] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
            holder = np.repeat(np.arange(len(uniq)), own)
            score = np.stack([np.bincount(holder, model.weights[feat, j], len(uniq)) for j in range(k)], 1)
            grad_e, grad_a, grad_s = _gradient(score[back.reshape(w.shape)], y, model)
            per_word = np.stack([np.bincount(back.ravel(), grad_e[..., j].ravel(), len(uniq)) for j in range(k)], 1)
            grad_w = np.stack([np.bincount(feat, per_word[holder, j], buckets) for j in range(k)], 1) / len(some)
            for p, g, h in ((model.weights, grad_w - decay * model.weights, g2[0]), (model.transitions, grad_a / len(some), g2[1]), (model.start, grad_s / len(some), g2[2])):
                h += g * g
                p += rate * g / np.sqrt(h)
    return model


def _gradient(score: np.ndarray, truth: np.ndarray, model: Crf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood: observed less expected counts, by forward-backward."""
    s, length, k = score.shape
    a = np.exp(model.transitions)
    e = np.exp(score - score.max(2, keepdims=True)).transpose(1, 0, 2)
    alpha, scale = np.empty_like(e), np.empty((length, s, 1))
    now = np.exp(model.start) * e[0]
    for t in range(length):
        if t:
            now = (now @ a) * e[t]
        scale[t] = now.sum(1, keepdims=True)
        now = now / scale[t]
        alpha[t] = now
    beta = np.ones((s, k))
    expected = np.empty_like(e)
    pairs = np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        expected[t] = alpha[t] * beta
        if t:
            right = e[t] * beta / scale[t]
            pairs += (alpha[t - 1].T @ right) * a
            beta = right @ a.T
    observed = np.eye(k)[truth]
    seen = np.bincount((truth[:, :-1] * k + truth[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    return observed - expected.transpose(1, 0, 2), seen - pairs, observed[:, 0].sum(0) - expected[0].sum(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 300, most_bytes: int = 200_000, most_sample: int = 200_000_000, seed: int = 3, **options) -> Crf:
    """A model from the labelled documents that aren't held out, of all their languages.

    The sample is bounded by ``per_lang`` texts (in the mean 1.2 times as many) a language and ``most_sample`` bytes in all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (F.octet_length("text") <= most_bytes))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").collect()
    if not seen:
        return train([], [])
    share = {r["lang"]: min(1.0, 1.2 * per_lang / r["n"]) for r in seen}
    fewer = min(1.0, most_sample / sum(share[r["lang"]] * r["bytes"] for r in seen))
    part = F.element_at(F.create_map(*[F.lit(x) for lang, p in sorted(share.items()) for x in (lang, p * fewer)]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    got = rows.where(drawn < part).orderBy("lang", "doc_id", "text").toPandas()
    return train(got["text"].tolist(), got["lang"].tolist(), seed=seed, **options)


def _guess(model: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language and its mean probability."""
    mean = model.mean_marginals(texts)
    if not mean.shape[1]:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts))
    return mean.argmax(1), np.minimum(mean.max(1), 1.0)


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    names = np.array([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = _guess(model, batch.column("text"))
            known = np.asarray(batch.column("letter")) & (len(model.langs) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_confident(docs: DataFrame, model: Crf, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, that have a letter and whose words are labelled surely.

    That is where the mean of each word's largest probability is ``least`` or more, so that a text may switch
    between any number of languages.  Only the text goes to Python, and one number a row comes back.  If nothing
    was learned, rows with a letter stay.
    """
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if not model.langs:
        return docs.where(letter)

    def sure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield pa.array(model.means(some)[:, -1])

    sure.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(letter & (F.arrow_udf(sure, "double")(F.col("text").cast("string")) >= least))
