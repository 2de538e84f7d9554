"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from columna.llm import langid, lm, mixing, ngram_join, packing, sharding
from columna.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
EXTRA = ("_s", "_h", "_cell", "rep", "block", "_u", "_q", "component", "letter", "_text", "node", "size", "target")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def prose(rng, n, lang="en"):
    stock = {"en": ["the", "and", "thing", "with", "ough", "when", "this", "ring"], "fr": ["le", "les", "eaux", "être", "mais", "où", "ment", "oi"]}[lang]
    return " ".join(rng.choice(stock) + rng.choice(["", rng.choice(stock)]) for _ in range(n))


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 3 == 0]
        rows.append([i, prose(rng, rng.randint(1, 150), lang), lang, ("a", "b", None, "é")[i % 4]])
    base = prose(rng, 300).split()
    for i in range(60, 90):  # near copies, each other by a word or two
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append([i, " ".join(w), "en", "a"])
    rows += [[90 + i, rows[5][1], "en", "b"] for i in range(5)]
    rows += [[100, None, "en", "a"], [101, "", "en", None], [102, " \t\n", None, "b"], [103, "12 34 !?", "en", "a"], [104, "One", "en", "a"], [105, "ONE", "fr", "a"], [106, prose(rng, 20_000), "en", "b"], [107, "a b c d e", None, "a"], [107, "a b c d e", None, "a"], [None, "the thing", "en", "a"], [108, "no\u00a0break\u2003here", "en", "a"], [-3, "minus the thing", "en", None]]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    return str(d)


def joined(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_word_hashes_are_the_words():
    import pyarrow as pa

    from columna.llm.shared import shingle_sets, word_hashes

    texts = ["Ab ab  AB\tab", None, "", "x" * 200 + " " + "x" * 199, "é É e\u00a0f", " lead", "trail "]
    h, row = word_hashes(pa.array(["pad", *texts])[1:])
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert row.tolist() == [i for i, _ in want]
    assert len(set(zip(h.tolist(), (w for _, w in want), strict=True))) == len({w for _, w in want}) == len(set(h.tolist()))
    assert [len(s) for s in shingle_sets(pa.array(["a b c", "a b", "", None, "a b a b a b"]), 3)] == [1, 1, 0, 0, 2]


@pytest.mark.parametrize(("n", "num", "chunk"), [(4, 85, 256), (5, 80, 4), (2, 50, 8)])
def test_join_finds_every_link(docs, rows, n, num, chunk):
    got = ngram_join.ngram_jaccard_join(docs, n, num, 100, chunk=chunk).collect()
    assert len(got) == len(rows)
    want = joined(rows, n, num, 100)
    for r in got:
        assert (r["component_id"] is None) if r["doc_id"] is None else (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_join_query_and_empty(spark, folder, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_ngram_join"](spark, folder).collect() if r["doc_id"] is not None}
    assert got == joined(rows, 4, 85, 100)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_join_keeps_texts_of_one_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(120)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "c " * 3), (4, "c " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(docs, 4, 85, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert sum(r["kept"] for r in got if r["doc_id"] == 1) == 2 and not any(r["kept"] for r in got if r["doc_id"] in (2, 3))


def test_join_makes_rows_by_pairs_not_by_shared_ngrams(spark, monkeypatch, tmp_path):
    """However many n-grams near copies share, and in however many batches, they are chained by an edge or two."""
    import uuid

    from columna.llm import shared

    stars, log = shared._stars, str(tmp_path)

    def spy(batches):
        for batch in stars(batches):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    monkeypatch.setattr(shared, "_stars", spy)
    pairs = 150
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(j, 300))) for i in range(pairs) for j in (0, 1)]
    docs, batch = spark.createDataFrame(rows, "doc_id long, text string"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(batch)
    spark.conf.set(batch, "500")
    try:
        got = ngram_join.ngram_jaccard_join(docs).collect()
    finally:
        spark.conf.set(batch, was)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, k - k % 2) for k in range(2 * pairs)}
    made = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 2 * pairs <= made <= 3 * pairs


def test_components_by_rounds(spark):
    import random

    from columna.llm.shared import Union, components

    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)] + [(1000, k) for k in range(1001, 1040)]
    groups = Union(2000)
    for x, y in edges:
        groups.join(x, y)
    want = {(i, groups.find(i)) for e in edges if e[0] != e[1] for i in e}
    for one_task in (0, 10**6):
        got = components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()
        assert {(r["node"], r["component"]) for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trie_prunes_nothing_it_needs():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = np.sort(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(60)]
    trie = ngram_join.Trie(sets)
    for num in (30, 50, 80):
        for p in sets:
            got = set(trie.links(p, num, 100, lambda i: False))
            assert got == {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= num * len(np.union1d(p, s))}


def test_language_id(spark, docs, rows, folder, empty):
    got = {(r["doc_id"], r["lang_pred"]): r for r in QUERIES["op2_language_id"](spark, folder).collect()}
    assert sum(1 for _ in got) >= len({r[0] for r in rows})
    right = total = 0
    for (i, lang), r in got.items():
        text = next(t for j, t, *_ in rows if j == i)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, r["score"]) == ("und", 0)
        else:
            assert lang in ("en", "fr") and 0 <= r["score"] <= 1
            if r["held_out"] and len(words(text)) > 20:
                total += 1
                right += lang == next(g for j, _, g, *_ in rows if j == i)
    assert total >= 5 and right / total > 0.9
    assert langid.keep_confident(docs, langid.Crf([], *[None] * 3)).count() == sum(bool(r[1]) and any(c.isalpha() for c in r[1]) for r in rows)
    model = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}


def test_marginals_follow_forward_backward():
    """Code-switched words get their own language; sums over all paths agree with enumeration."""
    import itertools

    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    texts = [prose(rng, 120, g) for g in ("en", "fr") * 10]
    model = langid.train(texts, ["en", "fr"] * 10, epochs=3)
    t = "the thing eaux le"
    _, back, kinds = langid.distinct_words(pa.array([t]))
    e = model.emissions(kinds)[back]
    weight = {}
    for path in itertools.product(range(2), repeat=4):
        weight[path] = np.exp(model.start[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path[:-1], path[1:], strict=True)))
    z = sum(weight.values())
    want = [sum(w * path.count(k) for path, w in weight.items()) / z / 4 for k in range(2)]
    got = model.mean_marginals(pa.array([t, "", t + " " + t]))
    assert got[0].tolist() == pytest.approx(want) and got[1].tolist() == [0, 0]
    assert model.mean_marginals(pa.array([prose(rng, 30, "fr")]))[0, 1] > 0.9


def test_language_of_long_texts_by_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = langid.Crf(["a", "b", "c"], rng.normal(0, 1, (1 << 12, 3)), rng.normal(0, 0.5, (3, 3)), rng.normal(0, 1, 3))
    texts = pa.array([*(" ".join(rng.choice(["ab", "cdé", "fg h", "xyz", "q"], n)) for n in (3, 700, 1, 2000, 40, 513, 512)), None, ""])
    monkeypatch.setattr(langid, "BLOCK", 10**6)
    want = model.means(texts)
    for block, run in ((64, 1500), (7, 200), (512, 10**6)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "RUN", run)
        assert np.allclose(model.means(texts), want, atol=1e-12)
    long = pa.array([" ".join(f"w{i % 5000}" for i in range(2_000_000))])
    monkeypatch.setattr(langid, "RUN", 10**6)
    assert model.mean_marginals(long).sum() == pytest.approx(1)


def test_shards(docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for k in n:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n[k]))
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode())) and r["law"] == "rows" and r["grown_shard"] is None
    for s, c in Counter(r[3] for r in rows).items():  # the mixture
        each = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(abs(each[k] - c / 8) <= 1.5 for k in range(8))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(7)).collect() if r["doc_id"] != 107} == {(r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] != 107}
    assert sharding.shard_documents(empty).count() == 0


def levels(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = levels(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix_sources(empty).count() == 0


def test_pareto_prefers_wanted_rows(spark):
    df = spark.range(2000).select("id", F.lit("s").alias("src"), F.lit(1).cast("long").alias("n"), F.lit(500.0).alias("t"))
    p = F.when(F.col("id") < 1000, 0.4).otherwise(0.1)
    got = mixing.pareto_sample(df, "src", "n", "t", p, ["id"]).where("copies > 0")
    assert got.count() == 500 and abs(got.where("id < 1000").count() - 400) < 40
    sure = mixing.pareto_sample(df, "src", "n", "t", F.when(F.col("id") < 100, 2.5).otherwise(0.1), ["id"])
    assert sure.where("id < 100 and copies < 2").count() == 0


def softmaxes(model, around):
    """P(class | window) for every class, in plain numpy."""
    import numpy as np

    w = [x.astype(float) for x in model.weights]
    h = np.tanh(np.concatenate([w[0][j][c] for j, c in enumerate(around)]) @ w[1] + w[2])
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return np.concatenate([p * soft(h @ w[5][k] + w[6][k]) for k, p in enumerate(soft(h @ w[3] + w[4]))])


@pytest.mark.parametrize("part", [2_000_000, 500])
def test_likelihood_against_plain_counts(spark, rows, folder, empty, monkeypatch, part):
    """The query against a count of all words and pairs in plain Python, in one part and in many; P sums to 1."""
    import numpy as np
    import pyarrow as pa

    from columna.llm.shared import word_hashes

    monkeypatch.setattr(lm, "PART", part)
    monkeypatch.setattr(lm, "own_words", lambda vocabulary: 100)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = lm.fit(docs)
    seen: Counter = Counter()
    vocabulary: Counter = Counter()
    for _, t, *_ in rows:
        w = ["", *words(t), ""]
        if len(w) > 2:
            vocabulary.update(w[1:-1])
            seen.update(w[:-1])
            seen.update(zip(w[:-1], w[1:], strict=True))
    names = sorted(vocabulary)
    text = pa.array([" ".join(names)])
    of = dict(zip(names, model.classes(word_hashes(text)[0], lm._tails(text)).tolist(), strict=True))
    top = sorted(vocabulary.values())[-100:]
    assert len(model.own) == 100 and sum(vocabulary[x] for x in names if of[x] < 100) == sum(top)
    assert all(sum(vocabulary[x] for x in names if of[x] == c) == model.size[c] for c in set(of.values()))
    end = model.clusters * model.members

    def chance(w, i, x):
        """P(x) in the place of w[i], from all other tokens."""
        around = [of[w[j]] if 0 < j < len(w) - 1 else end for j in (i - 2, i - 1, i + 1, i + 2)]
        b = softmaxes(model, around)[of[x]] * (1 if of[x] < 100 else vocabulary[x] / model.size[of[x]])
        less = x == w[i]
        counts = ((seen[w[i - 1], x] - less + lm.ALPHA * b) / (seen[w[i - 1]] - 1 + lm.ALPHA) + (seen[x, w[i + 1]] - less + lm.ALPHA * b) / (seen[w[i + 1]] - 1 + lm.ALPHA)) / 2
        return lm.LEAD * b + (1 - lm.LEAD) * counts

    got = QUERIES["op8_pseudo_likelihood"](spark, folder).collect() if part > 500 else lm.corpus_likelihood(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
    for r in got:
        t = next(t for i, t, *_ in rows if i == r["doc_id"])
        w = ["", *words(t), ""]
        assert r["n_tokens"] == len(w) - 2
        if len(w) == 2:
            assert (r["pll"], r["pll_per_token"]) == (0, None)
        elif len(w) < 200:
            want = sum(np.log(chance(w, i, w[i])) for i in range(1, len(w) - 1))
            assert r["pll"] == pytest.approx(want, rel=1e-3) and r["pll_per_token"] == pytest.approx(want / (len(w) - 2), rel=1e-3)
    w = ["", *words(rows[3][1]), ""]
    for i in (1, len(w) // 2, len(w) - 2):
        assert sum(chance(w, i, x) for x in names) == pytest.approx(1, abs=0.2 if i in (1, len(w) - 2) else 0.02)
    assert lm.corpus_likelihood(empty, lm.fit(empty)).count() == 0


def test_classes_grow_with_the_vocabulary(spark, monkeypatch):
    """Every word that the rule gives a class of its own has one, in one part and in many."""
    assert lm.own_words(1000) == lm.LEAST < lm.own_words(10**8) < lm.own_words(10**10)
    monkeypatch.setattr(lm, "LEAST", 64)
    rng = random.Random(1)
    texts = [" ".join(f"v{int(rng.paretovariate(0.6))}" for _ in range(300)) for _ in range(100)]
    seen = Counter(w for t in texts for w in t.split())
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    own = lm.own_words(len(seen))
    assert 64 < own < len(seen) and lm.own_words(8 * len(seen)) == pytest.approx(2 * own, abs=1)
    for bits in (0, 3):
        words, counts, tokens = lm.frequent_words(docs, bits)
        assert tokens == sum(seen.values()) and len(words) == own
        assert counts.tolist() == sorted(seen.values(), reverse=True)[:own]


def test_network_leads_on_held_out_texts(spark):
    """Words that follow from both neighbours together: the mixture beats the pair counts alone on texts it has not seen."""
    assert lm.LEAD > 0.5
    rng = random.Random(5)

    def text(n):
        w = [rng.randrange(12)]
        while len(w) < n:
            far = rng.randrange(12)
            w += [(w[-1] * 5 + far) % 12 if rng.random() < 0.9 else rng.randrange(12), far]
        return " ".join(f"w{x}" for x in w)

    docs = spark.createDataFrame([(i, text(200)) for i in range(600)], "doc_id long, text string")
    new = spark.createDataFrame([(9, "never seen w1 w2"), (10, None), *((i, text(200)) for i in range(11, 40))], "doc_id long, text string")
    model = lm.fit(docs)
    got = {r["doc_id"]: r for r in lm.held_out_likelihood(new, model, docs).collect()}
    assert sorted(got) == [*range(9, 40)] and (got[10]["pll"], got[10]["pll_counts"]) == (0, 0)
    assert all(math.isfinite(r["pll"]) and math.isfinite(r["pll_counts"]) for r in got.values())
    assert sum(r["pll"] for r in got.values()) > sum(r["pll_counts"] for r in got.values())
    # A text that the counts hold is not held out: there its own tokens are taken off.
    assert "pll_counts" not in lm.corpus_likelihood(docs, model).columns


def test_large_logits_are_shifted():
    """Weights whose exponentials would overflow, or vanish, give the same as plain numpy in doubles."""
    import numpy as np

    net = lm.WindowNet.of(np.arange(40, dtype=np.uint64) << np.uint64(40), np.full(40, 5), 400)
    around, cls = np.zeros((40, 4), np.int64), np.arange(40)
    assert net.low()
    for shift in (0.0, 500.0, -500.0):
        net.weights[4] += np.float32(shift)
        assert net.low() == (shift == 0)
        assert net.log_p(around, cls) == pytest.approx(np.log(softmaxes(net, around[0])[:40]), rel=1e-3)
        net.weights[4] -= np.float32(shift)


def test_weights_are_averaged_by_windows(spark):
    import numpy as np

    rows = [(s, n, np.full(4, v, np.float32).tobytes(), np.full(2, n, np.int64).tobytes()) for s in range(5) for n, v in ((1, 8.0 + s), (3, 4.0 + s), (0, 99.0))]
    n, weights, size = lm._summed(spark.createDataFrame(rows, lm._SLICES).repartition(4), 3)
    assert n == 4 and weights.tolist() == [5.0 + s for s in range(5) for _ in range(4)] and size.tolist() == [4] * 10


def test_likelihood_tells_copies_and_rare_words(spark, tmp_path):
    rng = random.Random(3)
    stock = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(stock) for _ in range(60)) for _ in range(80)]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[:5])), (200, "zzq kkv wwx qqj")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["pll_per_token"] for r in QUERIES["op8_pseudo_likelihood"](spark, str(tmp_path)).collect()}
    twice = [got[i] for i in (*range(5), *range(100, 105))]
    once = [got[i] for i in range(5, 80)]
    assert min(twice) > max(once) and got[200] < min(once)


def test_network_learns_both_sides():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (20_000, 3))
    x[:, 1] = np.where(rng.random(len(x)) < 0.8, (x[:, 0] + x[:, 2]) % 6, x[:, 1])
    model = lm.WindowNet.of(np.arange(6, dtype=np.uint64) << np.uint64(40), np.bincount(x[:, 1], minlength=6), 20_000)
    around = np.full((len(x), 4), model.clusters * model.members)
    around[:, 1], around[:, 2] = x[:, 0], x[:, 2]
    before = model.log_p(around, x[:, 1]).mean()
    seen = [np.full_like(w, 1e-8) for w in model.weights]
    for _ in range(40):
        for at in range(0, len(x), 2000):
            model.learn(around[at : at + 2000], x[at : at + 2000, 1], seen)
    assert model.log_p(around, x[:, 1]).mean() > before + 0.4
    p = [np.exp(model.log_p(around[:1], np.array([c]))[0]) for c in range(model.clusters * model.members)]
    assert sum(p) == pytest.approx(1, abs=1e-4)


def test_network_is_trained_on_every_window(spark, rows, docs, monkeypatch):
    """Each token of every text counts once, and texts shorter than eight words teach the network too."""
    import numpy as np
    import pyarrow as pa

    from columna.llm.shared import word_hashes

    windows, summed = [], lm._summed

    def spy(*args):
        got = summed(*args)
        windows.append(got[0])
        return got

    monkeypatch.setattr(lm, "_summed", spy)
    lm.fit(docs)
    assert windows == [sum(len(words(t)) for _, t, *_ in rows)]
    short = ["a b c", "d e f"] * 300
    model = lm.fit(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"))
    assert windows[1] == 3 * len(short)
    hashes, row = word_hashes(pa.array(short[:2]))
    fresh = lm.WindowNet.of(model.own[np.argsort(model.order)], np.full(6, 300), 3 * len(short))
    cls = model.classes(hashes, hashes)
    before, after = (net.log_p(net.windows(cls, row), cls) for net in (fresh, model))
    assert (after > before + 0.1).all()


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, (64, 256, 1024)).collect()
    binned = [r for r in got if r["bin_id"] is not None]
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["length"]
    want = Counter()
    for r in rows:
        want[r[0]] += len(words(r[1]))
    assert +per == +want and set(per) == set(want)
    bins: dict = {}
    for r in binned:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["length"]
        cap = {r["bin_capacity"] for r in own}
        assert cap == {min(c for c in (64, 256, 1024) if c >= at)}
    total = sum(r["length"] for r in binned)
    assert total / sum(own[0]["bin_capacity"] for own in bins.values()) > 0.9
    assert packing.pack_documents(empty).count() == 0


def plain_best_fit(pieces, caps, start_cost=16.0):
    """The same rule by looking at every open bin and every capacity: (bin of each piece, capacity of each bin)."""
    caps = sorted(caps)
    left, bins, rooms, held = sum(pieces), [], [], []
    for s in pieces:  # longest first
        left -= s
        fits = [(room, b) for b, room in enumerate(rooms) if room >= s]
        if fits:
            b = min(fits)[1]
        else:
            def cost(c, s=s):
                free = c - s
                fill = min(left, free * free / (free + s / 2)) if free else 0
                return (c + start_cost) / (s + fill)

            b = len(rooms)
            rooms.append(min((c for c in caps if c >= s), key=lambda c: (cost(c), c)))
            held.append(0)
        rooms[b] -= s
        held[b] += s
        bins.append(b)
    return bins, [min(c for c in caps if c >= h) for h in held]


def test_packing_query_against_plain_best_fit(spark, folder, rows):
    caps = packing.CAPACITIES
    made = []
    for i, t, *_ in rows:
        n = len(words(t))
        made += [(-min(2048, n - at), i is not None, i or 0, zlib.crc32(t.encode()), k, i) for k, at in enumerate(range(0, n, 2048))]
    made.sort()
    bins, sizes = plain_best_fit([-x[0] for x in made], caps)
    want = Counter((x[5], x[4], -x[0], b, sizes[b]) for x, b in zip(made, bins, strict=True))
    got = QUERIES["op10_best_fit"](spark, folder).where("bin_id is not null").collect()
    alike = lambda c: Counter((i, k, n, size) for (i, k, n, _, size), m in c.items() for _ in range(m))
    mine = Counter((r["doc_id"], r["piece"], r["length"], r["bin_id"], r["bin_capacity"]) for r in got)
    assert alike(mine) == alike(want)
    assert mine == want  # one group, so bins have the same numbers


def test_packed_sequences_hold_every_word(docs, rows, empty):
    got = packing.packed_sequences(docs).collect()
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, []).append(WORD.findall(t or ""))
    per: dict = {}
    for r in got:
        w = r["text"].split(" ")
        assert len(w) == r["length"] == r["ends"][-1] <= r["bin_capacity"]
        at = 0
        for i, end in zip(r["doc_ids"], r["ends"], strict=True):
            per.setdefault(i, []).append(w[at:end])
            at = end
    for i, texts in text.items():
        assert sorted(x for p in per.get(i, []) for x in p) == sorted(x for t in texts for x in t)
        if len(texts) == 1 and texts[0]:
            assert sorted(per[i]) == sorted(texts[0][k : k + 2048] for k in range(0, len(texts[0]), 2048))
    assert packing.packed_sequences(empty).count() == 0


def test_packed_sequences_of_equal_pieces(spark, monkeypatch):
    """Copies in many groups of bins, and other texts under their doc_id and checksum."""
    monkeypatch.setattr(packing.F, "crc32", lambda c: F.lit(7).cast("long"))
    texts = [(1, "a b c")] * 90 + [(1, "d e f")] * 31 + [(1, "x y")] * 15 + [(None, "g h")] * 40 + [(2, "i"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.packed_sequences(docs, capacities=(4, 8), group_pieces=20).collect()
    found = Counter()
    for r in got:
        w, at = r["text"].split(" "), 0
        for i, end in zip(r["doc_ids"], r["ends"], strict=True):
            found[i, " ".join(w[at:end])] += 1
            at = end
        assert at == len(w) == r["length"] <= r["bin_capacity"]
    assert found == Counter(x for x in texts if x[1])
    assert len({r["bin_id"] >> 32 for r in got}) > 3


def test_best_fit_is_tight():
    bins, caps = packing.best_fit([5, 5, 3, 3, 2, 2], (5, 10), 0.0)
    assert sum(caps) == 20 and len(bins) == 6
    assert packing.best_fit([], (5,)) == ([], [])
    bins, caps = packing.best_fit([7, 3], (10, 4), 0.0)
    assert caps == [10]
    bins, caps = packing.best_fit([4], (10, 4), 0.0)
    assert caps == [4]


def test_pipeline(spark, docs, rows, folder):
    import corpus_pipeline as p

    assert len(p.STAGES) == 4 and p.ORACLE_SQL is None
    clashing = ("_letter", "_text", "copies", "id", "rows", "text_md5", "_id", "_mark", "mark", "kept", "_row", "_copies", "_mix_id", "_MIX_copies", "_rest", "_gone", "size", "target")
    plain = docs.select("*", *[F.lit(c).alias(c) for c in clashing if c not in docs.columns])
    one = p.STAGES[0][1](spark, plain, folder)
    kept = one.collect()
    assert one.columns == plain.columns and not {r["doc_id"] for r in kept} & {100, 101, 102, 103} and len(kept) >= len(rows) - 8
    two = p.STAGES[1][1](spark, plain, folder).collect()
    ids = Counter(r["doc_id"] for r in two)
    want = joined(rows, 5, 80, 100)
    assert {i for i in ids if i is not None} == {i for i, (_, c) in want.items() if i == c} and max(ids.values()) == 1 and ids[None] == 1
    three = p.STAGES[2][1](spark, plain, folder)
    assert three.columns == plain.columns
    copies = Counter(r["doc_id"] for r in three.collect())
    taken = Counter()
    for r in mixing.mix_sources(plain).collect():
        taken[r["doc_id"]] += r["copies"]
    assert copies == +taken
    out = p.run(spark, folder)
    assert out.where("length > 0").count() > 0


def test_pipeline_stages_with_odd_columns_on_repeated_rows(spark, docs, folder):
    import corpus_pipeline as p

    odd = docs.select("*", F.lit("x").alias("meta.url"), F.create_map(F.lit("k"), F.col("lang")).alias("tags"), F.lit(1).alias("back`tick"))
    odd = odd.unionAll(odd.where("doc_id % 3 = 0"))
    for _, stage in p.STAGES[:3]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns and got.count() > 0 and {r["meta.url"] for r in got.select("`meta.url`").collect()} == {"x"}


def test_kinds_are_those_of_numpy():
    """Few and many keys, repeats, and keys that differ in their last bits alone."""
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 5000):
        for keys in (rng.integers(0, 3, n), rng.integers(0, 1 << 62, n), rng.integers(0, 1 << 20, n) << 40):
            keys = np.concatenate((keys, keys[: n // 2], keys[: n // 3] + 1)).astype(np.uint64)
            for got, want in zip(lm._kinds(keys), np.unique(keys, return_inverse=True), strict=True):
                assert np.array_equal(got, want)


def test_words_are_found_and_hashed_alike_in_any_place():
    """A word has one hash, whatever stands around it, up to and beyond 64 bytes; texts end words; slices and nulls count."""
    import pyarrow as pa

    from columna.llm.shared import word_bounds, word_hashes

    words = ["a", "Zoë", "@[`{", "\x1f", "x" * 63, "x" * 64, "x" * 65, "y" * 200]
    texts = pa.array(["skipped", *words, " \t\x0b".join(words), None, "", *words[::-1]]).slice(1)
    hashes, row = word_hashes(texts)
    assert row.tolist() == [*range(8), *[8] * 8, *range(11, 19)]
    assert hashes[:8].tolist() == hashes[8:16].tolist() == hashes[:15:-1].tolist() and len(set(hashes.tolist())) == 8
    for lower in (True, False):
        chars, starts, lengths, _ = word_bounds(texts, lower)
        got = [chars[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)]
        assert got[:8] == [w.encode().lower() if lower else w.encode() for w in words]


def test_step_is_adagrad_on_the_plain_gradient():
    """A step of few and of many windows, with clusters and embeddings that it has none of, against plain numpy in doubles."""
    import numpy as np

    rng = np.random.default_rng(0)
    freq = np.sort(rng.integers(5, 5000, 90))[::-1]
    for n in (1, 7, lm.ROWS, 2 * lm.ROWS - 1, 2 * lm.ROWS, 5 * lm.ROWS + 3):
        net = lm.WindowNet.of(np.arange(90, dtype=np.uint64) << np.uint64(40), freq, int(freq.sum()) + 50)
        around = rng.integers(0, 40, (n, 4))
        cls = np.where(rng.random(n) < 0.8, rng.integers(0, 5, n), rng.integers(0, 60, n))
        w, m = [x.astype(float) for x in net.weights], net.members
        seen = [np.full_like(x, 1e-8) for x in net.weights]
        net.learn(around, cls, seen)
        g = [np.zeros_like(x) for x in w]
        for a, c in zip(around, cls, strict=True):
            x = np.concatenate([w[0][i, e] for i, e in enumerate(a)])
            h, k = np.tanh(x @ w[1] + w[2]), c // m
            dz, d = (np.eye(len(z))[at] - np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z, at in ((h @ w[3] + w[4], k), (h @ w[5][k] + w[6][k], c % m)))
            dh = (w[3] @ dz + w[5][k] @ d) * (1 - h * h)
            for at, more in ((1, np.outer(x, dh)), (2, dh), (3, np.outer(h, dz)), (4, dz)):
                g[at] += more / n
            g[5][k] += np.outer(h, d) / n
            g[6][k] += d / n
            for i, e in enumerate(a):
                g[0][i, e] += (w[1] @ dh)[i * lm.WIDTH : (i + 1) * lm.WIDTH] / n
        for got, old, squares, by in zip(net.weights, w, seen, g, strict=True):
            # A gradient of nearly nothing has no sure sign in float32.
            sure = (np.abs(by) > 1e-5) | (by == 0)
            assert np.allclose(squares, 1e-8 + by * by, rtol=1e-3, atol=1e-9)
            assert np.allclose(got[sure], (old + lm.RATE * by / np.sqrt(1e-8 + by * by))[sure], rtol=1e-3, atol=1e-3)


def test_products_of_small_blocks():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, lm.ROWS, 2 * lm.ROWS, 5 * lm.ROWS - 1, 5 * lm.ROWS + 1):
        a, b, c = (rng.integers(-9, 9, s).astype(np.float32) for s in ((n, 33), (33, 64), (n, 64)))
        assert np.array_equal(lm._times(a, b, np.empty((n, 64), np.float32)), a @ b)
        assert np.array_equal(lm._turned_times(a, c, np.empty((33, 64), np.float32)), a.T @ c)
    for of in (np.array([3, 0, 3, 9]), np.zeros(0, np.int64)):
        assert all(np.array_equal(x, y) for x, y in zip(lm._numbers(of, 10), np.unique(of, return_inverse=True), strict=True))


def test_words_are_hashed_in_short_runs(monkeypatch):
    """Runs of any length give the same hashes, and hashing many words takes little room beside their hashes."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from columna.llm import shared

    text = pa.array([" ".join(("a", "bc" * 31, "x" * 63, "y" * 64, "z" * 65, "w" * 300)) * 3])
    want = shared.word_hashes(text)[0]
    for run in (1, 63, 64, 65, 200):
        monkeypatch.setattr(shared, "_HASHED", run)
        assert np.array_equal(shared.word_hashes(text)[0], want)
    monkeypatch.undo()
    n = 300_000
    chars, lengths = np.full(5 * n, 97, np.uint8), np.full(n, 5)
    starts = np.cumsum(lengths) - lengths
    tracemalloc.start()
    shared.hashes_of(chars, starts, lengths)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * 8 * n


def test_own_words_are_found_by_their_first_bits():
    import numpy as np

    rng = np.random.default_rng(0)
    for own in (rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1), np.arange(40, dtype=np.uint64), ~np.arange(40, dtype=np.uint64)):
        own = np.unique(own)
        net = lm.WindowNet.of(own[::-1].copy(), np.full(len(own), 2), 9 * len(own))
        with np.errstate(over="ignore"):
            hashes = np.concatenate((own, own + np.uint64(1), own - np.uint64(1), rng.integers(0, 1 << 62, 99).astype(np.uint64)))
        got = net.classes(hashes, np.zeros(len(hashes), np.uint64)).tolist()
        number = {h: len(own) - 1 - i for i, h in enumerate(own.tolist())}
        assert got == [number.get(h, len(own)) for h in hashes.tolist()]
