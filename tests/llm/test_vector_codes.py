"""Vector codes against plain whole-number arithmetic."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from columna.llm import vector_codes
from columna.llm.vector_codes import compress, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4) -> list[tuple]:
    fine = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in fine]
    width = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    from fractions import Fraction

    fine = [(r[0], [(Fraction(x) * 1024).__floor__() for x in r[1]], r[2], r[1]) for r in fine if len(r[1]) == width]
    cut = [width // parts + (i < width % parts) for i in range(parts)]
    spans = [(sum(cut[:i]), sum(cut[: i + 1])) for i in range(parts)]
    begin = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[r[1][a:b] for r in begin] for a, b in spans]

    def assign(v: list[int]) -> list[tuple[int, int]]:
        return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], c, strict=True)), i) for i, c in enumerate(book)) for (a, b), book in zip(spans, books, strict=True)]

    for _ in range(rounds):
        got = [assign(r[1]) for r in fine]
        for p, (a, b) in enumerate(spans):
            new = list(books[p])
            for e in range(len(new)):
                mine = [r[1][a:b] for r, g in zip(fine, got, strict=True) if g[p][1] == e]
                if mine:
                    new[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
            books[p] = new
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    out, total = [], {}
    for r in fine:
        g = assign(r[1])
        e = sum(x[0] for x in g)
        out.append((r[0], bytes(x[1] for x in g).hex(), e, r[2]))
        total[r[2]] = total.get(r[2], 0) + e
    small = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, small(e), small(total[l]), digest) for i, c, e, l in out), key=repr)


def vectors(n: int = 90, width: int = 10, scale: float = 1.0) -> list[tuple]:
    rng = random.Random(8)
    rows = [(i * 3 - 20, [rng.gauss(0, scale) for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(rows[i][0], list(rows[i][1]), rows[i][2]) for i in (4, 4, 4, 20)]
    rows += [(500 + i, [round(rng.random()) / 4 for _ in range(width)], 3) for i in range(40)]  # many ties
    rows += [(None, [0.5] * width, 1), (700, [0.0] * width, 1), (701, None, 1), (702, [], 1), (703, [1.0] * (width - 1) + [None], 2), (704, [float("nan")] * width, 2), (705, [float("-inf")] * width, 2), (706, [1.0] * (width + 1), 2)]
    return rows


def result(spark, rows, **more) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in compress(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("entries", [256, 8])
def test_against_brute_force(spark, entries):
    assert result(spark, vectors(), entries=entries) == brute(vectors(), entries=entries)


@pytest.mark.parametrize("scale", [1e-170, 1e9, 1e200])
def test_tiny_and_large_components(spark, scale):
    rows = vectors(30, 8, scale)
    assert result(spark, rows, entries=6) == brute(rows, entries=6)


def test_many_labels_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert result(spark, vectors(), entries=8) == brute(vectors(), entries=8)


def test_empty_table(spark):
    got = compress(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert result(spark, [(1, None, 1), (2, [None], None)]) == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 50, 5000, 2**24, 2**27]), st.integers(1, 40), st.integers(1, 30))
def test_screening_loses_no_nearest_entry(seed, size, width, k):
    rng = np.random.default_rng(seed)
    book = rng.integers(-size, size + 1, (k, width))
    x = np.concatenate((rng.integers(-size, size + 1, (40, width)), (book[rng.integers(0, k, 20)] + book[rng.integers(0, k, 20)]) // 2))
    at, error = nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (error == every.min(1)).all()
