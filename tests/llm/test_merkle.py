"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from columna.llm import merkle
from columna.llm.merkle import Part, _node, check_documents, document_manifest, fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, path int"


def H(*xs: str) -> str:
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and each leaf's siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in zip(at, paths, strict=True):
            if i ^ 1 < len(nodes):
                p.append((i & 1, nodes[i ^ 1]))
            else:
                p.append((0, None))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, text, lang, source, n_chars."""
    full = [(lang, i, leaf_of(i, source, lang, n, text), leaf_of(i, source, lang, n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n, text)) for i, text, lang, source, n in rows]
    first = lambda v: (v is not None, v if v is not None else 0)
    by_lang: dict = {}
    for r in sorted(full, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by_lang.setdefault(r[0], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([r[2] for r in by_lang[v]]) for v in langs}
    root, tops = tree([trees[v][0] for v in langs]) if langs else ("", [])
    assert first(None) < first(0)
    out = []
    for v, top in zip(langs, tops, strict=True):
        for r, path in zip(by_lang[v], trees[v][1], strict=True):
            d = r[3]
            for right, s in path + top:
                d = H(d) if s is None else H(s, d) if right else H(d, s)
            out.append((r[1], r[2], trees[v][0], root, H(*[s for _, s in path + top if s]), d, d == root))
    return sorted(out, key=repr)


def documents(n: int = 150) -> list[tuple]:
    rng = random.Random(3)
    rows = [(i * 5 - 30, f"text {i} é", rng.choice(["en", "en", "en", "de", "ß", None]), rng.choice(["a", None]), rng.choice([i, None])) for i in range(n)]
    rows += [rows[4]] * 4 + [(rows[4][0], "other", rows[4][2], None, 1), (None, None, None, None, None), (None, "x", "en", "s", 3), (None, "x", "en", "s", 3), (9_000_000, "only", "zz", "s", 3), (12, "", "en", "", 2**63 - 1), (13, "long " * 50_000, "en", "a", 5)]
    return rows


def result(spark, rows, **more) -> list[tuple]:
    df = spark.createDataFrame([(*r, "g", 1) for r in rows], SCHEMA).repartition(5)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in check_documents(df, **more).select(names).collect()), key=repr)


@pytest.mark.parametrize("part_rows,step", [(50_000, 12), (7, 12), (3, 1)])
def test_against_a_plain_tree(spark, monkeypatch, part_rows, step):
    monkeypatch.setattr(merkle, "STEP", step)
    want = brute(documents())
    got = result(spark, documents(), part_rows=part_rows)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_upper_levels_in_several_rounds(spark, monkeypatch):
    """Blocks so low that a tree takes many rounds."""
    monkeypatch.setattr(merkle, "STEP", 1)
    whole = merkle._finished
    monkeypatch.setattr(merkle, "_finished", lambda edges, kind, high, top: whole(edges, kind, high - 10, top))
    assert result(spark, documents(60), part_rows=4) == brute(documents(60))


def test_small_tables(spark):
    assert result(spark, []) == []
    for rows in (documents()[:1], documents()[:3], [documents()[4]] * 30):
        assert result(spark, rows, part_rows=4) == brute(rows)


def test_equal_rows_are_cut_into_parts(spark):
    df = spark.createDataFrame([(*documents()[4], "g", 1)] * 60, SCHEMA).repartition(4)
    rows = document_manifest(df, part_rows=10)
    assert sorted(r["place"] for r in rows.collect()) == list(range(60))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.lists(st.integers(0, 70), max_size=5))
def test_parts_make_one_tree(n, cuts):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    whole = Part(leaves, 0, n)
    ((_, _, root),) = list(whole.edges())
    cuts = sorted({0, n, *[c for c in cuts if c < n]})
    known, parts = {}, []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        parts.append(Part(leaves[a:b], a, n))
        known |= {(level, i): d for level, i, d in parts[-1].edges()}
    for level in range((n - 1).bit_length()):  # the edges alone give the root
        for (at, i), d in list(known.items()):
            if at == level and i % 2 == 0:
                twin = known.get((level, i + 1))
                if twin or i + 1 == -(-n >> level):
                    known.setdefault((level + 1, i // 2), _node(d, twin) if twin else _node(d))
    assert known[(n - 1).bit_length(), 0] == root
    for i, path in enumerate(whole.paths({((n - 1).bit_length(), 0): b""})):
        assert fold(leaves[i], path, i, n) == (root, b"")
