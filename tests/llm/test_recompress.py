"""Substring deduplication against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from columna.llm import recompress
from columna.llm.recompress import Symbols, substring_dedup
from columna.llm.shared import mix

SCHEMA = "doc_id long, text string, lang string, doc int"


def brute(rows: list[tuple], window: int = 20) -> list[tuple]:
    """Every window of every document in order; rows equal in doc_id and text are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    words = {r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in docs}
    seen: set[tuple] = set()
    out = {}
    for r in docs:
        w, gone = words[r], [False] * len(words[r])
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[r] = (r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((out[r] for r in rows), key=repr)


def corpus() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (19, 20, 21, 35, 60, 150, 400)]
    rows = []
    for i in range(120):
        text = say(rng.randrange(0, 90))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        if i % 10 == 3 and rows:  # a near copy
            text = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randrange(3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i * 7 - 40, "\t".join(text[:5]) + "  " + " ".join(text[5:])))
    period = ["tick", "tock", "tack"]
    rows += [(2000, " ".join(["la"] * 57)), (2001, " ".join(["x", *["la"] * 33, "y"])), (2002, " ".join(period * 30)), (2003, " ".join(["so", *(period * 12)[1:]])), (2004, " ".join([*period, *["la"] * 25, *period * 7]))]
    rows += [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, " ".join(passages[3])), (5, "Ünï çode x " + " ".join(passages[2])), (None, " ".join(passages[4])), (-1, "A " + " ".join(passages[4]).upper())]
    rows += [(6000, " ".join(say(6000) + passages[6]))] + [rows[7]] * 9 + [(None, " ".join(passages[4]))] * 3
    return rows


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


@pytest.mark.parametrize("bucket_bytes", [16_000_000, 2000])
def test_against_brute_force(spark, bucket_bytes, monkeypatch):
    monkeypatch.setattr(recompress, "RUN", 64)
    rows = corpus()
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], SCHEMA).repartition(5)
    assert result(substring_dedup(df, texts=False, bucket_bytes=bucket_bytes)) == brute(rows)


def test_real_outputs_and_other_windows(spark):
    rows = [(1, "a b c d e"), (2, "x b c d  y b c d"), (3, None)]
    got = {r["doc_id"]: r for r in substring_dedup(spark.createDataFrame([(*r, None, 0) for r in rows], SCHEMA), window=3).collect()}
    assert got[1]["kept"] == "a b c d e" and got[1]["removed"] == []
    assert got[2]["kept"] == "x y" and [tuple(s) for s in got[2]["removed"]] == [(1, 4), (5, 8)] and got[2]["n_removed"] == 6
    assert got[3]["kept"] == "" and got[3]["n_words"] == 0


def test_empty_table(spark):
    got = substring_dedup(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "removed", "kept"]


def test_a_third_of_the_rows_equal(spark, monkeypatch):
    monkeypatch.setattr("columna.llm.shared.COPY_RUN", 4)
    rows = corpus()[:40] + [(9, "one two " * 30)] * 25
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(6)
    assert result(substring_dedup(df, texts=False)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_interior_symbols_agree(middle, before, after):
    """A symbol made from words of a shared stretch alone is made wherever the stretch stands."""
    words = lambda xs: mix(np.array(xs, np.uint64) + np.uint64(5))
    whole, part = before + middle + after, middle
    found = []
    for xs, at in ((whole, len(before)), (part, 0)):
        s = Symbols(words(xs), np.zeros(len(xs), np.int64), 8)
        inside = (s.low >= at) & (s.high <= at + len(middle))
        found.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(s.name[inside], s.start[inside], s.end[inside], strict=True)})
    assert found[1] <= found[0] or not found[1]


def test_records_survive_packing():
    r = recompress._records(np.arange(5, dtype=np.uint64), np.arange(5), np.arange(-2, 3), np.arange(5))
    back = recompress._unpack(pa.chunked_array([pa.array([recompress._pack(r[:2]), recompress._pack(r[2:])], pa.binary())]), recompress._RECORD)
    assert (back == r).all()


KEEPS = """
import sys
sys.path.insert(0, sys.argv[1])
import numpy as np
import pyarrow as pa
from columna.llm import recompress

def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024

def found():
    for i in range(40):
        yield recompress._records(*(np.random.default_rng(i).integers(0, 1 << 62, (3, 60_000)) % (1 << 31)), np.zeros(60_000, np.int64))

def run():
    return sum(b.num_rows for b in recompress._sent(found(), 12))

np.zeros(31 << 20, np.uint8)  # from here on, malloc keeps smaller blocks when they are freed, as in a worker that has run for a while
before, rows = held(), run()
print(rows, held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_memory_is_given_back():
    """Spark keeps a Python worker after its task: what the task has freed must not stay with it."""
    root = str(Path(__file__).parents[2])
    rows, mb = subprocess.run([sys.executable, "-c", KEEPS, root], capture_output=True, text=True, check=True).stdout.split()
    assert int(rows) == 36 and float(mb) < 100  # 213 when it stays
