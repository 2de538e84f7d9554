"""The SQL of corpus queries against the operators, on the fixtures of the other tests."""

from __future__ import annotations

import duckdb
import pytest
from test_documents import SCHEMA as DOCS
from test_documents import corpus
from test_vectors_pages import SCHEMA as VECTORS
from test_vectors_pages import vectors

from columna.llm.packing import pack_documents
from columna.llm.queries import ORACLES, QUERIES

URLS = ["HTTP://Shop.Example.COM/en/7/x?q#f", "a://net/de/", "a://example.net/de/88", "://org/es/1#x/", "no scheme", "", None, "a://b://com/en/", "x://xexample.com/en/7", "x://org", "x://org/ES/", "x://com/en/\nz"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sql"))
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(vectors(), VECTORS).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_equals_query(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["op4_stratified_shards", "op6_pareto_mix"])
def test_equal_rows_a_third_of_the_table(spark, tmp_path, monkeypatch, name):
    """Equal rows are counted, then made again in runs of four here, each a row with its own rank."""
    monkeypatch.setattr("columna.llm.shared.COPY_RUN", 4)
    rows = corpus()
    rows += [rows[3]] * 59 + [(None, "one two three", "en", "a", 13)] * 21 + [(None, None, None, None, None)] * 9
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select([c[0] for c in want.description]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_equal_rows_are_packed_in_different_groups(spark, monkeypatch):
    monkeypatch.setattr("columna.llm.shared.COPY_RUN", 4)
    docs = spark.createDataFrame([(1, "a b c", None, None, 5)] * 200 + [(2, None, None, None, None)] * 6, DOCS)
    got = pack_documents(docs, group_pieces=20).collect()
    packed = [r for r in got if r["bin_id"] is not None]
    assert len(packed) == 200 and len(got) == 206 and {r["length"] for r in packed} == {3}
    groups = [r["bin_id"] >> 32 for r in packed]
    assert len(set(groups)) == 10 and max(map(groups.count, set(groups))) < 60
    for b in {r["bin_id"] for r in packed}:
        assert sorted(r["bin_offset"] for r in packed if r["bin_id"] == b) == list(range(0, 3 * sum(r["bin_id"] == b for r in packed), 3))
