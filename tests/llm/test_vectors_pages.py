"""Operators on vectors and pages against brute force and round trips."""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from columna.llm import itq, perm_index, urlfilter, warc
from columna.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(300, 360):  # near copies, about the threshold
        v = base[i % 7] + rng.standard_normal(16).astype(np.float32) * (0.02 if i % 2 else 0.15)
        rows.append((i, v.tolist(), (i % 7) % 3))
    rows += [(400 + i, base[0].tolist(), 0) for i in range(20)]
    rows += [(420, (base[0] * 3).tolist(), 0), (421, base[0].tolist(), None), (422, base[0].tolist(), 1)]
    rows += [(430, None, 0), (431, [0.0] * 16, 0), (432, [NAN] + [1.0] * 15, 0), (433, [INF] + [1.0] * 15, 0), (434, [None] + [1.0] * 15, 0), (435, [1.0, 2.0], 0), (436, [], 0), (None, base[1].tolist(), 1), (440, base[5].tolist(), 2), (440, base[5].tolist(), 2)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("_v", "role", "cls", "bucket", "score", "n", "of")})


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    d = tmp_path_factory.mktemp("vec")
    table.select("vec_id", "embedding", "label").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def good(rows):
    fine = lambda v: v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    return [(i, np.array(v, np.float64), g) for i, v, g in rows if i is not None and fine(v)]


def test_search(spark, rows, folder):
    got = QUERIES["op3_permutation_index"](spark, folder).collect()
    by_id = {i: v for i, v, _ in good(rows)}
    ids = np.array(sorted(by_id))
    x = np.stack([by_id[i] for i in ids])
    found: dict = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    # Two rows have the vec_id 440: each asks, and finds the other.
    assert len(found[440]) == 40 and sum(r["vec_id"] == 440 for r in found[440]) == 2
    del found[440]
    assert set(found) == {i for i in by_id if i % 20 == 0 and i != 440}
    hit = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(r["vec_id"] != q for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        for r in rs:
            assert r["score"] == pytest.approx(float(by_id[r["vec_id"]] @ by_id[q]), rel=1e-12)
        s = x @ by_id[q]
        s[ids == q] = -INF
        hit += len({r["vec_id"] for r in rs} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(found)) >= 0.9


def test_search_in_blocks_and_few_candidates(spark, table):
    small = perm_index.permutation_search(table, F.pmod("vec_id", F.lit(20)) == 0, k=5, block_bytes=50 * 128, query_bytes=7 * 128)
    assert small.groupBy("query_id").count().where("count <> if(query_id = 440, 10, 5)").count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 0.0], 0)], SCHEMA)
    got = perm_index.permutation_search(three, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 2.0), (1, 1.0)]
    assert perm_index.permutation_search(three.limit(0), F.col("vec_id") == 0).count() == 0


def cloud(kind, rng):
    if kind == "wide":
        return rng.standard_normal((2500, 384))
    if kind == "lengths":
        return rng.standard_normal((4000, 64)) * rng.lognormal(0, 0.7, (4000, 1))
    return rng.standard_normal((40, 32))[rng.integers(0, 40, 6000)] * 2 + rng.standard_normal((6000, 32))


@pytest.mark.parametrize("kind", ["wide", "lengths", "clusters"])
def test_recall_of_the_index(spark, tmp_path, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = cloud(kind, np.random.default_rng(3))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), f"{tmp_path}/v.parquet")
    table = spark.read.parquet(f"{tmp_path}/v.parquet")
    got = perm_index.permutation_search(table, F.pmod("vec_id", F.lit(50)) == 0, block_bytes=1_000_000).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -INF
        assert len(own) == 20
        hit += len(set(own["vec_id"]) & set(np.argsort(-s)[:20].tolist()))
    assert hit / len(got) >= 0.9


def test_near_duplicates_keep_vectors_of_one_id_apart(spark):
    v, w = np.random.default_rng(2).standard_normal((2, 16))
    rows = [(1, v.tolist(), 0), (1, w.tolist(), 0), (2, (v + 1e-3).tolist(), 0), (3, (w + 1e-3).tolist(), 0)]
    got = itq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_table_plan_falls_back_to_one_bucket():
    x = np.ones((50, 8)) / np.sqrt(8) + np.random.default_rng(0).standard_normal((50, 8)) * 1e-9
    assert itq.table_plan(x, x.mean(0), np.eye(8), 0.98, 8, 1e-30, 2, 1) == (1, 0)
    assert itq.substrings(x, np.zeros((8, 0)), 1, 0).tolist() == [[0]] * 50


def test_plan_reranks_a_share_of_clusters():
    x = cloud("clusters", np.random.default_rng(3))
    top = float(np.sqrt((x * x).sum(1)).max())
    piv = perm_index.apart(x[:1024], 256)
    piv = np.hstack([piv, np.sqrt(np.maximum(top * top - (piv * piv).sum(1), 0))[:, None]])
    index = perm_index.plan(perm_index.Index(piv, top, min(64, len(piv))), x[:4096], 20, 0.98, 0.6)
    assert 0 < index.share < 0.5 and 0 < index.route <= len(piv) and index.trial is not None
    assert perm_index.shard_cells({0: 5, 1: 3, 3: 25}, 4, 10) == ([0, 0, 0, 1], [1, 1, 1, 3], 4)


def linked(rows, threshold=0.98):
    fine = [(i, v / np.sqrt(v @ v), g) for i, v, g in good(rows) if g is not None]
    n, up = {}, {i: i for i, _, _ in rows if i is not None}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (i, v, g) in enumerate(fine):
        for b, (j, w, k) in enumerate(fine):
            if a != b and g == k and v @ w >= threshold:
                n[i] = n.get(i, 0) + (1 if i != 440 else 0.5)
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (n.get(i, 0), find(i)) for i in up}


@pytest.mark.parametrize("chunk", [2048, 8])
def test_near_duplicates(rows, table, chunk):
    got = itq.near_duplicates(table, chunk=chunk).collect()
    assert len(got) == len(rows)
    want = linked(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
            assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_near_duplicates_query_and_empty(spark, rows, folder, table):
    assert QUERIES["op7_itq_dedup"](spark, folder).count() == len(rows)
    assert itq.near_duplicates(table.limit(0)).count() == 0


def test_near_duplicates_far_from_zero(spark):
    """Vectors that crowd about a mean: their codes change more at the same cosine, so there are more tables."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((240, 16)) * 0.5 + 1.0
    near = base[:120] + rng.standard_normal((120, 16)) * 0.14
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([base, near]).astype(np.float32))]
    want = linked(rows)
    got = itq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(n > 0 for n, _ in want.values()) > 150
    doubles = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(doubles).collect()} == want
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_tables_follow_the_data():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16)) + 1.5
    few, many = x - 1.5, x
    plans = []
    for v in (few, many):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        r = np.hstack([itq.learn_rotation(u - u.mean(0), i) for i in range(16)])
        plans.append(itq.table_plan(u, u.mean(0), r, 0.98, 10, 1e-6, 256, 1))
    assert plans[0][0] < plans[1][0]
    assert itq.table_plan(u, u.mean(0), r, 0.98, 24, 1e-9, 16, 1)[1] < 24


def test_rotation_is_orthogonal():
    x = np.random.default_rng(1).standard_normal((200, 8))
    r = itq.learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    assert np.allclose(r.T @ r, np.eye(8))


URLS = ["http://a.example.com/en/712", "https://example.com/en/8", "HTTP://X.EXAMPLE.NET/de/81?q=1", "https://example.net/de/#t", "http://www.b.org/es/", "http://org/es/x", "http://porg/es/x", "ftp://c.com", "no scheme", None, "", "http://com/en/?://evil.com/en/", "http://d.com?x=/en/", "http://d.com/EN/1", "http://user@e.com:80/en/", "x://", "http://a.com/en/\nb", "http://example.com/en/7"]


def judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [256, 0])
def test_url_rules(spark, inline):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = urlfilter.filter_urls(df, inline=inline).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert tuple(r)[1:] == judge([*URLS, URLS[0]][r["page_id"]], urlfilter.RULES)
    assert urlfilter.filter_urls(df.limit(0), inline=inline).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(df, ()).collect()} == {"allow"}


#: The contract's words, apart from the code's.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


@pytest.mark.parametrize("inline", [256, 0])
def test_verdicts_of_the_contract(spark, inline):
    assert {r.text: r.verdict for r in urlfilter.RULES} == CONTRACT
    urls = {f"http://{sub}{rule}{more}": rule for rule in CONTRACT for sub in ("", "www.") for more in ("", "x")}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for default in ("allow", "block"):
        got = urlfilter.filter_urls(df, default=default, inline=inline).collect()
        assert {list(urls)[r["page_id"]]: (r["rule"], r["verdict"]) for r in got} == {u: (rule, CONTRACT[rule]) for u, rule in urls.items()}


PAGE = "<html lang='fr'><head><title>A &amp; B</title><style>p{}</style></head><body><p>One  two<b>!</b></p><script>x<y</script><a href=\"/u?a=1&amp;b=2\">go</a><!-- gone --> 3 &lt; 4</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.b/c", PAGE), (2, None, ""), (3, "http://d\r\ne", None), (4, "http://f", "<script>never ends"), (5, "http://g", "é" * 50_000), (1, "http://a.b/c", PAGE), (None, "http://h", "plain")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"block": F.lit(1), "record_id": F.lit("x")})


def test_derivatives(pages):
    responses = {(r["page_id"], r["payload"]): r for r in warc.page_responses(pages).collect()}
    got = warc.derive(warc.page_responses(pages)).collect()
    assert len(got) == 14
    for r in got:
        raw = r["block"].encode()
        assert r["content_length"] == len(raw) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        source = next(s for (i, _), s in responses.items() if i == r["page_id"])
        assert r["refers_to"] == source["record_id"] and r["source_payload_digest"] == warc.digest((source["payload"] or "").encode())
        assert r["source_header"] == source["http_header"]
    of = lambda i, k: next(r for r in got if r["page_id"] == i and r["record_type"] == k)["block"]
    assert of(1, "conversion") == "One two!\ngo 3 < 4" and of(2, "conversion") == "" and of(4, "conversion") == "" and len(of(5, "conversion")) == 50_000
    assert "title: A & B\r\n" in of(1, "metadata") and "language: fr\r\n" in of(1, "metadata") and "outlink: /u?a=1&b=2\r\n" in of(1, "metadata") and "source-header: HTTP/1.1 200 OK\r\n" in of(1, "metadata")
    assert len({r["record_id"] for r in got}) == 12  # the repeated page repeats its records
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><body><p>Hello world</p></body></html>", "Hello world"),
        ("<head><meta charset=u><title>a <p> b</title><p>Hello", "Hello"),
        ("<head><title>T</title>Hello <b>you</b>", "Hello you"),
        ("<head><script>'<p>'</script><title>T</title></head>x", "x"),
        ("<p>a</p><svg><path d=x><p>b</p>", "a\nb"),
        ("a <svg/> b <svg>c</svg> d", "a b d"),
        ("a<noscript>b<p>c", "a b\nc"),
        ("a<template>b<p>c", "a b\nc"),
        ("a<noscript>b</noscript><noscript>c", "a c"),
        ("a<style>b<p>c", "a"),
    ],
)
def test_unclosed_elements_do_not_take_the_page(page, text):
    assert warc.plain_text(page) == text


def test_records_round_trip(pages):
    derived = warc.derive(warc.page_responses(pages))
    rows = sorted(derived.collect(), key=lambda r: (r["record_id"]))
    data = b"".join(warc.record_bytes(r.asDict()) for r in rows)
    back = warc.parse(data)
    assert len(back) == len(rows)
    for (head, block), r in zip(back, rows, strict=True):
        assert block == r["block"].encode() and head["WARC-Record-ID"] == r["record_id"] and head["WARC-Refers-To"] == r["refers_to"] and head["WARC-Type"] == r["record_type"]
        assert head["WARC-Block-Digest"] == warc.digest(block) and head.get("WARC-Target-URI") == (None if r["target_uri"] is None else r["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    assert warc.serialize(derived).count() == len(rows)


class Reader:
    """An independent reading of well-formed pages, on the standard library's parser."""

    def __init__(self, page):
        from html.parser import HTMLParser

        me = self
        self.out, self.links, self.title, self.lang, self.hidden, self.in_title = [], [], None, None, [], False
        blocks = {"p", "div", "li", "ul", "h1", "h2", "br", "td", "tr", "table", "section"}

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag == "a" and dict(attrs).get("href") is not None:
                    me.links.append(" ".join(dict(attrs)["href"].split()))
                if tag == "html" and me.lang is None:
                    me.lang = dict(attrs).get("lang")
                if tag in ("script", "style", "head", "noscript", "template"):
                    me.hidden.append(tag)
                me.in_title = tag == "title"
                if tag in blocks and not me.hidden:
                    me.out.append("\n")

            def handle_endtag(self, tag):
                if me.hidden and me.hidden[-1] == tag:
                    me.hidden.pop()
                me.in_title = False
                if tag in blocks and not me.hidden:
                    me.out.append("\n")

            def handle_data(self, data):
                if me.in_title and me.title is None:
                    me.title = " ".join(data.split())
                elif not me.hidden:
                    me.out.append(data)

            def handle_comment(self, data):
                if not me.hidden:
                    me.out.append(" ")

        parser = Parser(convert_charrefs=True)
        parser.feed(page)
        parser.close()
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        self.text = "\n".join(x for x in lines if x)


def made_pages(rng):
    words = ["alpha", "b&amp;c", "&lt;tag&gt;", "é&eacute;", "x > y", "1 &#60; 2"]

    def inner(depth):
        out = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(0, 7)
            text = " ".join(rng.choice(words, 3))
            if depth and kind < 3:
                tag = rng.choice(["p", "div", "ul", "b", "SPAN", "h1", "noscript"])
                out.append(f'<{tag} class="a > b" id=x>{inner(0) if tag == "noscript" else inner(depth - 1)}</{tag}>')
            elif kind == 3:
                out.append(f"<a title='>' HREF=\"/p?q={rng.integers(9)}&amp;r=1\">{text}</a>")
            elif kind == 4:
                out.append(f"<!-- {text} <a href=no> --><script>if (a < b) '<p>'</script>")
            elif kind == 5:
                out.append(f"<br/>{text}<a href=/bare{rng.integers(9)}>")
            else:
                out.append(text)
        return "\n".join(out)

    return [f"<!DOCTYPE html><html lang='{rng.choice(['de', 'en-US'])}'><head><meta charset=utf-8><title>T {i} &amp; co</title><style>p > a {{}}</style></head><body>{inner(3)}</body></html>" for i in range(60)]


def test_derivatives_query_against_another_parser(spark, tmp_path):
    pages = made_pages(np.random.default_rng(7))
    spark.createDataFrame([(i, f"http://x/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op5_warc_derivatives"](spark, str(tmp_path)).collect()
    assert len(got) == 120
    for r in got:
        page = pages[r["page_id"]]
        want = Reader(page)
        raw = hashlib.sha1(page.encode()).digest()
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(raw).decode()
        if r["record_type"] == "conversion":
            assert r["block"] == want.text
        else:
            fields = [x.split(": ", 1) for x in r["block"].split("\r\n") if x]
            assert [v for k, v in fields if k == "outlink"] == want.links
            assert [v for k, v in fields if k in ("title", "language")] == [want.title, want.lang]


@pytest.mark.parametrize("unit", ["<a", "<title>", "<html ", '<a href="', "<svg>", "<head>", "<p ='", "<a b='c' d=\"", "<head><title>x"])
def test_pages_are_read_in_linear_time(unit):
    import time

    def seconds(n):
        began = time.process_time()
        warc.read_page(unit * (n // len(unit)))
        return time.process_time() - began

    assert seconds(2_000_000) < max(1.0, 40 * seconds(200_000))


def test_responses_from_files(spark, pages, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
    import gzip

    other = b"".join(warc.record_bytes(r.asDict()) for r in warc.derive(warc.page_responses(pages)).limit(2).collect())
    (tmp_path / "a.warc.gz").write_bytes(other + gzip.compress(head.encode() + block + b"\r\n\r\n"))
    got = warc.responses(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [(2, "<urn:uuid:1>", "http://x", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b\r\n", b"<p>hi", None, warc.digest(block))]
    assert warc.derive(warc.responses(spark.read.format("binaryFile").load(str(tmp_path)))).count() == 2


def test_source_bytes_digests_and_charset_stay(spark, tmp_path):
    """A Latin-1 page of a WARC/1.0 file without blanks behind its colons, not gzipped."""
    body = "<title>caf\xe9</title><p>na\xefve".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID:<urn:uuid:7>\r\nWARC-Payload-Digest:{warc.digest(body)}\r\nWARC-Block-Digest: sha1:GIVEN\r\nWARC-Note: one\r\n two\r\nContent-Length:{len(block)}\r\n\r\n"
    (tmp_path / "b.warc").write_bytes(head.encode() + block + b"\r\n\r\n")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.parse((tmp_path / "b.warc").read_bytes())[0][0]["WARC-Note"] == "one two"
    rows = {r["record_type"]: r for r in warc.derive(warc.responses(files)).collect()}
    assert rows["conversion"]["block"] == "caf\xe9\nna\xefve" or rows["conversion"]["block"].endswith("na\xefve")
    assert f"source-payload-digest: {warc.digest(body)}\r\n" in rows["metadata"]["block"] and "source-block-digest: sha1:GIVEN\r\n" in rows["metadata"]["block"]
    assert "title: caf\xe9\r\n" in rows["metadata"]["block"] and rows["conversion"]["source_payload_digest"] == warc.digest(body)
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_warc_files_are_parsed_in_linear_time():
    import time

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4000\r\n\r\n" + b"x" * 4000 + b"\r\n\r\n"
    began = time.time()
    assert len(warc.parse(one * 20_000)) == 20_000
    assert time.time() - began < 20


@pytest.mark.parametrize("scale", [1e-170, 1.0, 1e200])
def test_tiny_and_huge_vectors(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))
    x[30:40] = x[:10] + rng.normal(size=(10, 12)) * 1e-3
    df = spark.createDataFrame([(i, (v * scale).tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in itq.near_duplicates(df).collect()}
    assert got == {i: i - 30 if 30 <= i < 40 else i for i in range(60)}
    found = perm_index.permutation_search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(found) == 15
    if scale != 1.0:
        return  # products are 0 or infinite in double precision: only their number is defined
    for q in (0, 20, 40):
        want = [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want
