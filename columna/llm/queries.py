"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import itq, langid, lm, merkle, mixing, ngram_join, packing, perm_index, recompress, sharding, urlfilter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perm_index.permutation_search(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.page_responses(_table(spark, sf_dir, "pages")))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.corpus_likelihood(docs, lm.fit(docs))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.substring_dedup(_table(spark, sf_dir, "documents"), window=20, texts=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_documents(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_permutation_index, op4_stratified_shards, op5_warc_derivatives, op6_pareto_mix, op7_itq_dedup, op8_pseudo_likelihood, op9_url_filter, op10_best_fit, op11_substring_dedup, op12_merkle_manifest, op13_vector_codes)}

_URL_SQL = """
WITH rules(text, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT r.text FROM rules r WHERE starts_with(p.path, substr(r.text, instr(r.text, '/')))
            AND (p.host = split_part(r.text, '/', 1) OR ends_with(p.host, '.' || split_part(r.text, '/', 1)))
          ORDER BY length(r.text) DESC, r.text LIMIT 1) AS rule
  FROM parts p)
SELECT j.page_id, j.host, j.path, j.rule, coalesce((SELECT verdict FROM rules r WHERE r.text = j.rule), 'allow') AS verdict FROM judged j
"""

_MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(text) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * (1000 * size // (size + 64)))::BIGINT AS weights FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS stop FROM w),
l AS (SELECT *, (least(sum(source_size) OVER () * 1.5::DOUBLE, sum(cap) OVER ()) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weights, least(cap, (SELECT arg_min(level, stop) FROM l WHERE level <= stop) * w) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size + (1000 * size // (size + 64) - weights::DOUBLE / t.source_size) / 2000.0::DOUBLE * least(t.target / t.source_size, 2.0::DOUBLE - t.target / t.source_size) ELSE 0 END AS wanted,
             (('0x' || substr(md5('29:' || coalesce(d.doc_id::VARCHAR, '-') || ':' || coalesce(d.h, '-')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(wanted) AS whole, wanted - floor(wanted) AS frac FROM p),
o AS (SELECT *, CASE WHEN frac > 0 AND size > 0 THEN (u / (1 - u)) / (frac / (1 - frac)) END AS q, sum(whole * size) OVER (PARTITION BY source) AS certain FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, h, size ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= target - certain THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       source, (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= target - certain THEN 1 ELSE 0 END)::BIGINT AS copies, h AS text_md5 FROM c
"""

_JOIN_SQL = """
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, len(w) AS m FROM texts WHERE len(w) >= 4),
runs AS (SELECT r, i, m, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT DISTINCT r, g FROM runs WHERE i <= m - 3 UNION ALL SELECT r, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 3),
sized AS (SELECT r, g, count(*) OVER (PARTITION BY r) AS n, count(*) OVER (PARTITION BY g) AS df FROM grams JOIN texts USING (r) WHERE doc_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY df, g) AS k FROM sized),
heads AS (SELECT * FROM ranked WHERE df > 1 AND k <= n - (85 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.r AS a, b.r AS b, a.n + b.n AS ns FROM heads a JOIN heads b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
pairs AS (SELECT m.a, m.b, ns, count(*) AS common FROM met m JOIN sized x ON x.r = m.a AND x.df > 1 JOIN sized y ON y.r = m.b AND y.g = x.g GROUP BY m.a, m.b, ns),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (ns - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT r, r FROM texts UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.other = ways.a),
found AS (SELECT node, min(doc_id) AS component_id FROM reach JOIN texts ON other = r GROUP BY node),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN component_id END::BIGINT AS component_id
FROM texts JOIN found ON node = texts.r LEFT JOIN sizes ON sizes.r = texts.r
"""

_NEAR_SQL = """
WITH RECURSIVE typed AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
fine AS (SELECT r, label, x FROM typed WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0
           AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
usual AS (SELECT len(x) AS d FROM fine GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
v AS (SELECT fine.* FROM fine JOIN usual ON len(x) = d),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.98::DOUBLE),
reach(node, other) AS (SELECT r, r FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
found AS (SELECT node, min(vec_id) AS c FROM reach JOIN typed ON other = r GROUP BY node),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept
FROM typed LEFT JOIN found ON node = r LEFT JOIN many ON a = r
"""

_REPEAT_SQL = """
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM texts),
windows AS (SELECT r, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM windows) WHERE n > 1),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
marked AS (SELECT words.r, words.i, word, coalesce(bool_or(again.i IS NOT NULL) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM words LEFT JOIN again ON words.r = again.r AND words.i = again.i),
kept AS (SELECT r, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT d.doc_id, len(docs.w)::BIGINT AS n_words, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM documents d JOIN docs ON d.doc_id IS NOT DISTINCT FROM docs.doc_id AND d.text IS NOT DISTINCT FROM docs.text LEFT JOIN kept ON kept.r = docs.r
"""


#: What each value of four bits adds to a CRC-32, by its rule (polynomial 0xEDB88320).
_CRC_STEPS = [0]
for _i in range(1, 16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_STEPS.append(_c)
_CRC_LOW = f"xor(xor(c, x) >> 4, ({_CRC_STEPS})[(xor(c, x) & 15) + 1])"
_CRC_BYTE = f"xor({_CRC_LOW} >> 4, ({_CRC_STEPS})[({_CRC_LOW} & 15) + 1])"

_SHARD_SQL = f"""
WITH bytes AS (SELECT doc_id, source, text, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
             CASE WHEN text IS NOT NULL THEN xor(list_reduce(b, lambda c, x: {_CRC_BYTE}), 4294967295::BIGINT) END AS text_crc32 FROM bytes),
h AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text_crc32::VARCHAR, '-') || ':' || size), 1, 13))::BIGINT AS h FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, h, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // n)::INT AS shard, (place - ((place * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM o
"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
_LEAF = lambda n: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n, 'text')))})"

#: The trees are made bottom up; then each leaf's digest, its siblings and the digest of its altered row go up together.
_TREE_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: {_CRC_BYTE}) AS crc FROM documents),
leaves AS (
  SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars::HUGEINT + CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END)")} AS altered FROM marked),
placed AS (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, n, i, level, h) AS (
  SELECT lang, n, i, 0, leaf FROM placed
  UNION ALL SELECT lang, (n + 1) // 2, i // 2, level + 1, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, n, i // 2, level),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(n, i, level, h) AS (
  SELECT n, i, 0, subroot FROM subroots
  UNION ALL SELECT (n + 1) // 2, i // 2, level + 1, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY n, i // 2, level),
climb(r, lang, n, i, level, d, proof) AS (
  SELECT r, lang, n, i, 0, altered, '' FROM placed
  UNION ALL SELECT c.r, c.lang, (c.n + 1) // 2, c.i // 2, c.level + 1, CASE WHEN s.h IS NULL THEN sha256(d) WHEN c.i % 2 = 1 THEN sha256(s.h || d) ELSE sha256(d || s.h) END, proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1),
above(r, n, i, level, d, proof) AS (
  SELECT c.r, s.n, s.i, 0, c.d, c.proof FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL SELECT c.r, (c.n + 1) // 2, c.i // 2, c.level + 1, CASE WHEN s.h IS NULL THEN sha256(d) WHEN c.i % 2 = 1 THEN sha256(s.h || d) ELSE sha256(d || s.h) END, proof || coalesce(s.h, '')
  FROM above c LEFT JOIN tops s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(a.proof) AS proof_sha256, a.d AS folded_root, a.d = t.h AS verified
FROM placed p JOIN above a ON a.r = p.r AND a.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.n = 1
"""


def _codes_sql(rounds: int = 4) -> str:
    """Each round's assignment and means, one after another."""
    assign = lambda k: f"a{k} AS MATERIALIZED (SELECT r, p, first(x) AS x, arg_min(e, [d, e]) AS e, min(d) AS d FROM (SELECT r, v.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT AS d FROM parts v JOIN b{k} USING (p)) GROUP BY r, p)"
    move = lambda k: f"s{k} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS y FROM a{k}) GROUP BY p, e, j) GROUP BY p, e), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c)::BIGINT[] AS c FROM b{k} b LEFT JOIN s{k} s USING (p, e))"
    steps = ", ".join(f"{assign(k)}, {move(k)}" for k in range(rounds)) + f", {assign(rounds)}"
    return f"""
WITH typed AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0),
fine AS (SELECT * FROM typed WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
usual AS (SELECT len(x) AS width FROM fine GROUP BY len(x) ORDER BY count(*) DESC, len(x) LIMIT 1),
whole AS (SELECT r, vec_id, label, x AS v, list_transform(x, lambda e: floor(e * 1024)::BIGINT) AS x, len(x) AS width FROM fine JOIN usual ON len(x) = width),
cut AS (SELECT p, [p * (width // 4) + least(p, width % 4) + 1, (p + 1) * (width // 4) + least(p + 1, width % 4)] AS s FROM usual, (SELECT unnest(range(4)) AS p)),
parts AS MATERIALIZED (SELECT r, p, x[s[1] : s[2]] AS x FROM whole, cut),
begin AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM whole),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN begin USING (r) WHERE e < 256),
{steps},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT r, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN whole USING (r), digest
"""


#: The others are a search or a model that SQL can't express, or (10) sequential.
ORACLES = {"op1_ngram_join": _JOIN_SQL, "op4_stratified_shards": _SHARD_SQL, "op6_pareto_mix": _MIX_SQL, "op7_itq_dedup": _NEAR_SQL, "op9_url_filter": _URL_SQL, "op11_substring_dedup": _REPEAT_SQL, "op12_merkle_manifest": _TREE_SQL, "op13_vector_codes": _codes_sql()}
