"""A corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.  In every stage columns that are added
for a while get names that ``docs`` does not have; texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columna.llm import langid, mixing, ngram_join, packing
from columna.llm.shared import free_name, keep, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or whose words are labelled with less than 0.3 on the mean; the rest stay as they are.

    Null and empty texts have no letter.  Repeated rows are judged alike.  Without any label nothing is learned, and
    all texts with a letter stay.
    """
    return langid.keep_confident(docs, langid.fit(docs), least=0.3)


def _mark(docs: DataFrame):
    return F.xxhash64(F.col("text").cast("string"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows with the same doc_id and text the smallest in the other columns; rows without doc_id or text stay.

    Columns that have no order (maps, variants) are compared as JSON text.
    """
    rest, row = [c for c in docs.columns if c not in ("doc_id", "text")], free_name(docs, "_row")
    whole = F.struct(*[F.col(_quoted(c)) for c in rest]) if rest else F.lit(0)
    orderless = any(x in docs.schema[c].dataType.simpleString() for c in rest for x in ("map<", "variant"))
    least = F.min_by(whole, F.to_json(whole)) if orderless else F.min(whole)
    named = docs.where("doc_id is not null and text is not null")
    once = named.groupBy("doc_id", "text").agg(least.alias(row))
    once = once.select("doc_id", "text", *[F.col(f"{row}.{_quoted(c)}").alias(c) for c in rest]).select(*[_quoted(c) for c in docs.columns])
    return once.unionAll(docs.where("doc_id is null or text is null"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest doc_id stays.

    Of rows with the same doc_id and text one stays; rows of one doc_id with different texts are documents of their
    own.  A document without words, or without doc_id, is no copy of anything.
    """
    found = keep(ngram_join.ngram_jaccard_join(docs, n=5, num=80, den=100), "groups")
    first = found.where("kept and doc_id is not null and n_shingles > 0")
    twice = first.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_id"]) & (_mark(docs) == gone["_mark"])
    out = docs.join(gone, same, "left_anti")
    return _one_of_each(out) if twice else out


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2, 1, at most twice each document.

    Null and empty texts have no words and are not taken.  Rows with the same doc_id and text are alike: what the
    mix takes of them together comes from one of them.
    """
    found = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = keep(found.where("_copies > 0"), "copies")
    if taken.where("_rows > 1").limit(1).count():
        docs = _one_of_each(docs)
    # The other side's columns get names of their own before they stand beside those of docs.
    id_, md5, copies, number = (free_name(docs, f"_mix_{x}") for x in ("id", "md5", "copies", "number"))
    taken = taken.select(F.col("_id").alias(id_), F.col("_md5").alias(md5), F.col("_copies").alias(copies))
    both = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & F.md5(docs["text"].cast("string")).eqNullSafe(F.col(md5)))
    return both.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(_quoted(c)) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; null and empty texts give a row without bin.

    Repeated rows are documents of their own.
    """
    return packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", ngram_jaccard_join), ("mixing sources to target weights", mixing_to_weights), ("best-fit packing", best_fit_packing)]

#: A trained model and a search over near copies are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, last = keep(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
