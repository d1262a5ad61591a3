"""A corpus from start to end: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of
``documents``; other columns of docs are left out, whatever their names. An empty table gives an
empty one. No stage drops rows with a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphline.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from glyphline.llm.queries import tokenizer
from glyphline.llm.shared import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    Null and empty texts have no evidence and stay; equal rows are judged alike. Without labels of
    both classes, or where these teach nothing, all documents stay.
    """
    return toxicity.drop_toxic(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat earlier text; n_chars counts what is left.

    Null text stays null, and text of which nothing is left becomes empty. Rows with a null id are
    neither earlier text nor changed. Rows that share an id are one document: equal rows both stay whole.
    """
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", size.alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id.

    Texts without words are in no group. All rows of the smallest id stay.
    """
    return jaccard_join.keep_one(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, and null and empty items are held by none; an empty benchmark
    leaves all documents.
    """
    return decontaminate.remove_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and of the bytes that they decode to; null text is as empty text."""
    return byte_bpe.encode_digests(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encode_texts),
]

#: Toxicity scores and token ids can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
