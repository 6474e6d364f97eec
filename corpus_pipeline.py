"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and is written as a
table before the next reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import bpe, common, line_dedup, mixing, ngram_join, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of sf_dir, doesn't reject."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier place; those of which nothing is left go."""
    done = line_dedup.dedup_lines(common.pick(docs, *COLUMNS), short=True)
    rest = (F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(rest).withColumn("n_chars", chars).select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles, the one of the smallest doc_id."""
    found = ngram_join.jaccard_join(docs, words=5, percent=80)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    left = common.pick(docs, *COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)
    # Repeated rows and rows that share a doc_id are in one group; of those the smallest text stays.
    again = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = common.stage(again, "repeated")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    return left.join(again, "doc_id", "left_anti").unionByName(repeated.select("doc_id", "d.text", "d.lang", "d.source", "d.n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The standard mix of the sources, a row for each copy of a document."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of them and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("ngram_join", remove_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages' results aren't expressible in SQL; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name)
    return docs
