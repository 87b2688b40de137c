"""The corpus pipeline: five stages, each an operator of newsloom.llm over all that the stage before it kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; where a stage changes a text,
n_chars follows. Columns other than those of documents are left behind. Every stage takes rows that repeat each other one by one,
nulls in any column, texts of any length and empty tables, which give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import line_dedup, near_dedup, packing, quality, secrets
from newsloom.llm.queries import tokenizer_file
from newsloom.llm.work import materialize, table

SALTS = 16
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels' training rows alone. A null text is judged as an empty
    one; a score of exactly ACCEPT passes. Equal texts have equal scores, so copies stay or go together."""
    net = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return columns_of(quality.score_rows(docs, net).where(F.col("score") >= quality.ACCEPT))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeated chunks of lines that stand elsewhere before; a text that loses all becomes empty, a null one stays null."""
    return columns_of(line_dedup.dedup_rows(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Rows that share that key stay together. Null
    and empty texts are near nothing and stay, as do rows with a null key."""
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return columns_of(docs.join(dropped, "doc_id", "left_anti"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark, overlapping ones by one. Null and empty texts stay as they are."""
    return columns_of(secrets.redact_rows(docs).withColumn("n_chars", F.when(F.col("n_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences. A null or empty text is one piece of the end mark;
    equal pieces get places of their own."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
