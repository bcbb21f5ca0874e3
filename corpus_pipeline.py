"""Four stages over the documents: toxic ones go, like lines go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import line_dedup, ngram_join, packing, toxicity
from folioloom.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (operator 5) rejects go; a null text is judged as the empty one, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels)).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines (operator 1) one stays; n_chars is that of the new text.

    A document that loses lines and has nothing but blank ones left goes: all it said stands elsewhere. Documents that
    lose nothing stay as they are, null and empty texts and rows with a null id among them; repeated rows lose the
    same lines.
    """
    cut = line_dedup.line_dedup(docs, drop_emptied=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (operator 10) the row with the smallest id stays.

    Rows are told apart by id and text; of a repeated row one stays. Texts without a word are in no class and stay.
    """
    return ngram_join.keep_one(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens (operator 9); a null text is one token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("packing", pack)]

#: Classifier, MinHash and packing have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
