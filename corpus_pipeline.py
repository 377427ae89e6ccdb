"""A training-data pipeline over documents: each stage works on all rows that the one before kept.

Toxic documents go, then documents that the quality rules reject, then exact copies but one, then all but one of each
group of near copies; what is left is packed into sequences.

Rows are never told apart by their id alone, and the columns of the input come out as they went in, whatever their names: scores and verdicts
live outside them. Edge cases: a null text counts as empty (not toxic by itself; the quality rules reject it for having fewer than 20 words); null ids are kept and come last where
the smallest id of a group stays; rows repeated in full are copies, of which one stays; without labels no document is toxic; an empty table gives empty
results of the same columns. Very long texts are looked at whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import _text as X
from broadsheet.llm import exactdedup, jaccard, packing, quality, toxicity
from broadsheet.llm._shared import shared_path


def _judged(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their text, so that no verdict has the name of one of theirs."""
    return docs.select(F.struct(*[docs[X.quoted(c)] for c in docs.columns]).alias("row"), F.col("text"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier to labelled documents and drops those scored toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(_judged(docs), model).where("predicted = 0").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score_quality(_judged(docs)).where("kept").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the row of the smallest id of each group stays."""
    return jaccard.keep_one_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and tokenization are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
