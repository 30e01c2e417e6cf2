"""Prepare a training corpus: five stages over `documents`, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns documents; the last adds how
much of each document the mix takes. Columns of documents are kept throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.llm import bagminhash, decontaminate, lines, mixing, toxicity
from relief.session import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that stand earlier go; `n_chars` follows the text where it changed.

    Every document stays, also one whose text becomes empty.
    """
    cleaned = lines.remove_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates stays."""
    return bagminhash.one_of_each(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words taken of each; those not taken go."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources to target weights", mix_to_weights),
]

# the classifier and the signatures have no SQL; tests compare the stages with direct computation
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
