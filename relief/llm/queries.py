"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.llm import (
    alignment,
    bagminhash,
    decontaminate,
    divergence,
    lattice,
    licenses,
    lines,
    mixing,
    neighbours,
    sql,
    substrings,
    suffixes,
    toxicity,
    urls,
)

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that is a copy or an edited copy of a test item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; rows whose id's crc32 divides by five are never learnt from."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.is_held_out("doc_id"))
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op1_source_mixing", sql.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to a mix of all sources at weights 5, 2, 1."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_url_filter", sql.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every URL by rule, else by the ratio of two character models."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_license_scan", sql.op7())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every whole text."""
    places = F.transform("spots", lambda s: s["word"])
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("spots").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


@query("op10_substring_dedup", sql.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that no earlier 20-word window covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False)


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand at two places at least."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without multi-line chunks that stand earlier; the kept text as its SHA-256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = lines.remove_lines(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_bagminhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of every document, at 0.8 over five-word shingles."""
    return bagminhash.groups_of(table(spark, sf_dir, "documents"))


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_subword_lattice")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every whole text over all its segmentations, beside smoothed word counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.score_texts(docs, keep_text=False)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers that cover the same bytes of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_texts(docs, keep_text=False)


@query("op13_source_divergence", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the term shares of each source lie from those of its language and of other sources."""
    return divergence.audit(table(spark, sf_dir, "documents"))
