"""File listings, hashes and sidecar records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.text import likely_data

SIDECAR_NOTICE = "SOURCE.json could not be decoded"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths in order with their size; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return mark_files(files.select("path", "length"))


def mark_files(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.max("length").alias("length")).withColumn(
        "likely_data", likely_data("path")
    ).orderBy("path")


def file_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if("likely_data").alias("data_files"),
        F.sum("length").alias("bytes"),
    )


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every input file."""
    return hash_contents(spark.read.format("binaryFile").load(path))


def hash_contents(files: DataFrame) -> DataFrame:
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar JSON per folder as a string map; damaged text becomes a notice."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_sidecars(texts)


def parse_sidecars(texts: DataFrame) -> DataFrame:
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    good = parsed.isNotNull() & F.trim("value").startswith("{")
    return texts.select(
        "path",
        F.when(good, parsed).otherwise(F.create_map(F.lit("notice"), F.lit(SIDECAR_NOTICE))).alias("metadata"),
    )
