"""Stored tables in which a later run replaces the rows of its own keys alone.

A table has one partition per key (a scene, or the area of stored map
buildings). Writing overwrites the partitions of the keys at hand and leaves the
others, and a join on the key reads only the partitions it needs. Keys are text;
a null or empty key is stored and read back as null. A table without any key has no schema to read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RUN = "_run"


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _text(key: str) -> Column:
    return F.nullif(F.col(key).cast("string"), F.lit(""))


def _write(df: DataFrame, path: str, key: str, replace: bool) -> None:
    writer = df.write.mode("overwrite" if replace else "errorifexists").partitionBy(key)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_rows(
    df: DataFrame,
    path: str,
    key: str = "scene_id",
    keys: DataFrame | None = None,
    spread: Sequence[Column] = (),
    replace: bool = True,
) -> None:
    """Store `df`, in place of what the table held for its keys and for `keys`.

    A key of `keys` without rows in `df` is stored as present and empty. Every
    row carries the mark of its write, so that such keys are found by reading
    the marks of their partitions; `df` is computed once. `spread` splits the
    rows of a large key over several files. A write that is cut off leaves each
    key whole, with its old or its new rows, and can be run again.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    rows = df.withColumn(key, _text(key)).withColumn(RUN, F.lit(mark))
    _write(rows.repartition(key, *spread), path, key, replace)
    if keys is None:
        return
    named = keys.select(_text(key).alias(key)).distinct()
    marks = T.StructType([T.StructField(n, T.StringType()) for n in (RUN, key)])
    nameless = _read(spark, path, key, None, marks).where(F.col(key).isNull())
    current = _read(spark, path, key, named, marks).unionByName(nameless).where(F.col(RUN) == mark).select(key).distinct()
    bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != key]
    without = named.join(current.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    _write(without.select(key, *bare), path, key, True)


def _read(spark: SparkSession, path: str, key: str, only: DataFrame | None, schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        # the key of a partition is text, whatever its characters look like
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in found])
    rows = spark.read.schema(schema).parquet(path)
    if only is None:
        return rows
    # a comparison on the key lets Spark prune partitions by the keys at run time
    wanted = only.select(F.col(key).cast("string").alias("_key")).where(F.col("_key") > "")
    return rows.join(wanted, F.col(key) == F.col("_key"), "left_semi")


def stored_rows(spark: SparkSession, path: str, key: str = "scene_id", only: DataFrame | None = None) -> DataFrame:
    """Rows of the table, or of the keys in `only`, whose partitions alone are read."""
    return _read(spark, path, key, only).where(F.col(RUN).isNotNull()).drop(RUN)


def stored_keys(spark: SparkSession, path: str, key: str = "scene_id") -> DataFrame:
    """Every key that has been stored, those without rows included."""
    return _read(spark, path, key, None).select(key).distinct()
