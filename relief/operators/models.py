"""Sweeps over depth models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from relief.functions.core import half_even
from relief.operators.evaluate import benchmark_refit
from relief.operators.stats import exact_percentiles


def timing_report(timings: DataFrame) -> DataFrame:
    """Median seconds of completed runs per model, and the model's status.

    `timings` has model, run, seconds and status. A model without a completed
    run keeps the status of its runs.
    """
    done = F.col("status") == "completed"
    # one model may hold most runs: its median is found by counting, spread by run
    spread = timings.select("model", F.expr("cast(pmod(run, 65536) as int)").alias("row"), F.lit(0).alias("col"), "seconds", "status")
    medians = exact_percentiles(spread, "seconds", {"_median": 0.5}, ["model"], done).select("model", "_median")
    counted = timings.groupBy("model").agg(
        F.count_if(done).alias("timed_runs"),
        F.when(F.bool_or(done), "completed").otherwise(F.max("status")).alias("status"),
    )
    return counted.join(medians, "model", "left").select(
        "model", "status", "timed_runs", half_even("_median", 6).alias("median_seconds")
    )


def rank_models(scores: DataFrame) -> DataFrame:
    """Best edge alignment first, with its rank; models without a score are left out.

    `scores` has one row per model of a sweep, so one window holds them all.
    """
    order = [F.col("edge_alignment").desc(), F.col("model")]
    ranked = scores.where("edge_alignment IS NOT NULL").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.orderBy("rank")


def sweep(predictions: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Benchmark refit of every model on every scene.

    `predictions` has model_id, scene_id, row, col, depth; `truth` value and valid.
    """
    joined = predictions.join(truth.select("scene_id", "row", "col", "value", "valid"), ["scene_id", "row", "col"])
    return benchmark_refit(joined, keys=("model_id", "scene_id"))


def sweep_report(metrics: DataFrame, timings: DataFrame, planned: DataFrame) -> DataFrame:
    """K8: one record per planned model; models that were not run say so."""
    per_model = metrics.groupBy(F.col("model_id").alias("model")).agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.sum("valid_pixels").alias("valid_pixels")
    )
    return (
        planned.select("model")
        .join(timing_report(timings), "model", "left")
        .join(per_model, "model", "left")
        .withColumn("status", F.coalesce("status", F.lit("skipped")))
    )


__all__ = ["rank_models", "sweep", "sweep_report", "timing_report"]
