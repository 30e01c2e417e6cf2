"""Affine fits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.core import half_even
from relief.operators import calibrate, evaluate
from relief.operators.grid import extent
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query

# one fit per scene, shared by the SQL statements below
_MOMENTS = """SELECT scene_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy,
  covar_pop(x, y) AS cxy FROM samples GROUP BY scene_id"""
FIT = f"""moments AS ({_MOMENTS}),
 corr AS (SELECT *, CASE WHEN n >= 2 AND sqrt(n * vx * n * vy) > 2.220446049250313e-16
   THEN least(1e0, greatest(-1e0, n * cxy / sqrt(n * vx * n * vy))) END AS raw_r FROM moments),
 oriented AS (SELECT *, CASE WHEN -raw_r > raw_r THEN -1e0 ELSE 1e0 END AS sgn FROM corr),
 fit AS (SELECT scene_id, n, sgn, raw_r, sgn * cxy / vx AS scale, my - sgn * cxy / vx * sgn * mx AS shift FROM oriented)"""
TRUTH_SAMPLES = "samples AS (SELECT scene_id, depth AS x, CAST(value AS DOUBLE) AS y FROM truth WHERE valid)"
SCORED = f"""heights AS (SELECT t.*, CAST(f.scale * (t.depth * f.sgn) + f.shift AS FLOAT) AS height
  FROM truth t JOIN fit f USING (scene_id)),
 pairs AS (SELECT scene_id, valid, CASE WHEN valid THEN CAST(height AS DOUBLE) END AS h,
  CASE WHEN valid THEN CAST(value AS DOUBLE) END AS t FROM heights),
 scored AS (SELECT scene_id, count(h) AS valid_pixels, count(*) AS total_pixels, avg(abs(h - t)) AS mae,
  sqrt(avg((h - t) * (h - t))) AS rmse, covar_pop(h, t) / sqrt(var_pop(h) * var_pop(t)) AS pearson
  FROM pairs GROUP BY scene_id)"""


def _fit_columns() -> list:
    return [
        "scene_id",
        "orientation",
        half_even("scale", 5).alias("scale"),
        half_even("shift", 5).alias("shift"),
        "reference_samples",
        "status",
    ]


@query(
    "affine_fit",
    f"""WITH {fx.TRUTH}, {TRUTH_SAMPLES}, {FIT}
    SELECT scene_id, CASE WHEN sgn < 0 THEN 'negative_depth' ELSE 'depth' END AS orientation,
      {q6('scale', 5)} AS scale, {q6('shift', 5)} AS shift, n AS reference_samples, 'ok' AS status FROM fit""",
)
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.truth(spark, sf_dir).where("valid")
    return calibrate.fit_affine(cells, "depth", "value").select(*_fit_columns())


_METRICS = ["valid_fraction", "pearson", "mae", "rmse"]


@query(
    "benchmark_eval",
    f"""WITH {fx.TRUTH}, {TRUTH_SAMPLES}, {FIT}, {SCORED}
    SELECT scene_id, 'same_scene_benchmark_refit' AS evaluation_scope, true AS calibration_refit, valid_pixels,
      total_pixels, {q6('valid_pixels / total_pixels')} AS valid_fraction, {q6('pearson')} AS pearson,
      {q6('mae')} AS mae, {q6('rmse')} AS rmse, {q6('raw_r')} AS raw_pearson, {q6('-raw_r')} AS negative_pearson,
      {q6('sgn * raw_r')} AS relative_pearson FROM scored JOIN fit USING (scene_id)""",
)
def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = evaluate.benchmark_refit(fx.truth(spark, sf_dir))
    rounded = [*_METRICS, "raw_pearson", "negative_pearson", "relative_pearson"]
    return metrics.select(
        *[half_even(c, 6).alias(c) if c in rounded else F.col(c) for c in metrics.columns]
    )


@query(
    "holdout_eval",
    f"""WITH {fx.DEM}, samples AS (SELECT t.scene_id, t.depth AS x, CAST(d.value AS DOUBLE) AS y FROM truth t
      JOIN dem d ON d.scene_id = t.scene_id AND d."row" = t."row" // 4 AND d.col = t.col // 4 WHERE d.valid), {FIT}, {SCORED}
    SELECT scene_id, 'holdout_fixed_calibration' AS evaluation_scope, false AS calibration_refit, valid_pixels,
      total_pixels, {q6('valid_pixels / total_pixels')} AS valid_fraction, {q6('pearson')} AS pearson,
      {q6('mae')} AS mae, {q6('rmse')} AS rmse FROM scored""",
)
def holdout_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients from the coarse reference grid, scored on every valid cell."""
    cells = fx.truth(spark, sf_dir)
    coarse = fx.dem(spark, sf_dir).where("valid").select(
        "scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("elevation")
    )
    blocks = cells.withColumn("_r", F.expr("cast(row div 4 as int)")).withColumn("_c", F.expr("cast(col div 4 as int)"))
    reference = blocks.join(coarse, ["scene_id", "_r", "_c"])
    fits = calibrate.fit_affine(reference, "depth", "elevation", source="reference_dem")
    heights = calibrate.apply_affine(cells, fits, extent(cells))
    metrics = evaluate.score(heights)
    return metrics.select(*[half_even(c, 6).alias(c) if c in _METRICS else F.col(c) for c in metrics.columns])


@query(
    "pearson_guarded",
    f"""WITH {fx.TRUTH}, samples AS (SELECT scene_id || '-' || ("row" // 8) AS scene_id, depth AS x,
      CASE WHEN label = 3 THEN 5e0 ELSE CAST(value AS DOUBLE) END AS y FROM truth WHERE valid), {FIT}
    SELECT scene_id AS strip, n, {q6('raw_r')} AS pearson FROM fit""",
)
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of eight rows; one scene has constant truth and so no correlation."""
    cells = fx.truth(spark, sf_dir).where("valid")
    strip = F.concat("scene_id", F.lit("-"), F.expr("row div 8"))
    value = F.when(F.col("scene_id") == "s3", F.lit(5.0)).otherwise(F.col("value").cast("double"))
    out = calibrate.correlation(cells.withColumn("strip", strip), F.col("depth"), value, ["strip"])
    return out.select("strip", "n", half_even("pearson", 6).alias("pearson"))


@query(
    "datum_offset",
    f"""WITH {fx.TRUTH}, diff AS (SELECT scene_id, CAST(CAST(value AS FLOAT) - CAST(8e0 * depth AS FLOAT) AS FLOAT) AS d
      FROM truth WHERE valid)
    SELECT scene_id, count(*) AS n, {q6('quantile_cont(CAST(d AS DOUBLE), 0.5)', 3)} AS datum_offset
    FROM diff GROUP BY scene_id HAVING count(*) >= 64""",
)
def datum_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.truth(spark, sf_dir).withColumn("height", (F.col("depth").cast("double") * 8.0).cast("float"))
    out = evaluate.datum_offset(cells)
    return out.select("scene_id", "n", half_even("datum_offset", 3).alias("datum_offset"))


@query(
    "exact_percentiles",
    f"""WITH {fx.TRUTH}
    SELECT scene_id, count(*) AS n, {q6('min(depth)')} AS low, {q6('max(depth)')} AS high,
      {q6('quantile_cont(depth, 0.02)')} AS p02, {q6('quantile_cont(depth, 0.5)')} AS p50,
      {q6('quantile_cont(depth, 0.98)')} AS p98 FROM truth WHERE valid GROUP BY scene_id""",
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relief.operators.stats import exact_percentiles as percentiles

    out = percentiles(
        fx.truth(spark, sf_dir), "depth", {"p02": 0.02, "p50": 0.5, "p98": 0.98}, where=F.col("valid")
    )
    return out.select(
        "scene_id", "n", *[half_even(c, 6).alias(c) for c in ("low", "high", "p02", "p50", "p98")]
    )


SKETCH = 512
_SHARES = {"p02": 0.02, "p50": 0.5, "p98": 0.98}


@query(
    "sketched_percentiles",
    f"""WITH {fx.TRUTH}
    SELECT scene_id, count(*) AS n, {q6('min(depth)')} AS low, {q6('max(depth)')} AS high,
      {', '.join(f'TRUE AS {name}_near' for name in _SHARES)} FROM truth WHERE valid GROUP BY scene_id""",
)
def sketched_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of every sketched percentile, counted over all cells, is within four times the bound."""
    from relief.operators.grid import attach
    from relief.operators.sketches import block_sketches, rank_error, sketched_percentiles as merged

    cells = fx.truth(spark, sf_dir).where("valid")
    found = merged(block_sketches(cells, "depth", size=SKETCH), _SHARES)
    ranked = attach(cells, found).groupBy("scene_id", "n", "low", "high").agg(
        *[
            F.sum((F.col("depth").cast("double") <= F.col(name)).cast("double")).alias(name) for name in _SHARES
        ]
    )
    off = 4 * rank_error(SKETCH)
    return ranked.select(
        "scene_id",
        "n",
        *[half_even(c, 6).alias(c) for c in ("low", "high")],
        *[(F.abs(F.col(name) / F.col("n") - p) <= off).alias(f"{name}_near") for name, p in _SHARES.items()],
    )
