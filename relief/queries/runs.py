"""What a run leaves besides its grids: masks, previews, summaries, provenance, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief import sinks
from relief.functions import ramps
from relief.functions.core import half_even
from relief.operators import diffuse, mesh, models
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.filters import _flux
from relief.queries.meshes import _SOURCE, _mesh_sql
from relief.queries.pixels import _PREVIEW_SQL, _ramp_sql
from relief.queries.registry import query

CELL = ["scene_id", "row", "col"]


@query(
    "height16_masks",
    f"""WITH {_SOURCE}, {_mesh_sql(80)}
    SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, valid FROM nearest
    WHERE scene_id IN (SELECT scene_id FROM nearest WHERE NOT valid)""",
)
def height16_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: masks of the scenes that have an invalid cell."""
    grid, headers = mesh.height_grid16(fx.truth(spark, sf_dir), "value", F.col("valid"), 80)
    return sinks.height16_tables(grid, headers)[1]


@query(
    "preview_table",
    f"""WITH {fx.TRUTH}, {_PREVIEW_SQL}, r AS (SELECT *, CAST(CAST(u AS FLOAT) AS DOUBLE) AS u6 FROM unit)
    SELECT scene_id, "row", col, {_ramp_sql(1, ramps.PREVIEW_RAMP, 15)} AS red,
      {_ramp_sql(2, ramps.PREVIEW_RAMP, 20)} AS green, {_ramp_sql(3, ramps.PREVIEW_RAMP, 31)} AS blue FROM r""",
)
def preview_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: colours as they are stored."""
    return sinks.preview_table(fx.truth(spark, sf_dir), "depth")


@query(
    "provenance",
    f"""WITH {fx.DEPTH}, s AS (SELECT scene_id, max(col) + 1 AS w, max("row") + 1 AS h, CAST(substr(scene_id, 2) AS INTEGER) * 1000e0 + 500000e0 AS x
      FROM depth GROUP BY scene_id)
    SELECT scene_id, 'CC-BY-4.0' AS license, 'survey' AS attribution, 'EPSG:3857' AS crs, x AS "left", 2000000e0 - 2e0 * h AS bottom,
      x + 2e0 * w AS "right", 2000000e0 AS top, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, 2e0 AS pixel FROM s""",
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence, bounds and header of every scene."""
    t = F.col("transform")
    bounds = F.array(t[2], t[5] + t[4] * F.col("height"), t[2] + t[0] * F.col("width"), t[5])
    rows = sinks.provenance(fx.headers(spark, sf_dir).withColumn("bounds", bounds), "CC-BY-4.0", "survey")
    sides = [F.col("bounds")[k].alias(n) for k, n in enumerate(("left", "bottom", "right", "top"))]
    return rows.select(
        "scene_id", "license", "attribution", "crs", *sides, "raster.width", "raster.height", F.col("raster.transform")[0].alias("pixel")
    )


@query(
    "run_summaries",
    """SELECT 'o' || o_orderkey AS scene_id, 'j' || o_custkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'relative_depth' ELSE 'gcp_calibrated_dsm' END AS mode,
      'gpu' || (o_orderkey % 4) AS device, [o_orderpriority] AS notices FROM orders""",
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed of each run, and nothing else."""
    k = F.col("o_orderkey")
    runs = fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("j"), "o_custkey").alias("job_id"), F.concat(F.lit("o"), k).alias("scene_id"), F.lit(0.5).alias("datum_offset"),
        F.when(k % 2 == 0, "relative_depth").otherwise("gcp_calibrated_dsm").alias("mode"), F.array("o_orderpriority").alias("notices"),
        F.concat(F.lit("gpu"), (k % 4).cast("string")).alias("device"),
    )
    return sinks.run_summary(runs)


@query(
    "sweep_records",
    f"""WITH m AS (SELECT event_type AS model, avg(mae) AS mae, sum(n)::BIGINT AS valid_pixels FROM
       (SELECT event_type, user_id % 9 AS scene, avg(value) AS mae, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1),
     t AS (SELECT event_type AS model, count(*) FILTER (event_id % 5 <> 0) AS timed_runs, median(CAST(value AS DOUBLE)) FILTER (event_id % 5 <> 0) AS s FROM events GROUP BY 1),
     p AS (SELECT DISTINCT event_type AS model FROM events UNION ALL SELECT 'planned only')
    SELECT p.model, CASE WHEN t.model IS NULL THEN 'skipped' ELSE 'completed' END AS status, timed_runs, {q6('s')} AS median_seconds, {q6('mae', 4)} AS mae, valid_pixels
    FROM p LEFT JOIN t ON t.model = p.model LEFT JOIN m ON m.model = p.model""",
)
def sweep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: events as timed runs and scores of their type; one planned model never ran."""
    events = fx.table(spark, sf_dir, "events")
    metrics = events.groupBy(F.col("event_type").alias("model_id"), (F.col("user_id") % 9).alias("scene_id")).agg(
        F.avg("value").alias("mae"), F.avg("value").alias("rmse"), F.count(F.lit(1)).alias("valid_pixels")
    )
    status = F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed")
    timings = events.select(F.col("event_type").alias("model"), F.col("event_id").alias("run"), F.col("value").alias("seconds"), status.alias("status"))
    planned = timings.select("model").distinct().unionByName(spark.createDataFrame([("planned only",)], "model string"))
    out = models.sweep_report(metrics, timings, planned)
    return out.select("model", "status", "timed_runs", "median_seconds", half_even("mae", 4).alias("mae"), "valid_pixels")


def _steps_sql(steps: int) -> str:
    """Diffusion as a chain of tables, each one step on."""
    total = " + ".join(_flux(f"{fn}(v) OVER {w}") for fn, w in (("lag", "c"), ("lead", "c"), ("lag", "r"), ("lead", "r")))
    windows = 'WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY "row")'
    return ", ".join(
        f'd{k + 1} AS MATERIALIZED (SELECT scene_id, "row", col, lim, v + 0.25e0 * ({total}) AS v FROM d{k} {windows})' for k in range(steps)
    )


@query(
    "diffuse_80_steps",
    f"""WITH {fx.TRUTH}, s AS (SELECT scene_id, (max(CAST(value AS DOUBLE)) - min(CAST(value AS DOUBLE))) * 0.12e0 AS lim, median(CAST(value AS DOUBLE)) AS med
      FROM truth WHERE valid GROUP BY scene_id),
     d0 AS (SELECT scene_id, "row", col, lim, CASE WHEN valid THEN CAST(value AS DOUBLE) ELSE med END AS v FROM truth JOIN s USING (scene_id)), {_steps_sql(80)}
    SELECT t.scene_id, t."row", t.col, {q6('CASE WHEN valid THEN v ELSE CAST(value AS DOUBLE) END')} AS levelled
    FROM truth t JOIN d80 d ON d.scene_id = t.scene_id AND d."row" = t."row" AND d.col = t.col""",
)
def diffuse_80_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 with its default number of steps, kept in double precision."""
    out = diffuse.diffuse(fx.truth(spark, sf_dir), "value", 80, 0.12, F.col("valid"), storage="double")
    return out.select(*CELL, half_even("levelled", 6).alias("levelled"))
