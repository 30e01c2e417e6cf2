"""Run records, tags, settings and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief import sinks
from relief.functions import text
from relief.functions.core import half_even
from relief.operators import models
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query
from relief.sources import catalog, files, rasters
from relief.streaming import intake


@query(
    "tag_time",
    """WITH t AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS w FROM orders)
    SELECT k AS o_orderkey, CAST(epoch_ms(CASE WHEN k % 10 = 9 THEN NULL WHEN k % 7 >= 5 THEN date_trunc('day', w) + INTERVAL 12 HOUR ELSE w END) // 1000 AS BIGINT) AS acquired FROM t""",
)
def tag_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = fx.tags(spark, sf_dir)
    return tags.select("o_orderkey", F.unix_seconds(text.acquisition_time("tags")).alias("acquired"))


@query(
    "iso_time",
    """WITH t AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS w FROM orders)
    SELECT k AS o_orderkey, CASE k % 5 WHEN 4 THEN NULL WHEN 3 THEN CAST(epoch_ms(date_trunc('day', w)) // 1000 AS BIGINT)
      WHEN 2 THEN CAST(epoch_ms(w) // 1000 - 19800 AS BIGINT) ELSE CAST(epoch_ms(w) // 1000 AS BIGINT) END AS acquired FROM t""",
)
def iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With Z, naive, with an offset, date only, and not a time."""
    k = F.col("o_orderkey")
    when = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))
    base = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")
    written = (
        F.when(k % 5 == 0, F.concat(base, F.lit("Z")))
        .when(k % 5 == 1, base)
        .when(k % 5 == 2, F.concat(base, F.lit("+05:30")))
        .when(k % 5 == 3, F.date_format(when, "yyyy-MM-dd"))
        .otherwise("noon")
    )
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_seconds(text.iso_time(written)).alias("acquired")
    )


@query(
    "settings_check",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'GCP sampling must be ''nearest'' or ''bilinear''' WHEN o_orderkey % 3 = 2 THEN 'quality_mode must be one of fast, quality, got ''ultra''' END AS reason FROM orders""",
)
def settings_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sampling = F.when(k % 4 == 0, " Nearest ").when(k % 4 == 3, "cubic").otherwise("bilinear")
    quality = F.when(k % 3 == 0, "FAST").when(k % 3 == 2, "ultra").otherwise("quality ")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.settings_problem(sampling, quality).alias("reason")
    )


@query(
    "output_basis",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'relative' WHEN 1 THEN 'deployment-dem' WHEN 2 THEN 'deployment-gcp' WHEN 3 THEN 'deployment-shadow' ELSE 'benchmark-fit' END AS output_basis,
      o_orderkey % 5 BETWEEN 1 AND 3 AND o_custkey % 2 = 0 OR o_custkey % 11 = 0 AS held_out FROM orders""",
)
def output_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    modes = ("relative_depth", "reference_dem_calibrated_dsm", "gcp_calibrated_dsm", "shadow_calibrated_dsm", "benchmark_calibrated_dsm")
    mode = F.element_at(F.array(*map(F.lit, modes)), (k + 1).cast("int"))
    held = (k >= 1) & (k <= 3) & (F.col("o_custkey") % 2 == 0)
    points = F.when(held, 100).otherwise(0)
    scope = F.when(F.col("o_custkey") % 11 == 0, "Spatial-Validation").otherwise("same_scene_benchmark_refit")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.output_basis(mode, k > 0, F.lit(False)).alias("output_basis"),
        text.held_out(points, scope, F.array(F.lit("mae"))).alias("held_out"),
    )


@query(
    "file_roles",
    """WITH p AS (SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '/a.CSV' WHEN 1 THEN '/b.json' WHEN 2 THEN '/c.tif' WHEN 3 THEN '/d.NPY' WHEN 4 THEN '/e.jpeg' WHEN 5 THEN '/f.geotiff' ELSE '/g' END AS path, page_id % 7 AS k FROM pages)
    SELECT page_id, CASE WHEN k < 2 THEN 'gcps' ELSE 'reference_dem' END AS role, k IN (2, 4) AS image, k < 4 AS calibration, k IN (2, 5) OR page_id % 2 = 0 AS tiff, k < 5 AS data FROM p""",
)
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    names = ("/a.CSV", "/b.json", "/c.tif", "/d.NPY", "/e.jpeg", "/f.geotiff", "/g")
    path = F.concat("url", F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 7 + 1).cast("int")))
    content = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("49492A0008000000"))).otherwise(F.unhex(F.lit("89504E47")))
    return pages.select(
        "page_id",
        text.file_role(path).alias("role"),
        text.accepted_image(path).alias("image"),
        text.accepted_calibration(path).alias("calibration"),
        text.looks_like_tiff(path, content).alias("tiff"),
        text.likely_data(path).alias("data"),
    )


@query(
    "file_listing",
    """WITH f AS (SELECT source || '/' || lang || CASE WHEN doc_id % 3 = 0 THEN '.csv' ELSE '.txt' END AS path, n_chars FROM documents)
    SELECT path, max(n_chars) AS length, path LIKE '%.csv' AS likely_data FROM f GROUP BY path""",
)
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths in order with their largest size."""
    suffix = F.when(F.col("doc_id") % 3 == 0, ".csv").otherwise(".txt")
    listed = fx.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", suffix).alias("path"), F.col("n_chars").alias("length")
    )
    return files.mark_files(listed)


@query(
    "content_hash",
    "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS length FROM documents",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").alias("content")
    )
    return files.hash_contents(contents).withColumnRenamed("path", "doc_id")


@query(
    "file_totals",
    """WITH f AS (SELECT source || '/' || lang || CASE WHEN doc_id % 3 = 0 THEN '.csv' ELSE '.txt' END AS path, n_chars FROM documents),
     l AS (SELECT path, max(n_chars) AS length FROM f GROUP BY path)
    SELECT count(*) AS file_count, count_if(path LIKE '%.csv')::BIGINT AS data_files, sum(length)::BIGINT AS bytes FROM l""",
)
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_totals(file_listing(spark, sf_dir))


@query(
    "scene_intake",
    """WITH m AS (
      SELECT 'j' || (o_orderkey % 997) AS job_id, 's' || o_orderkey AS scene_id, o_orderdate AS ts,
        CASE WHEN o_orderkey % 11 = 0 THEN 'Supply only one deployment calibration reference: reference_dem or gcps'
             WHEN o_orderkey % 4 = 3 THEN 'GCP sampling must be ''nearest'' or ''bilinear'''
             WHEN o_orderkey % 41 = 0 THEN 'contains no raster pixels' END AS early FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id, early IS NULL ORDER BY ts, scene_id) AS n FROM m)
    SELECT job_id, scene_id, coalesce(early, CASE WHEN n > 1 THEN 'this job has been analysed already' END) AS reason FROM r""",
)
def scene_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 as one batch: every manifest leaves with a reason or is the one served for its job."""
    k = F.col("o_orderkey")
    manifests = fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("j"), (k % 997).cast("string")).alias("job_id"),
        F.concat(F.lit("s"), k.cast("string")).alias("scene_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        (k % 41).cast("int").alias("width"),
        F.lit(10).alias("height"),
        F.when(k % 4 == 3, "cubic").otherwise(" Nearest ").alias("gcp_sampling"),
        F.lit("fast").alias("quality_mode"),
        (k % 11 == 0).alias("has_dem"),
        (k % 11 == 0).alias("has_gcps"),
    )
    return intake.once_per_job(intake.checked_manifests(manifests)).select("job_id", "scene_id", "reason")


@query(
    "sidecars",
    """SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 4 = 3 THEN 'SOURCE.json could not be decoded' END AS notice,
      CASE WHEN event_id % 4 <> 3 THEN regexp_extract(props, '[0-9]+') END AS k FROM events""",
)
def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as sidecar text; every fourth is cut short."""
    broken = F.expr("substring(props, 1, length(props) - 3)")
    texts = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("path"),
        F.when(F.col("event_id") % 4 == 3, broken).otherwise(F.col("props")).alias("value"),
    )
    return files.parse_sidecars(texts).select(
        "path", F.element_at("metadata", "notice").alias("notice"), F.element_at("metadata", "k").alias("k")
    )


@query(
    "model_ranking",
    f"""WITH r AS (SELECT event_type AS model, median(CASE WHEN event_id % 10 <> 0 THEN value END) AS med, count(*) FILTER (event_id % 10 <> 0) AS n FROM events GROUP BY event_type)
    SELECT model, 'completed' AS status, n AS timed_runs, {q6('med')} AS median_seconds FROM r""",
)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as models, values as seconds; every tenth run failed."""
    timings = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.col("event_id").alias("run"),
        F.col("value").alias("seconds"),
        F.when(F.col("event_id") % 10 == 0, "failed").otherwise("completed").alias("status"),
    )
    return models.timing_report(timings)


@query(
    "model_sweep",
    f"""WITH {fx.TRUTH}, m AS (SELECT 'm' || k AS model_id, scene_id, valid, depth + k * 0.1e0 * depth * depth AS x, CAST(value AS DOUBLE) AS y FROM truth, range(3) r(k)),
     p AS (SELECT model_id, scene_id, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS slope FROM m WHERE valid GROUP BY ALL),
     h AS (SELECT m.*, CAST(CAST(slope * x + (my - slope * mx) AS FLOAT) AS DOUBLE) AS h FROM m JOIN p USING (model_id, scene_id) WHERE valid)
    SELECT model_id, scene_id, count(*) AS valid_pixels, {q6('avg(abs(h - y))', 4)} AS mae, {q6('sqrt(avg((h - y) * (h - y)))', 4)} AS rmse FROM h GROUP BY ALL""",
)
def model_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distorted predictions per scene, each refitted and scored."""
    cells = fx.truth(spark, sf_dir)
    d = F.col("depth").cast("double")
    predictions = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.concat(F.lit("m"), F.col("k")).alias("model_id"),
        "scene_id",
        "row",
        "col",
        (d + F.col("k") * 0.1 * d * d).alias("depth"),
    )
    _, metrics = models.sweep(predictions, cells)
    return metrics.select(
        "model_id", "scene_id", "valid_pixels", half_even("mae", 4).alias("mae"), half_even("rmse", 4).alias("rmse")
    )


@query(
    "edge_ranking",
    """WITH s AS (SELECT event_type AS model, round_even(avg(value) / 100e0 * 10000e0, 0) / 10000e0 + 0e0 AS edge_alignment FROM events GROUP BY 1)
    SELECT model, edge_alignment, CAST(row_number() OVER (ORDER BY edge_alignment DESC, model) AS INTEGER) AS "rank" FROM s""",
)
def edge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        half_even(F.avg("value") / 100.0, 4).alias("edge_alignment")
    )
    return models.rank_models(scores)


@query(
    "catalog_bounds",
    f"""WITH c AS (SELECT c_custkey, c_nationkey * 2.5e0 - 20e0 AS lat, c_custkey % 360 - 180e0 AS lon, 100e0 + c_custkey % 900 AS span FROM customer),
     m AS (SELECT *, lon * 20037508.342789244e0 / 180e0 AS x, ln(tan((lat + 90e0) * 3.141592653589793e0 / 360e0)) / (3.141592653589793e0 / 180e0) * 20037508.342789244e0 / 180e0 AS y FROM c)
    SELECT 'c' || c_custkey AS scene_id, {q6('x - span / 2e0', 3)} AS "left", {q6('y + span / 2e0', 3)} AS top, {q6('span / 512e0')} AS pixel FROM m""",
)
def catalog_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scene centres with a span; pixel side from the bounds."""
    centres = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("scene_id"),
        (F.col("c_nationkey") * 2.5 - 20.0).alias("lat"),
        (F.col("c_custkey") % 360 - 180.0).alias("lon"),
        F.lit(512).alias("size"),
        (100.0 + F.col("c_custkey") % 900).alias("span"),
    )
    out = catalog.centred_scenes(centres)
    return out.select(
        "scene_id",
        half_even("bounds.left", 3).alias("left"),
        half_even("bounds.top", 3).alias("top"),
        half_even(F.col("transform")[0], 6).alias("pixel"),
    )


@query(
    "header_pairs",
    f"""WITH {fx.DEM}, a AS (SELECT scene_id, max(col) + 1 AS w, max("row") + 1 AS h FROM depth GROUP BY 1), b AS (SELECT scene_id, max(col) + 1 AS w, max("row") + 1 AS h FROM dem GROUP BY 1)
    SELECT scene_id, CASE WHEN a.w <> b.w OR a.h <> b.h THEN 'dimensions do not match' ELSE 'bounds do not match' END AS reason FROM a JOIN b USING (scene_id)""",
)
def header_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def headers(cells: DataFrame, side: float) -> DataFrame:
        transform = F.array(F.lit(side), F.lit(0.0), F.lit(500000.0), F.lit(0.0), F.lit(-side), F.lit(2000000.0))
        return rasters.header_summary(cells, 1, F.lit("EPSG:3857"), transform)

    return rasters.inconsistent_pairs(headers(fx.depth(spark, sf_dir), 2.0), headers(fx.dem(spark, sf_dir), 8.0))


@query(
    "calibrated_export",
    f"""WITH {fx.TRUTH} SELECT scene_id, "row", col, {q6('CASE WHEN valid THEN CAST(value AS DOUBLE) ELSE -9999e0 END', 3)} AS value, CASE WHEN valid THEN 255 ELSE 0 END AS mask
    FROM truth WHERE label % 2 = 0""",
)
def calibrated_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even scenes are georeferenced; the others have no calibrated export."""
    scenes = fx.headers(spark, sf_dir).withColumn(
        "crs", F.when(F.substring("scene_id", 2, 20).cast("int") % 2 == 0, F.col("crs"))
    ).withColumn("tags", F.create_map(F.lit("SENSOR"), F.lit("camera")))
    calibrations = scenes.select("scene_id", F.lit("ground_truth_dsm").alias("source"), F.lit("ok").alias("status"))
    grid, _ = sinks.calibrated_export(fx.truth(spark, sf_dir), scenes, calibrations, "value")
    return grid.select("scene_id", "row", "col", half_even("value", 3).alias("value"), F.col("mask").cast("int").alias("mask"))


@query(
    "depth_export",
    f"""WITH {fx.TRUTH} SELECT scene_id, count(*) AS cells, count(*) FILTER (NOT valid) AS missing, {q6('sum(CASE WHEN valid THEN depth END)', 4)} AS total FROM truth GROUP BY 1""",
)
def depth_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.depth_export(fx.truth(spark, sf_dir))
    value = F.when(~F.isnan("depth"), F.col("depth").cast("double"))
    return out.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.isnan("depth")).alias("missing"),
        half_even(F.sum(value), 4).alias("total"),
    )


@query(
    "run_documents",
    """SELECT 'o' || o_orderkey AS scene_id, '{"scene_id":"o' || o_orderkey || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"mae":1.5' ELSE '' END || ',"metrics":{"rmse":' || (o_orderkey % 7) || '.25},"notices":["a","b"]}' AS json FROM orders""",
)
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents: a number that is not finite is left out."""
    k = F.col("o_orderkey")
    mae = F.when(k % 3 == 0, 1.5).when(k % 3 == 1, float("nan")).otherwise(float("inf"))
    runs = fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), k).alias("scene_id"),
        mae.alias("mae"),
        F.struct((k % 7 + 0.25).alias("rmse")).alias("metrics"),
        F.array(F.lit("a"), F.lit("b")).alias("notices"),
    )
    return sinks.strict_json(runs)
