"""Per-cell arithmetic with scene statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions import pixel, ramps
from relief.functions.core import dbl, half_even, is_finite
from relief.operators import focal
from relief.operators.grid import attach
from relief.operators.mesh import fill_invalid
from relief.operators.stats import exact_percentiles, range_stats
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query
from relief.sources.demo import demo_terrain as analytic_terrain

CELL = ["scene_id", "row", "col"]


@query(
    "band_stretch",
    f"""WITH {fx.RGB}, long AS (SELECT scene_id, "row", col, 'r' AS band, r AS v FROM rgb
      UNION ALL SELECT scene_id, "row", col, 'g', g FROM rgb UNION ALL SELECT scene_id, "row", col, 'b', b FROM rgb),
     s AS (SELECT scene_id, band, quantile_cont(CAST(v AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.98) AS hi
      FROM long WHERE (("row" * 7 + col * 3) % 11) <> 0 GROUP BY ALL)
    SELECT scene_id, "row", col, band, CAST(CASE WHEN (("row" * 7 + col * 3) % 11) = 0 THEN 0
      ELSE round_even(least(1e0, greatest(0e0, (v - lo) / (hi - lo))) * 255e0, 0) END AS INTEGER) AS level
    FROM long JOIN s USING (scene_id, band)""",
)
def band_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three 16-bit style bands stretched per scene and band."""
    cells = fx.rgb(spark, sf_dir)
    bands = F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in ("r", "g", "b")])
    ok = ((F.col("row") * 7 + F.col("col") * 3) % 11) != 0
    long = cells.select(*CELL, F.inline(bands))
    stats = exact_percentiles(long, "v", {"p_low": 0.02, "p_high": 0.98}, ["scene_id", "band"], ok).drop("n")
    joined = attach(long, stats, ["scene_id", "band"])
    level = pixel.stretch_band("v", ok, F.col("p_low"), F.col("p_high"), F.col("low"), F.col("high"))
    return joined.select(*CELL, "band", level.alias("level"))


_PREVIEW_SQL = """stats AS (SELECT scene_id, quantile_cont(depth, 0.005) AS lo, quantile_cont(depth, 0.995) AS hi
   FROM truth WHERE valid GROUP BY scene_id),
 unit AS (SELECT scene_id, "row", col, valid, CASE WHEN valid THEN
   least(1e0, greatest(0e0, (depth - lo) / (hi - lo))) ELSE 0e0 END AS u FROM truth JOIN stats USING (scene_id))"""


def _preview(cells: DataFrame) -> DataFrame:
    stats = exact_percentiles(cells, "depth", {"p_low": 0.005, "p_high": 0.995}, where=F.col("valid")).drop("n")
    unit = pixel.preview_unit("depth", F.col("valid"), *map(F.col, ("p_low", "p_high", "low", "high")))
    return attach(cells, stats).withColumn("unit", unit)


@query(
    "preview_normalize",
    f"""WITH {fx.TRUTH}, {_PREVIEW_SQL} SELECT scene_id, "row", col, {q6('u')} AS unit FROM unit""",
)
def preview_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preview(fx.truth(spark, sf_dir)).select(*CELL, half_even("unit", 6).alias("unit"))


def _ramp_sql(channel: int, ramp, invalid: int) -> str:
    def at(p: float) -> str:
        return f"CAST(CAST({p} AS FLOAT) AS DOUBLE)"

    cases = "".join(
        f"WHEN u6 < {at(hi[0])} THEN floor({float(hi[channel] - lo[channel])}e0 / ({at(hi[0])} - {at(lo[0])})"
        f" * (u6 - {at(lo[0])}) + {float(lo[channel])}e0) "
        for lo, hi in zip(ramp, ramp[1:])
    )
    return f"CAST(CASE WHEN NOT valid THEN {invalid} {cases}ELSE {ramp[-1][channel]} END AS INTEGER)"


@query(
    "color_ramp",
    f"""WITH {fx.TRUTH}, {_PREVIEW_SQL}, r AS (SELECT *, {q6('u')} AS u6 FROM unit)
    SELECT scene_id, "row", col, {_ramp_sql(1, ramps.PREVIEW_RAMP, 15)} AS red,
      {_ramp_sql(2, ramps.PREVIEW_RAMP, 20)} AS green, {_ramp_sql(3, ramps.PREVIEW_RAMP, 31)} AS blue FROM r""",
)
def color_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _preview(fx.truth(spark, sf_dir))
    colours = ramps.preview_colour(half_even("unit", 6), F.col("valid"))
    return cells.select(*CELL, *[c.alias(n) for n, c in colours.items()])


def _between_sql(channel: int, ramp, rounded: bool) -> str:
    colours = [c[1:] if not isinstance(c[1], str) else ramps.hex_to_linear(c[1]) for c in ramp]
    cases = ""
    for k in range(1, len(ramp)):
        lo, hi = float(colours[k - 1][channel]), float(colours[k][channel])
        body = (
            f"CAST({lo!r} AS DOUBLE) + CAST({hi - lo!r} AS DOUBLE) * ((u6 - CAST({ramp[k - 1][0]!r} AS DOUBLE))"
            f" / CAST({ramp[k][0] - ramp[k - 1][0]!r} AS DOUBLE))"
        )
        cases += f"WHEN u6 > {ramp[k - 1][0]!r} AND u6 <= {ramp[k][0]!r} THEN {body} "
    text = f"CASE {cases}ELSE CAST({float(colours[0][channel])!r} AS DOUBLE) END"
    return f"CAST(floor({text} + 0.5e0) AS INTEGER)" if rounded else q6(text)


@query(
    "viewer_ramps",
    f"""WITH {fx.TRUTH}, {_PREVIEW_SQL}, r AS (SELECT *, {q6('u')} AS u6 FROM unit)
    SELECT scene_id, "row", col, {_between_sql(0, ramps.CANVAS_RAMP, True)} AS canvas_red,
      {_between_sql(1, ramps.CANVAS_RAMP, True)} AS canvas_green, {_between_sql(2, ramps.CANVAS_RAMP, True)} AS canvas_blue,
      {_between_sql(0, ramps.TERRAIN_RAMP, False)} AS terrain_red, {_between_sql(1, ramps.TERRAIN_RAMP, False)} AS terrain_green,
      {_between_sql(2, ramps.TERRAIN_RAMP, False)} AS terrain_blue FROM r""",
)
def viewer_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _preview(fx.truth(spark, sf_dir)).withColumn("u6", half_even("unit", 6))
    canvas = ramps.ramp_between(F.col("u6"), ramps.CANVAS_RAMP, rounded=True)
    terrain = ramps.ramp_between(F.col("u6"), ramps.TERRAIN_RAMP, rounded=False)
    return cells.select(
        *CELL,
        *[c.alias(f"canvas_{n}") for n, c in canvas.items()],
        *[half_even(c, 6).alias(f"terrain_{n}") for n, c in terrain.items()],
    )


@query(
    "unit_normalize",
    f"""WITH {fx.DEPTH}, s AS (SELECT scene_id, quantile_cont(depth, 0.01) AS lo, quantile_cont(depth, 0.99) AS hi
      FROM depth GROUP BY scene_id)
    SELECT scene_id, "row", col, {q6('CASE WHEN hi > lo THEN least(1e0, greatest(0e0, (depth - lo) / (hi - lo))) ELSE 0e0 END')} AS unit
    FROM depth JOIN s USING (scene_id)""",
)
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.depth(spark, sf_dir)
    stats = exact_percentiles(cells, "depth", {"p_low": 0.01, "p_high": 0.99}).drop("n", "low", "high")
    return attach(cells, stats).select(
        *CELL, half_even(focal.percentile_unit("depth", "p_low", "p_high"), 6).alias("unit")
    )


_RANGE_SQL = """range AS (SELECT scene_id, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi
  FROM truth GROUP BY scene_id),
 coded AS (SELECT t.scene_id, "row", col, lo, hi, CAST(CASE WHEN hi - lo <= 1.1920928955078125e-07 THEN 0 ELSE
  round_even(least(1e0, greatest(0e0, (CAST(value AS DOUBLE) - lo) / (hi - lo))) * 65535e0, 0) END AS INTEGER) AS q
  FROM truth t JOIN range USING (scene_id))"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.truth(spark, sf_dir)
    stats = range_stats(cells, "value").drop("n")
    return attach(cells, stats).withColumn("q", pixel.quantise16("value", F.col("low"), F.col("high")))


@query("quantize16", f"""WITH {fx.TRUTH}, {_RANGE_SQL} SELECT scene_id, "row", col, q FROM coded""")
def quantize16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select(*CELL, "q")


@query(
    "dequantize",
    f"""WITH {fx.TRUTH}, {_RANGE_SQL}
    SELECT scene_id, "row", col, {q6('lo + (q // 256) / 255e0 * (hi - lo)')} AS value8,
      {q6('lo + q / 65535e0 * (hi - lo)')} AS value16 FROM coded""",
)
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    return _coded(spark, sf_dir).select(
        *CELL,
        half_even(pixel.dequantise(pixel.high_byte("q"), low, high), 6).alias("value8"),
        half_even(pixel.dequantise("q", low, high, 65535.0), 6).alias("value16"),
    )


@query(
    "luma",
    f"""WITH {fx.RGB}, l AS (SELECT *, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS y FROM rgb),
     m AS (SELECT scene_id, max(y) AS top FROM l GROUP BY scene_id)
    SELECT scene_id, "row", col, {q6('CASE WHEN top > 1.5 THEN y / 255e0 ELSE y END')} AS guide FROM l JOIN m USING (scene_id)""",
)
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.rgb(spark, sf_dir).withColumn("y", focal.luma())
    stats = range_stats(cells, "y").select("scene_id", "high", "n_rows", "n_cols")
    guide = F.when(F.col("high") > 1.5, F.col("y") / 255.0).otherwise(F.col("y"))
    return attach(cells, stats).select(*CELL, half_even(guide, 6).alias("guide"))


@query(
    "fill_median",
    f"""WITH {fx.TRUTH}, s AS (SELECT scene_id, median(CAST(value AS DOUBLE)) AS fill FROM truth WHERE valid GROUP BY scene_id)
    SELECT scene_id, "row", col, {q6('CAST(CAST(CASE WHEN valid THEN CAST(value AS DOUBLE) ELSE fill END AS FLOAT) AS DOUBLE)', 4)} AS filled
    FROM truth JOIN s USING (scene_id)""",
)
def fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.truth(spark, sf_dir)
    return fill_invalid(cells, "value", F.col("valid")).select(*CELL, half_even(dbl("filled"), 4).alias("filled"))


@query(
    "absolute_error",
    f"""WITH {fx.TRUTH} SELECT scene_id, "row", col, valid,
      {q6('CASE WHEN valid THEN CAST(CAST(abs(CAST(CAST(100e0 + 8e0 * depth AS FLOAT) AS DOUBLE) - CAST(value AS DOUBLE)) AS FLOAT) AS DOUBLE) END')} AS abs_error FROM truth""",
)
def absolute_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relief.operators.calibrate import residual_columns

    cells = fx.truth(spark, sf_dir).withColumn("height", (100.0 + 8.0 * dbl("depth")).cast("float"))
    _, error = residual_columns(F.col("height"), F.col("value"), F.col("valid"))
    return cells.select(*CELL, "valid", half_even(F.when(is_finite(error), error), 6).alias("abs_error"))


@query(
    "size_guard",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") + 1 AS height, max(col) + 1 AS width FROM depth GROUP BY scene_id)
    SELECT scene_id, width, height, CASE WHEN width * height > 3200 THEN 'has ' || format('{{:,}}', width * height)
      || ' decoded pixels; the configured limit is 3,200' END AS reason FROM size""",
)
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = fx.depth(spark, sf_dir).groupBy("scene_id").agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )
    return size.select(
        "scene_id", "width", "height", pixel.decoded_size_problem(F.col("width"), F.col("height"), 3200).alias("reason")
    )


@query(
    "vegetation_cells",
    f"""WITH {fx.RGB} SELECT scene_id, count(*) AS cells,
      count(*) FILTER (g - 0.5e0 * (r + b) > 12e0 AND g > 45) AS green_cells,
      count(*) FILTER (b - r > 14 AND b >= CAST(CAST(g * 0.92e0 AS FLOAT) AS DOUBLE) AND g < 165) AS water_cells
      FROM rgb GROUP BY scene_id""",
)
def vegetation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.rgb(spark, sf_dir).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(pixel.vegetation("r", "g", "b")).alias("green_cells"),
        F.count_if(pixel.water("r", "g", "b")).alias("water_cells"),
    )


@query(
    "demo_terrain",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") AS h, max(col) AS w FROM depth GROUP BY scene_id),
     p AS (SELECT d.scene_id, "row", col, -1e0 + 2e0 * col / w AS x, -1e0 + 2e0 * "row" / h AS y FROM depth d JOIN size USING (scene_id)),
     t AS (SELECT *, 0.18e0 * (1e0 - y) + 0.72e0 * exp(-4.5e0 * ((x + 0.28e0) * (x + 0.28e0) + (y + 0.08e0) * (y + 0.08e0)))
       + 0.36e0 * exp(-18e0 * (y - 0.32e0 * sin(2.4e0 * x)) * (y - 0.32e0 * sin(2.4e0 * x)))
       - 0.18e0 * exp(-10e0 * ((x - 0.48e0) * (x - 0.48e0) + (y + 0.38e0) * (y + 0.38e0))) AS z FROM p),
     m AS (SELECT scene_id, min(z) AS lo, max(z) AS hi FROM t GROUP BY scene_id),
     u AS (SELECT t.scene_id, "row", col, x, y, (z - lo) / greatest(hi - lo, 1e-6) AS terrain FROM t JOIN m USING (scene_id))
    SELECT scene_id, "row", col, {q6('terrain')} AS terrain, {q6('132e0 + 86e0 * terrain', 4)} AS truth,
      {q6('-(terrain + 0.028e0 * sin(8e0 * x) * cos(5e0 * y))')} AS depth FROM u""",
)
def demo_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytic terrain on every scene's own lattice."""
    out = analytic_terrain(fx.depth(spark, sf_dir).select(*CELL), storage="double")
    return out.select(
        *CELL,
        half_even("terrain", 6).alias("terrain"),
        half_even("truth", 4).alias("truth"),
        half_even("depth", 6).alias("depth"),
    )
