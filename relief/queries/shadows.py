"""Sun, shadows and the scale they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions import solar
from relief.functions.core import half_even
from relief.operators import calibrate, shadow
from relief.operators.stats import exact_percentiles
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query
from relief.session import materialise

CELL = ["scene_id", "row", "col"]


def _poly(terms: tuple[float, ...]) -> str:
    lit = [f"CAST({c!r} AS DOUBLE)" for c in terms]
    return reduce(lambda acc, c: f"(({acc}) * t + {c})", reversed(lit[:-1]), lit[-1])


def _mod(a: str, b: str) -> str:
    return f"((({a}) % {b}) + {b}) % {b}"


def solar_sql(source: str) -> str:
    """CTEs from a table (key, ts, lat, lon) to `sun_at` with elevation and azimuth."""
    return f"""s0 AS (SELECT *, CAST(epoch_ms(date_trunc('second', ts)) // 1000 AS DOUBLE) AS sec FROM {source}),
 s1 AS (SELECT *, (sec / 86400e0 + CAST({solar.EPOCH_DAYS!r} AS DOUBLE)) / 36525e0 AS t FROM s0),
 s2 AS (SELECT *, radians({_mod(_poly(solar.MEAN_LONGITUDE), '360e0')}) AS ml, radians({_poly(solar.MEAN_ANOMALY)}) AS ma,
  radians({_poly(solar.NODE)}) AS node, {_poly(solar.ECCENTRICITY)} AS e FROM s1),
 s3 AS (SELECT *, ml + radians(sin(ma) * {_poly(solar.CENTRE_1)} + sin(2e0 * ma) * {_poly(solar.CENTRE_2)} + sin(3e0 * ma) * 0.000289e0
   - 0.00569e0 - 0.00478e0 * sin(node)) AS app,
  radians(23e0 + (26e0 + {_poly(solar.OBLIQUITY_SECONDS)} / 60e0) / 60e0 + 0.00256e0 * cos(node)) AS ob FROM s2),
 s4 AS (SELECT *, asin(sin(ob) * sin(app)) AS dec, pow(tan(ob / 2e0), 2) AS y FROM s3),
 s5 AS (SELECT *, 4e0 * degrees(y * sin(2e0 * ml) - 2e0 * e * sin(ma) + 4e0 * e * y * sin(ma) * cos(2e0 * ml)
   - 0.5e0 * y * y * sin(4e0 * ml) - 1.25e0 * e * e * sin(2e0 * ma)) AS eot FROM s4),
 s6 AS (SELECT *, {_mod('(sec % 86400e0) / 60e0 + eot + 4e0 * lon', '1440e0')} / 4e0 - 180e0 AS hour, radians(lat) AS phi FROM s5),
 s7 AS (SELECT *, acos(least(1e0, greatest(-1e0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(radians(hour))))) AS zen FROM s6),
 s8 AS (SELECT *, 90e0 - degrees(zen) AS elevation, degrees(acos(least(1e0, greatest(-1e0, (sin(phi) * cos(zen) - sin(dec)) / (cos(phi) * sin(zen)))))) AS brg FROM s7),
 sun_at AS (SELECT *, CASE WHEN abs(cos(phi) * sin(zen)) < 1e-9 THEN 180e0 WHEN hour > 0 THEN (brg + 180e0) % 360e0 ELSE (540e0 - brg) % 360e0 END AS azimuth FROM s8)"""


@query(
    "solar_position",
    f"""WITH {fx.SUN}, {solar_sql('sun')} SELECT event_id, {q6('elevation', 3)} AS elevation, {q6('azimuth', 3)} AS azimuth,
      elevation >= 10 AND elevation <= 80 AS usable FROM sun_at""",
)
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    sun = fx.sun(spark, sf_dir).withColumn("p", solar.solar_position(F.col("ts"), F.col("lat"), F.col("lon")))
    return sun.select(
        "event_id",
        half_even("p.elevation", 3).alias("elevation"),
        half_even("p.azimuth", 3).alias("azimuth"),
        F.col("p.usable").alias("usable"),
    )


_MASK = """tone AS (SELECT scene_id, "row", col, 0.299e0 * (r / 255e0) + 0.587e0 * (g / 255e0) + 0.114e0 * (b / 255e0) AS luma,
  (b / 255e0 + 1e-6) / (r / 255e0 + 1e-6) AS blue FROM rgb),
 cut AS (SELECT scene_id, quantile_cont(luma, 0.9) AS dark, median(blue) AS bluish FROM tone GROUP BY scene_id),
 mask AS (SELECT t.scene_id, "row", col, luma <= dark AND blue >= bluish AS shadow FROM tone t JOIN cut USING (scene_id))"""
DARKNESS = 0.9
LEAST_RUNS = 5


@query(
    "shadow_mask",
    f"""WITH {fx.RGB}, {_MASK.replace('0.9)', '0.12)')} SELECT scene_id, "row", col, shadow FROM mask""",
)
def shadow_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadow.shadow_mask(fx.rgb(spark, sf_dir)).select(*CELL, "shadow")


# one instant and place per scene; every fifth scene has the sun too high or low
_SCENES = """scene AS (SELECT DISTINCT scene_id, CAST('2024-06-21 09:00:00' AS TIMESTAMP) AS ts,
  CAST(label % 5 * 10 AS DOUBLE) + 5e0 AS lat, CAST(label * 3 AS DOUBLE) AS lon FROM depth)"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("scene_id", 2, 20).cast("int")
    ids = fx.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), F.col("label")).alias("scene_id")).distinct()
    placed = ids.select(
        "scene_id",
        solar.solar_position(
            F.lit("2024-06-21T09:00:00Z").cast("timestamp"),
            (number % 5 * 10).cast("double") + 5.0,
            (number * 3).cast("double"),
        ).alias("sun"),
    )
    return placed.select("scene_id", "sun.elevation", "sun.azimuth", F.lit(0.5).alias("pixel_size"))


# every start walks until it leaves the mask
_RUNS = f"""move AS (SELECT scene_id, elevation, sin(radians((azimuth + 180e0) % 360e0)) AS sx, -cos(radians((azimuth + 180e0) % 360e0)) AS sy FROM sun_at),
 dark AS (SELECT scene_id, "row", col FROM mask WHERE shadow),
 starts AS (SELECT d.scene_id, d."row", d.col, sx, sy FROM dark d JOIN move USING (scene_id) WHERE d."row" % 4 = 0 AND d.col % 4 = 0
  AND NOT EXISTS (SELECT 1 FROM dark p WHERE p.scene_id = d.scene_id AND p."row" = CAST(round_even(d."row" - sy, 0) AS INTEGER)
   AND p.col = CAST(round_even(d.col - sx, 0) AS INTEGER))),
 walk AS (SELECT scene_id, "row", col, sx, sy, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, 1 AS len FROM starts
  UNION ALL SELECT w.scene_id, w."row", w.col, sx, sy, x + sx, y + sy, len + 1 FROM walk w JOIN dark d ON d.scene_id = w.scene_id
   AND d."row" = CAST(round_even(y + sy, 0) AS INTEGER) AND d.col = CAST(round_even(x + sx, 0) AS INTEGER)),
 runs AS (SELECT scene_id, "row", col, CAST(max(len) AS BIGINT) AS length FROM walk GROUP BY ALL HAVING max(len) >= 3)"""
_WITH_RUNS = f"WITH RECURSIVE {fx.RGB}, {_MASK}, {_SCENES}, {solar_sql('scene')}, {_RUNS}"


@query("shadow_runs", f"""{_WITH_RUNS} SELECT scene_id, "row", col, length FROM runs""")
def shadow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over a generous mask, so that runs of some length exist."""
    mask = shadow.shadow_mask(fx.rgb(spark, sf_dir), DARKNESS)
    return shadow.shadow_runs(mask, _scenes(spark, sf_dir))


_HEIGHTS = f"""high AS (SELECT r.scene_id, length * 0.5e0 * tan(radians(elevation)) AS h FROM runs r JOIN move USING (scene_id)),
 dist AS (SELECT scene_id, count(*) AS n, quantile_cont(h, 0.5) AS p50, quantile_cont(h, 0.9) AS p90, quantile_cont(h, 0.99) AS p99, max(h) AS top FROM high GROUP BY scene_id),
 frac AS (SELECT scene_id, avg(CASE WHEN shadow THEN 1e0 ELSE 0e0 END) AS f FROM mask GROUP BY scene_id),
 why AS (SELECT m.scene_id, coalesce(n, 0) AS n, f, p50, p90, p99, top, CASE WHEN elevation < 10 OR elevation > 80 THEN
   'Solar elevation ' || printf('%.1f', elevation) || ' degrees is outside the 10-80 degree band where shadow length is a reliable height cue'
   WHEN f < 0.005 THEN 'Too little shadow detected to estimate heights'
   WHEN coalesce(n, 0) < 5 THEN 'Only ' || coalesce(n, 0) || ' shadow runs found; need at least 5' END AS reason
  FROM move m JOIN frac USING (scene_id) LEFT JOIN dist USING (scene_id))"""


@query(
    "shadow_heights",
    f"""{_WITH_RUNS}, {_HEIGHTS} SELECT scene_id, reason IS NULL AS usable, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS samples,
      {q6('f', 4)} AS shadow_fraction, CASE WHEN reason IS NULL THEN {q6('p50', 2)} END AS height_p50, CASE WHEN reason IS NULL THEN {q6('p90', 2)} END AS height_p90,
      CASE WHEN reason IS NULL THEN {q6('p99', 2)} END AS height_p99, CASE WHEN reason IS NULL THEN {q6('top', 2)} END AS height_max FROM why""",
)
def shadow_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = materialise(shadow.shadow_mask(fx.rgb(spark, sf_dir), DARKNESS))
    scenes = materialise(_scenes(spark, sf_dir))
    return shadow.height_report(mask, shadow.shadow_runs(mask, scenes), scenes, LEAST_RUNS)


@query(
    "shadow_scale",
    f"""{_WITH_RUNS}, {_HEIGHTS}, dp AS (SELECT scene_id, quantile_cont(depth, 0.05) AS lo, quantile_cont(depth, 0.99) AS hi FROM depth GROUP BY scene_id),
     c AS (SELECT w.scene_id, CASE WHEN reason IS NULL AND {q6('p99', 2)} <= 0.5e0 THEN 'Shadow-derived heights are too small to calibrate against' ELSE reason END AS reason,
      {q6('p99', 2)} / (hi - lo) AS scale, lo, n FROM why w JOIN dp USING (scene_id))
    SELECT scene_id, CASE WHEN reason IS NULL THEN {q6('scale', 4)} END AS scale, CASE WHEN reason IS NULL THEN {q6('-scale * lo', 4)} END AS shift,
      CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status, reason FROM c""",
)
def shadow_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = fx.depth(spark, sf_dir)
    out = calibrate.shadow_scale(exact_percentiles(depth, "depth", {"p05": 0.05, "p99": 0.99}), _report(spark, sf_dir))
    return out.select(
        "scene_id", half_even("scale", 4).alias("scale"), half_even("shift", 4).alias("shift"), "status", "reason"
    )
