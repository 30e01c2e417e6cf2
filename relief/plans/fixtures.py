"""Raster, point and vector views over the driver tables.

Each view exists twice: as a DataFrame and as the CTE text DuckDB runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relief.functions.core import dbl
from relief.functions.solar import as_utc
from relief.functions.projection import from_mercator
from relief.operators.grid import extent, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_rows(
        table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "_row"
    )
    return numbered.select(
        F.concat(F.lit("s"), F.col("label")).alias("scene_id"),
        F.col("_row").cast("int").alias("row"),
        "label",
        "embedding",
    )


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten scenes, 64 columns wide; one row per embedding."""
    return _vectors(spark, sf_dir).select(
        "scene_id", "row", F.posexplode("embedding").alias("col", "depth")
    )


def truth_value(depth_col: Column) -> Column:
    number = F.substring("scene_id", 2, 20).cast("int")
    sign = F.when(number % 2 == 1, -1.0).otherwise(1.0)
    return (
        (100.0 + 8.0 * sign * dbl(depth_col) + 0.005 * F.col("row") + 0.002 * F.col("col"))
    ).cast("float")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth with its ground truth and the truth's mask."""
    return depth(spark, sf_dir).withColumn("value", truth_value(F.col("depth"))).withColumn(
        "valid", ((F.col("row") * 7 + F.col("col") * 3) % 11) != 0
    )


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth averaged on 4x4 blocks: a coarse reference grid."""
    cells = truth(spark, sf_dir)
    value = F.when(F.col("valid"), dbl("value"))
    return cells.groupBy(
        "scene_id", F.expr("cast(row div 4 as int)").alias("row"), F.expr("cast(col div 4 as int)").alias("col")
    ).agg(F.avg(value).cast("float").alias("value"), (F.count(value) > 0).alias("valid"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bytes per cell from the same vector, with the depth alongside."""
    exploded = _vectors(spark, sf_dir).select(
        "scene_id", "row", "embedding", F.posexplode("embedding").alias("col", "depth")
    )

    def band(shift: int) -> Column:
        e = F.element_at("embedding", ((F.col("col") + shift) % 64 + 1).cast("int")).cast("double")
        return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128.0 + 400.0 * e))).cast("smallint")

    return exploded.select(
        "scene_id", "row", "col", band(0).alias("r"), band(21).alias("g"), band(42).alias("b"), "depth"
    )


def gcps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("scene_id"),
        (F.col("l_quantity") + F.col("l_discount")).alias("x"),
        (F.col("l_orderkey") % 40 + F.col("l_tax")).alias("y"),
        (F.col("l_extendedprice") / 1000.0).alias("elevation"),
    )


def gcps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gcps_raw(spark, sf_dir).groupBy("scene_id", "x", "y").agg(F.min("elevation").alias("elevation"))


def sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        as_utc(F.col("ts")).alias("ts"),
        (F.col("user_id") % 120 - 60).cast("double").alias("lat"),
        (F.col("event_id") % 360 - 180).cast("double").alias("lon"),
    )


def osm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners per customer around a cell of its scene; every 13th is missing."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    half = 1.25 + F.floor(F.abs("c_acctbal")) % 3
    corners = F.array(
        *[
            F.struct(F.lit(k).alias("k"), (half * sx).alias("dx"), (half * sy).alias("dy"))
            for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))
        ]
    )
    placed = customer.select("c_custkey", F.inline(corners)).select(
        (F.col("c_custkey") * 5 + F.col("k")).alias("id"),
        (500000.0 + 1000.0 * (F.col("c_custkey") % 10) + 2.0 * (F.col("c_custkey") * 7 % 50 + 6.5 + F.col("dx"))).alias("x"),
        (2000000.0 - 2.0 * (F.col("c_custkey") * 11 % 36 + 4.5 + F.col("dy"))).alias("y"),
    )
    lon, lat = from_mercator(F.col("x"), F.col("y"))
    return placed.where("id % 13 <> 0").select("id", lon.alias("lon"), lat.alias("lat"))


def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed ring per customer, with building tags of varying completeness."""
    customer = table(spark, sf_dir, "customer")
    first = F.col("c_custkey") * 5
    k = F.col("c_custkey") % 4
    levels = F.when(k == 0, "3").when(k == 1, "2.5").when(k == 2, "two")
    tags = F.map_filter(
        F.create_map(
            F.lit("building"), F.when(k < 3, F.lower("c_mktsegment")),
            F.lit("building:levels"), levels,
            F.lit("name"), F.when(k == 0, F.col("c_name")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return customer.select(
        F.concat(F.lit("s"), F.col("c_custkey") % 10).alias("scene_id"),
        F.col("c_custkey").alias("id"),
        F.array(first, first + 1, first + 2, first + 3, first).alias("nodes"),
        tags.alias("tags"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of every scene: 2 m Web Mercator pixels, scenes 1 km apart."""
    size = extent(depth(spark, sf_dir))
    number = F.substring("scene_id", 2, 20).cast("int")
    left = 500000.0 + 1000.0 * number
    return size.select(
        "scene_id",
        F.col("n_cols").alias("width"),
        F.col("n_rows").alias("height"),
        F.lit("EPSG:3857").alias("crs"),
        F.array(F.lit(2.0), F.lit(0.0), left, F.lit(0.0), F.lit(-2.0), F.lit(2000000.0)).alias("transform"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition tags in rotating names and formats, one in ten broken."""
    orders = table(spark, sf_dir, "orders")
    when = F.col("o_orderdate").cast("timestamp") + F.make_interval(
        hours=(F.col("o_orderkey") % 24).cast("int"), mins=(F.col("o_orderkey") % 60).cast("int")
    )
    formats = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'",
               "yyyyMMddHHmmss", "yyyy-MM-dd", "yyyy:MM:dd")
    names = ("TIFFTAG_DATETIME", "AcquisitionDateTime", "ACQUISITION_DATE", "DateTime", "DATE_ACQUIRED", "nitf_idatim")
    text = F.lit(None).cast("string")
    for k, fmt in enumerate(formats):
        text = F.when(F.col("o_orderkey") % 7 == k, F.date_format(when, fmt)).otherwise(text)
    text = F.when(F.col("o_orderkey") % 10 == 9, F.lit("unknown")).otherwise(text)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    # a late tag with another date loses to the one above unless that is last in line
    return orders.select(
        "o_orderkey",
        F.create_map(name, text, F.lit("Nitf_IDatim "), F.lit("20200101000000")).alias("tags"),
    )


# --- DuckDB side -----------------------------------------------------------

EMB = """emb AS (SELECT 's' || label AS scene_id, label,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS "row", embedding
  FROM embeddings)"""
DEPTH = EMB + """, fix_depth AS (SELECT scene_id, label, "row",
  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, unnest(embedding) AS depth32 FROM emb),
 depth AS (SELECT scene_id, label, "row", col, CAST(depth32 AS DOUBLE) AS depth FROM fix_depth)"""
TRUTH = DEPTH + """, truth AS (SELECT *, CAST(100e0 + 8e0 * (CASE WHEN label % 2 = 1 THEN -1e0 ELSE 1e0 END) * depth
  + 0.005e0 * "row" + 0.002e0 * col AS FLOAT) AS value,
  (("row" * 7 + col * 3) % 11) <> 0 AS valid FROM depth)"""
DEM = TRUTH + """, dem AS (SELECT scene_id, CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col,
  CAST(avg(CASE WHEN valid THEN CAST(value AS DOUBLE) END) AS FLOAT) AS value,
  count(CASE WHEN valid THEN 1 END) > 0 AS valid FROM truth GROUP BY 1, 2, 3)"""
RGB = DEPTH + """, band AS (SELECT d.scene_id, d."row", d.col, d.depth,
  CAST(e.embedding[d.col % 64 + 1] AS DOUBLE) AS e0,
  CAST(e.embedding[(d.col + 21) % 64 + 1] AS DOUBLE) AS e1,
  CAST(e.embedding[(d.col + 42) % 64 + 1] AS DOUBLE) AS e2
  FROM depth d JOIN emb e ON e.scene_id = d.scene_id AND e."row" = d."row"),
 rgb AS (SELECT scene_id, "row", col, depth,
  CAST(least(255e0, greatest(0e0, floor(128e0 + 400e0 * e0))) AS INTEGER) AS r,
  CAST(least(255e0, greatest(0e0, floor(128e0 + 400e0 * e1))) AS INTEGER) AS g,
  CAST(least(255e0, greatest(0e0, floor(128e0 + 400e0 * e2))) AS INTEGER) AS b FROM band)"""
GCPS_RAW = """gcps_raw AS (SELECT 's' || (l_suppkey % 10) AS scene_id, l_quantity + l_discount AS x,
  l_orderkey % 40 + l_tax AS y, l_extendedprice / 1000e0 AS elevation FROM lineitem)"""
GCPS = GCPS_RAW + """, gcps AS (SELECT scene_id, x, y, min(elevation) AS elevation
  FROM gcps_raw GROUP BY 1, 2, 3)"""
SUN = """sun AS (SELECT event_id, ts, CAST(user_id % 120 - 60 AS DOUBLE) AS lat,
  CAST(event_id % 360 - 180 AS DOUBLE) AS lon FROM events)"""

# rings in pixel coordinates: projecting there and back changes nothing
OSM = """refs AS (SELECT c_custkey, 's' || (c_custkey % 10) AS scene_id, c_custkey % 4 AS k4, c_mktsegment, c_name, pos,
  c_custkey * 5 + pos % 4 AS node_id, c_custkey * 7 % 50 + 6.5e0 + (1.25e0 + floor(abs(c_acctbal)) % 3) * (CASE WHEN pos % 4 IN (0, 3) THEN -1 ELSE 1 END) AS px,
  c_custkey * 11 % 36 + 4.5e0 + (1.25e0 + floor(abs(c_acctbal)) % 3) * (CASE WHEN pos % 4 < 2 THEN -1 ELSE 1 END) AS py
  FROM customer, range(5) r(pos)),
 kept AS (SELECT * FROM refs WHERE node_id % 13 <> 0),
 ring AS (SELECT k.* FROM kept k JOIN (SELECT c_custkey FROM kept GROUP BY 1 HAVING count(*) >= 4) USING (c_custkey)),
 frame AS (SELECT scene_id, max("row") + 1 AS h, max(col) + 1 AS w FROM depth GROUP BY scene_id),
 unit AS (SELECT r.*, h, w, least(1e0, greatest(0e0, floor(px) / (w - 1))) AS u, least(1e0, greatest(0e0, floor(py) / (h - 1))) AS v
  FROM ring r JOIN frame USING (scene_id)),
 step AS (SELECT *, lag(u) OVER o AS pu, lag(v) OVER o AS pv FROM unit WINDOW o AS (PARTITION BY c_custkey ORDER BY pos)),
 moved AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS seq, count(*) OVER (PARTITION BY c_custkey) AS n,
  first_value(u) OVER o AS fu, first_value(v) OVER o AS fv FROM step WHERE pu IS NULL OR abs(u - pu) > 1e-5 OR abs(v - pv) > 1e-5
  WINDOW o AS (PARTITION BY c_custkey ORDER BY pos)),
 opened AS (SELECT * FROM moved WHERE NOT (seq = n AND n > 1 AND abs(u - fu) <= 1e-5 AND abs(v - fv) <= 1e-5)),
 tidy AS (SELECT o.* EXCLUDE (n), c.n FROM opened o JOIN (SELECT c_custkey, count(*) AS n FROM opened GROUP BY 1 HAVING count(*) >= 3) c USING (c_custkey))"""


def q6(expression: str, digits: int = 6) -> str:
    """Round half to even in DuckDB, the same operations as `half_even`."""
    scale = f"{float(10 ** digits)!r}"
    return f"(round_even(CAST({expression} AS DOUBLE) * CAST({scale} AS DOUBLE), 0) / CAST({scale} AS DOUBLE) + 0e0)"
