"""Building ways, footprints and their heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions import ring
from relief.functions.core import half_even
from relief.operators import vector
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query
from relief.session import materialise, shuffled
from relief.sources import osm


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = fx.osm_ways(spark, sf_dir)
    rings = vector.way_rings(ways, fx.osm_nodes(spark, sf_dir)).join(
        shuffled(ways.select(F.col("id").alias("osm_id"), "scene_id")), "osm_id"
    )
    return vector.osm_footprints(rings, fx.headers(spark, sf_dir))


@query(
    "osm_ways",
    f"""WITH {fx.DEPTH}, {fx.OSM} SELECT c_custkey AS osm_id, count(*) AS coords, {q6('sum(px)', 4)} AS sum_px, {q6('sum(pos * py)', 3)} AS sum_py
    FROM ring GROUP BY c_custkey""",
)
def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered coordinates of every way, checked back in pixels."""
    from relief.functions.projection import to_mercator

    rings = vector.way_rings(fx.osm_ways(spark, sf_dir), fx.osm_nodes(spark, sf_dir))
    points = rings.select("osm_id", F.inline("coords"))
    x, y = to_mercator(F.col("lon"), F.col("lat"))
    px = (x - 500000.0 - 1000.0 * (F.col("osm_id") % 10)) / 2.0
    py = (2000000.0 - y) / 2.0
    return points.groupBy("osm_id").agg(
        F.count(F.lit(1)).alias("coords"),
        half_even(F.sum(px), 4).alias("sum_px"),
        half_even(F.sum(F.col("pos") * py), 3).alias("sum_py"),
    )


@query(
    "osm_dedupe",
    f"""WITH {fx.DEPTH}, {fx.OSM} SELECT scene_id, c_custkey AS osm_id,
      CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS INTEGER) - 1 AS pos, {q6('u')} AS u, {q6('v')} AS v FROM tidy""",
)
def osm_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _footprints(spark, sf_dir).select("scene_id", "osm_id", F.posexplode("points").alias("pos", "p"))
    return out.select(
        "scene_id", "osm_id", "pos", half_even("p.u", 6).alias("u"), half_even("p.v", 6).alias("v")
    )


@query(
    "osm_levels",
    f"""WITH {fx.DEPTH}, {fx.OSM} SELECT DISTINCT c_custkey AS osm_id, CASE WHEN k4 < 3 THEN lower(c_mktsegment) ELSE 'yes' END AS building_type,
      CASE WHEN k4 = 0 THEN c_name END AS name, CASE k4 WHEN 0 THEN 3e0 WHEN 1 THEN 2.5e0 END AS levels FROM tidy""",
)
def osm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footprints(spark, sf_dir).select("osm_id", "building_type", "name", "levels")


@query(
    "level_texts",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN o_orderkey || '.5' WHEN 2 THEN '.5'
      WHEN 3 THEN '1.2.3' WHEN 4 THEN '-3' ELSE '.' END AS s FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN CAST(s AS DOUBLE) END AS levels FROM t""",
)
def level_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = key % 6
    text = (
        F.when(kind == 0, key.cast("string"))
        .when(kind == 1, F.concat(key, F.lit(".5")))
        .when(kind == 2, ".5")
        .when(kind == 3, "1.2.3")
        .when(kind == 4, "-3")
        .otherwise(".")
    )
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", ring.level_count(text).alias("levels"))


@query(
    "ring_area",
    f"""WITH {fx.DEPTH}, {fx.OSM}, nxt AS (SELECT *, coalesce(lead(u) OVER o, first_value(u) OVER o) AS nu, coalesce(lead(v) OVER o, first_value(v) OVER o) AS nv
      FROM tidy WINDOW o AS (PARTITION BY c_custkey ORDER BY pos))
    SELECT c_custkey AS osm_id, {q6('sum(u * nv - nu * v) * 0.5e0')} AS area FROM nxt GROUP BY 1""",
)
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footprints(spark, sf_dir).select("osm_id", half_even(ring.ring_area("points"), 6).alias("area"))


_UNDER = """vert AS (SELECT scene_id, c_custkey, h, w, CAST(round_even(u * (w - 1), 0) AS INTEGER) AS col, CAST(round_even(v * (h - 1), 0) AS INTEGER) AS "row" FROM tidy),
 under AS (SELECT v.scene_id, c_custkey, any_value(h) AS h, any_value(w) AS w, median(d.depth * 0.5e0) AS base, max(d.depth) AS roof,
  min(v."row") AS r0, max(v."row") AS r1, min(v.col) AS c0, max(v.col) AS c1, avg(v."row") AS rm, avg(v.col) AS cm
  FROM vert v JOIN depth d ON d.scene_id = v.scene_id AND d."row" = v."row" AND d.col = v.col GROUP BY ALL),
 near AS (SELECT u.scene_id, c_custkey, d.depth, d."row", d.col, row_number() OVER (PARTITION BY c_custkey ORDER BY d.depth DESC, d."row", d.col) AS rn
  FROM under u JOIN depth d ON d.scene_id = u.scene_id AND d."row" BETWEEN r0 - 20 AND r1 + 20 AND d.col BETWEEN c0 - 20 AND c1 + 20),
 peak AS (SELECT scene_id, c_custkey, depth AS peak, "row" AS peak_row, col AS peak_col FROM near WHERE rn = 1)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.depth(spark, sf_dir).withColumn("surface", F.col("depth").cast("double"))
    return cells.withColumn("ground", F.col("surface") * 0.5)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, so that Spark broadcasts these few rows and not the footprints beside them
    return materialise(fx.headers(spark, sf_dir).select("scene_id", "width", "height"))


@query(
    "footprint_heights",
    f"""WITH {fx.DEPTH}, {fx.OSM}, {_UNDER} SELECT scene_id, c_custkey AS osm_id, {q6('base')} AS base_height, {q6('roof')} AS roof_height,
      r0 AS row_min, r1 AS row_max, c0 AS col_min, c1 AS col_max FROM under""",
)
def footprint_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _footprints(spark, sf_dir).join(_sizes(spark, sf_dir), "scene_id")
    out = vector.vertex_heights(sized, _cells(spark, sf_dir), "surface", "ground")
    return out.select(
        "scene_id",
        "osm_id",
        half_even("base_height", 6).alias("base_height"),
        half_even("roof_height", 6).alias("roof_height"),
        "row_min",
        "row_max",
        "col_min",
        "col_max",
    )


@query(
    "footprint_peak",
    f"""WITH {fx.DEPTH}, {fx.OSM}, {_UNDER} SELECT scene_id, c_custkey AS osm_id, {q6('peak')} AS peak, peak_row, peak_col FROM peak""",
)
def footprint_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    sized = _footprints(spark, sf_dir).join(sizes, "scene_id")
    cells = _cells(spark, sf_dir)
    under = vector.vertex_heights(sized, cells, "surface", "ground")
    out = vector.footprint_peaks(under.join(sizes, "scene_id"), cells, "surface")
    return out.select("scene_id", "osm_id", half_even("peak", 6).alias("peak"), "peak_row", "peak_col")


_RAISED = """spread AS (SELECT scene_id, greatest((max(depth) - min(depth)) * 0.012e0, 1e-4) AS relief FROM depth GROUP BY scene_id),
 snap AS (SELECT u.*, p.peak, relief, p.peak > roof + 0.015e0 AS higher, (peak_row - rm) / (h - 1) AS dr, (peak_col - cm) / (w - 1) AS dc
  FROM under u JOIN peak p USING (scene_id, c_custkey) JOIN spread USING (scene_id)),
 roofed AS (SELECT *, CASE WHEN higher THEN peak ELSE roof END AS top, higher AND abs(dr * h) <= 30 AND abs(dc * w) <= 30 AS shift FROM snap),
 meta AS (SELECT DISTINCT c_custkey, CASE k4 WHEN 0 THEN 3e0 WHEN 1 THEN 2.5e0 END AS levels FROM refs),
 raised AS (SELECT r.*, CASE WHEN top - base < relief AND levels > 0 THEN base + relief * levels WHEN top - base < relief THEN base + relief * 1.5e0 ELSE top END AS final
  FROM roofed r JOIN meta USING (c_custkey))"""


@query(
    "osm_snap",
    f"""WITH {fx.DEPTH}, {fx.OSM}, {_UNDER}, {_RAISED} SELECT t.scene_id, t.c_custkey AS osm_id,
      CAST(row_number() OVER (PARTITION BY t.c_custkey ORDER BY pos) AS INTEGER) - 1 AS pos,
      {q6('CASE WHEN shift THEN least(1e0, greatest(0e0, u + dc * 0.75e0)) ELSE u END')} AS u,
      {q6('CASE WHEN shift THEN least(1e0, greatest(0e0, v + dr * 0.75e0)) ELSE v END')} AS v, {q6('final')} AS roof_height, {q6('base')} AS base_height
    FROM tidy t JOIN raised r ON r.c_custkey = t.c_custkey""",
)
def osm_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector.raise_footprints(
        materialise(_footprints(spark, sf_dir)), _cells(spark, sf_dir), "surface", "ground", _sizes(spark, sf_dir)
    )
    return out.select("scene_id", "osm_id", "roof_height", "base_height", F.posexplode("points").alias("pos", "p")).select(
        "scene_id",
        "osm_id",
        "pos",
        half_even("p.u", 6).alias("u"),
        half_even("p.v", 6).alias("v"),
        half_even("roof_height", 6).alias("roof_height"),
        half_even("base_height", 6).alias("base_height"),
    )


@query(
    "osm_fallback",
    """WITH o AS (SELECT 's' || c_nationkey || '-' || CAST(floor(abs(c_acctbal)) % 8 AS INTEGER) AS scene_id, c_custkey AS k FROM customer),
     s AS (SELECT 's' || s_nationkey || '-' || (s_suppkey % 8) AS scene_id, s_suppkey AS k FROM supplier), many AS (SELECT scene_id FROM o GROUP BY 1 HAVING count(*) >= 10)
    SELECT scene_id, 'osm' AS source, count(*) AS footprints FROM o WHERE scene_id IN (FROM many) GROUP BY ALL
    UNION ALL SELECT scene_id, 'segmentation', count(*) FROM s WHERE scene_id NOT IN (FROM many) GROUP BY ALL""",
)
def osm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight scenes per nation: customers as mapped footprints, suppliers as segmented ones."""
    share = (F.floor(F.abs("c_acctbal")) % 8).cast("int")
    mapped = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), F.concat_ws("-", "c_nationkey", share)).alias("scene_id"),
        F.lit("osm").alias("source"),
        F.col("c_custkey").alias("osm_id"),
    )
    segmented = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.concat_ws("-", "s_nationkey", F.col("s_suppkey") % 8)).alias("scene_id"),
        F.lit("segmentation").alias("source"),
        F.col("s_suppkey").alias("label"),
    )
    chosen = vector.choose_footprints(mapped, segmented)
    return chosen.groupBy("scene_id", "source").agg(F.count(F.lit(1)).alias("footprints"))


@query(
    "point_in_polygon",
    f"""WITH {fx.DEPTH}, {fx.OSM}, seg AS (SELECT scene_id, c_custkey, u AS xi, v AS yi,
      coalesce(lag(u) OVER o, last_value(u) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS xj,
      coalesce(lag(v) OVER o, last_value(v) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS yj FROM tidy WINDOW o AS (PARTITION BY c_custkey ORDER BY pos)),
     pts AS (SELECT event_id, 's' || (user_id % 10) AS scene_id, (event_id % 997) / 997e0 AS u, (event_id % 613) / 613e0 AS v FROM events),
     crossing AS (SELECT event_id, p.scene_id, c_custkey, count(*) AS n FROM pts p JOIN seg s ON s.scene_id = p.scene_id
      AND (yi > v) <> (yj > v) AND u < (xj - xi) * (v - yi) / (CASE WHEN yj = yi THEN 2.220446049250313e-16 ELSE yj - yi END) + xi GROUP BY ALL)
    SELECT event_id, scene_id, CAST(max(c_custkey % 17) AS DOUBLE) AS roof FROM crossing WHERE n % 2 = 1 GROUP BY ALL""",
)
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("scene_id"),
        (F.col("event_id") % 997 / 997.0).alias("u"),
        (F.col("event_id") % 613 / 613.0).alias("v"),
    )
    prints = _footprints(spark, sf_dir).withColumn("height", (F.col("osm_id") % 17).cast("double"))
    return vector.highest_roof(points, prints, "height", ["event_id", "scene_id"])


@query(
    "osm_cache_key",
    """WITH b AS (SELECT c_custkey, c_nationkey + 0.123456e0 AS lat, c_custkey * 0.01e0 AS lon FROM customer),
     k AS (SELECT c_custkey, substr(sha256(printf('%.5f,%.5f,%.5f,%.5f', lat, lon, lat + 0.01e0, lon + 0.02e0)), 1, 16) AS cache_key FROM b)
    SELECT c_custkey, cache_key, c_custkey % 3 = 0 AS cached FROM k""",
)
def osm_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the scenes is already stored; the rest is still to be loaded."""
    customer = fx.table(spark, sf_dir, "customer")
    lat, lon = F.col("c_nationkey") + 0.123456, F.col("c_custkey") * 0.01
    scenes = customer.select(
        "c_custkey", lat.alias("min_lat"), lon.alias("min_lon"), (lat + 0.01).alias("max_lat"), (lon + 0.02).alias("max_lon")
    )
    bounds = [F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    stored = scenes.where("c_custkey % 3 = 0").select(osm.cache_key(*bounds).alias("cache_key"))
    hit, miss = osm.cached_and_missing(scenes, stored)
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("cached", F.lit(False))).select(
        "c_custkey", "cache_key", "cached"
    )


@query(
    "ways_in_scenes",
    """WITH w AS (SELECT c_custkey AS way_id, c_custkey % 700 * 0.003e0 AS x0, c_nationkey * 0.004e0 AS y0, c_custkey % 700 * 0.003e0 + 0.002e0 AS x1, c_nationkey * 0.004e0 + 0.015e0 AS y1 FROM customer),
     s AS (SELECT 'p' || s_suppkey AS scene_id, s_suppkey * 0.017e0 AS x0, s_nationkey * 0.003e0 AS y0, s_suppkey * 0.017e0 + 0.025e0 AS x1, s_nationkey * 0.003e0 + 0.011e0 AS y1 FROM supplier)
    SELECT scene_id, way_id FROM w JOIN s ON greatest(w.x0, s.x0) <= least(w.x1, s.x1) AND greatest(w.y0, s.y0) <= least(w.y1, s.y1)""",
)
def ways_in_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(x, y, width, height, prefix):
        return [
            x.alias(f"{prefix}min_lon"), y.alias(f"{prefix}min_lat"),
            (x + width).alias(f"{prefix}max_lon"), (y + height).alias(f"{prefix}max_lat"),
        ]

    ways = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("way_id"), *box(F.col("c_custkey") % 700 * 0.003, F.col("c_nationkey") * 0.004, 0.002, 0.015, "w_")
    )
    scenes = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), F.col("s_suppkey")).alias("scene_id"), *box(F.col("s_suppkey") * 0.017, F.col("s_nationkey") * 0.003, 0.025, 0.011, "")
    )
    return osm.ways_in_scenes(ways, scenes)


@query(
    "osm_elements",
    """SELECT 'way' AS kind, c_custkey AS id, 5 AS refs FROM customer
    UNION ALL SELECT 'node', c_custkey * 5 + k, 0 FROM customer, range(4) r(k) WHERE (c_custkey * 5 + k) % 13 <> 0""",
)
def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of documents that overlap: each is in two of them and counts once."""
    nothing = {"nodes": "array<bigint>", "tags": "map<string,string>", "lon": "double", "lat": "double"}

    def elements(df: DataFrame, kind: str) -> DataFrame:
        fields = [F.lit(kind).alias("type"), F.col("id").cast("long").alias("id")]
        for name in ("lon", "lat", "nodes", "tags"):
            value = F.col(name) if name in df.columns else F.lit(None)
            fields.append(value.cast(nothing[name]).alias(name))
        return df.select("id", F.struct(*fields).alias("e"))

    both = elements(fx.osm_nodes(spark, sf_dir), "node").unionByName(elements(fx.osm_ways(spark, sf_dir), "way"))
    document = F.explode(F.array(F.col("id") % 211, F.col("id") % 307 + 1000)).alias("document")
    documents = both.select(document, "e").groupBy("document").agg(F.collect_list("e").alias("elements"))
    nodes, ways = osm.split_elements(documents)
    found = ways.select(F.lit("way").alias("kind"), "id", F.size("nodes").alias("refs"))
    return found.unionByName(nodes.select(F.lit("node").alias("kind"), "id", F.lit(0).alias("refs")))
