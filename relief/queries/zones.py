"""Regions: labelling, measures, rules and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.core import half_even
from relief.operators import components, outlines, regions
from relief.operators.grid import extent_aggs
from relief.operators.stats import range_stats
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query
from relief.session import materialise

CELL = ["scene_id", "row", "col"]
MIN_AREA = 4

# labels by recursive reach, numbered by first cell after the area filter
LABELS = f"""mask AS (SELECT scene_id, "row", col, "row" * 64 + col AS id FROM depth WHERE depth > 0.1e0),
 reach AS (SELECT scene_id, "row", col, id, id AS root FROM mask
  UNION SELECT m.scene_id, m."row", m.col, m.id, r.root FROM reach r JOIN mask m ON m.scene_id = r.scene_id
   AND abs(m."row" - r."row") + abs(m.col - r.col) = 1 AND m."row" BETWEEN r."row" - 1 AND r."row" + 1 AND r.root < m.id),
 rooted AS (SELECT scene_id, "row", col, min(root) AS root FROM reach GROUP BY ALL),
 sizes AS (SELECT scene_id, root, count(*) AS area FROM rooted GROUP BY ALL HAVING count(*) >= {MIN_AREA}),
 numbered AS (SELECT scene_id, root, area, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY root) AS INTEGER) AS label FROM sizes),
 labels AS (SELECT r.scene_id, "row", col, label FROM rooted r JOIN numbered USING (scene_id, root))"""
WITH_LABELS = f"WITH RECURSIVE {fx.RGB}, {LABELS}"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.label_regions(fx.depth(spark, sf_dir).where(F.col("depth").cast("double") > 0.1), MIN_AREA)


@query("region_labels", f"""{WITH_LABELS} SELECT scene_id, "row", col, label FROM labels""")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir)


@query("region_sizes", f"""{WITH_LABELS} SELECT scene_id, label, count(*) AS area FROM labels GROUP BY ALL""")
def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area"))


_PLANE = """m AS (SELECT scene_id, label, avg(col) AS mx, avg("row") AS my, avg(depth) AS mz, var_pop(col) AS xx, var_pop("row") AS yy,
  covar_pop(col, "row") AS xy, covar_pop(col, depth) AS xz, covar_pop("row", depth) AS yz FROM cells GROUP BY ALL),
 p AS (SELECT *, xx * yy - xy * xy AS det, (xx + yy) * (xx + yy) AS tr2 FROM m),
 ab AS (SELECT *, CASE WHEN tr2 = 0 THEN 0e0 WHEN det <= tr2 * 1e-13 THEN (xx * xz + xy * yz) / tr2 ELSE (yy * xz - xy * yz) / det END AS a,
  CASE WHEN tr2 = 0 THEN 0e0 WHEN det <= tr2 * 1e-13 THEN (xy * xz + yy * yz) / tr2 ELSE (xx * yz - xy * xz) / det END AS b FROM p)"""
_CELLS = """cells AS (SELECT l.scene_id, label, "row", col, d.depth, d.r, d.g, d.b FROM labels l JOIN rgb d USING (scene_id, "row", col))"""


def _region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).join(fx.rgb(spark, sf_dir), CELL)


@query(
    "plane_fit",
    f"""{WITH_LABELS}, {_CELLS}, {_PLANE}
    SELECT scene_id, label, {q6('a')} AS plane_a, {q6('b')} AS plane_b, {q6('mz - a * mx - b * my', 5)} AS plane_c FROM ab""",
)
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = regions.plane_fit(_region_cells(spark, sf_dir), "depth")
    return planes.select(
        "scene_id",
        "label",
        half_even("plane_a", 6).alias("plane_a"),
        half_even("plane_b", 6).alias("plane_b"),
        half_even("plane_c", 5).alias("plane_c"),
    )


# axis of each region and its rectangle
_BOX = """mo AS (SELECT scene_id, label, count(*) AS area, avg(col) AS cx, avg("row") AS cy, var_pop(col) AS xx, var_pop("row") AS yy,
  covar_pop(col, "row") AS xy, avg(CASE WHEN g - 0.5e0 * (r + b) > 12e0 AND g > 45 THEN 1e0 ELSE 0e0 END) AS green,
  avg(CASE WHEN b - r > 14 AND b >= CAST(CAST(g * 0.92e0 AS FLOAT) AS DOUBLE) AND g < 165 THEN 1e0 ELSE 0e0 END) AS water FROM cells GROUP BY ALL),
 ax AS (SELECT *, CASE WHEN abs(xy) <= 1e-12 * (xx + yy) THEN (CASE WHEN yy >= xx * (1e0 - 1e-12) THEN 0e0 ELSE 1e0 END) ELSE cos(atan2(2e0 * xy, xx - yy) / 2e0) END AS ux,
  CASE WHEN abs(xy) <= 1e-12 * (xx + yy) THEN (CASE WHEN yy >= xx * (1e0 - 1e-12) THEN 1e0 ELSE 0e0 END) ELSE sin(atan2(2e0 * xy, xx - yy) / 2e0) END AS uy FROM mo),
 pj AS (SELECT c.scene_id, c.label, (col - cx) * ux + ("row" - cy) * uy AS p, ("row" - cy) * ux - (col - cx) * uy AS q FROM cells c JOIN ax USING (scene_id, label)),
 ex AS (SELECT scene_id, label, greatest(1e0, max(p) - min(p) + 1e0) AS s0, greatest(1e0, max(q) - min(q) + 1e0) AS s1 FROM pj GROUP BY ALL),
 box AS (SELECT *, area / (s0 * s1) AS fill, greatest(s0, s1) / greatest(1e0, least(s0, s1)) AS aspect, least(s0, s1) AS min_span FROM ax JOIN ex USING (scene_id, label))"""


@query(
    "pca_rect",
    f"""{WITH_LABELS}, {_CELLS}, {_BOX} SELECT scene_id, label, area, {q6('s0', 4)} AS span_major, {q6('s1', 4)} AS span_minor,
      {q6('fill', 4)} AS fill, {q6('aspect', 4)} AS aspect FROM box""",
)
def pca_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = regions.oriented_boxes(labelled(spark, sf_dir))
    return boxes.select(
        "scene_id", "label", "area", *[half_even(c, 4).alias(c) for c in ("span_major", "span_minor", "fill", "aspect")]
    )


@query(
    "vegetation_fractions",
    f"""{WITH_LABELS}, {_CELLS}, {_BOX} SELECT scene_id, label, {q6('green')} AS green_fraction, {q6('water')} AS water_fraction,
      {q6('fill * (1e0 - 0.65e0 * green - 0.45e0 * water)', 4)} AS confidence FROM box""",
)
def vegetation_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = regions.oriented_boxes(_region_cells(spark, sf_dir), colours=True)
    return boxes.select(
        "scene_id",
        "label",
        half_even("green_fraction", 6).alias("green_fraction"),
        half_even("water_fraction", 6).alias("water_fraction"),
        half_even(regions.confidence(), 4).alias("confidence"),
    )


# rounded so that both engines decide ties alike
_JUDGED = f"""scene AS (SELECT scene_id, max(depth) - min(depth) AS spread, CAST(count(*) AS DOUBLE) AS n FROM rgb GROUP BY scene_id),
 med AS (SELECT scene_id, label, median(depth) AS roof_height, median(depth * 0.5e0) AS base_height FROM cells GROUP BY ALL),
 judged AS (SELECT b.*, roof_height, base_height, CASE WHEN area < {MIN_AREA} THEN 'area' WHEN fill < 0.28e0 THEN 'fill' WHEN aspect > 6.5e0 THEN 'aspect'
  WHEN min_span < 2e0 THEN 'span' WHEN s0 * s1 / n > 0.4e0 AND fill < 0.22e0 THEN 'amorphous' WHEN green > 0.65e0 THEN 'green'
  WHEN s0 * s1 / n > 0.02e0 AND green > 0.48e0 THEN 'large_green' WHEN s0 * s1 / n > 0.02e0 AND water > 0.5e0 THEN 'large_water'
  WHEN roof_height - base_height < greatest(spread * 0.012e0, 1.1920928955078125e-07) THEN 'relief' END AS reason
  FROM box b JOIN med USING (scene_id, label) JOIN scene USING (scene_id))"""


def _judged(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    cells = _region_cells(spark, sf_dir).withColumn("roof", F.col("depth").cast("double"))
    cells = cells.withColumn("ground", F.col("roof") * 0.5)
    scene = range_stats(fx.depth(spark, sf_dir), "depth")
    return regions.judge_regions(cells, scene, True, MIN_AREA, limit, min_span=2.0)


@query(
    "region_rejects",
    f"""{WITH_LABELS}, {_CELLS}, {_BOX}, {_JUDGED} SELECT scene_id, label, area, reason, {q6('roof_height')} AS roof_height,
      {q6('base_height')} AS base_height FROM judged""",
)
def region_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _judged(spark, sf_dir, 500)
    return out.select(
        "scene_id",
        "label",
        "area",
        "reason",
        half_even("roof_height", 6).alias("roof_height"),
        half_even("base_height", 6).alias("base_height"),
    )


@query(
    "top_regions",
    f"""{WITH_LABELS}, {_CELLS}, {_BOX}, {_JUDGED}, ranked AS (SELECT scene_id, label, area,
      CAST(row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, label DESC) AS INTEGER) AS "rank" FROM judged WHERE reason IS NULL)
    SELECT * FROM ranked WHERE "rank" <= 10""",
)
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, 10).where("rank IS NOT NULL").select("scene_id", "label", "area", "rank")


@query("outline_polygons")
def outline_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.region_outlines(labelled(spark, sf_dir))


@query(
    "outline_rings",
    f"""{WITH_LABELS}, sides(d, dr, dc, px, py, qx, qy) AS (VALUES (0, -1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 1, 1, 0, 1), (3, 0, -1, 0, 1, 0, 0)),
     e AS (SELECT l.scene_id, l.label, d, l.col + px AS x0, l."row" + py AS y0, l.col + qx AS x1, l."row" + qy AS y1
      FROM labels l CROSS JOIN sides LEFT JOIN labels o ON o.scene_id = l.scene_id AND o.label = l.label AND o."row" = l."row" + dr AND o.col = l.col + dc
      WHERE o.label IS NULL),
     f AS (SELECT a.*, b.d AS next FROM e a JOIN e b ON b.scene_id = a.scene_id AND b.label = a.label AND b.x0 = a.x1 AND b.y0 = a.y1
      QUALIFY row_number() OVER (PARTITION BY a.scene_id, a.label, a.x0, a.y0, a.d ORDER BY CAST(b.d = (a.d + 1) % 4 AS INTEGER) DESC) = 1),
     start AS (SELECT scene_id, label, min(y0 * 100000 + x0) AS spot FROM e GROUP BY ALL),
     walk AS (SELECT f.*, 0 AS k, 3 AS came, spot FROM f JOIN start b ON f.scene_id = b.scene_id AND f.label = b.label AND y0 * 100000 + x0 = spot
      UNION ALL SELECT f.*, k + 1, w.d, spot FROM walk w JOIN f ON f.scene_id = w.scene_id AND f.label = w.label AND f.x0 = w.x1 AND f.y0 = w.y1 AND f.d = w.next
      WHERE f.y0 * 100000 + f.x0 <> spot)
    SELECT scene_id, label, row_number() OVER (PARTITION BY scene_id, label ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY scene_id, label) AS n,
     CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM walk WHERE d <> came""",
)
def outline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of every region's outer boundary, clockwise from its topmost-left one."""
    return outlines.exterior_corners(labelled(spark, sf_dir))


@query(
    "outline_edges",
    f"""{WITH_LABELS}, sides AS (SELECT l.scene_id, l.label, count(*) * 4 AS total FROM labels l GROUP BY ALL),
     shared AS (SELECT a.scene_id, a.label, count(*) AS inner_sides FROM labels a JOIN labels b ON a.scene_id = b.scene_id AND a.label = b.label
      AND abs(a."row" - b."row") + abs(a.col - b.col) = 1 GROUP BY ALL)
    SELECT s.scene_id, s.label, total - coalesce(inner_sides, 0) AS perimeter, total // 4 AS area FROM sides s LEFT JOIN shared USING (scene_id, label)""",
)
def outline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary length of every region and the area its directed edges enclose."""
    edges = outlines.boundary_edges(labelled(spark, sf_dir))
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    return edges.groupBy("scene_id", "label").agg(
        F.count(F.lit(1)).alias("perimeter"), area.cast("long").alias("area")
    )


@query(
    "ground_replacement",
    f"""{WITH_LABELS}, {_CELLS}, keep AS (SELECT scene_id, label FROM cells GROUP BY ALL HAVING count(*) >= 6)
    SELECT d.scene_id, d."row", d.col, {q6('CASE WHEN k.label IS NOT NULL THEN d.depth * 0.5e0 ELSE d.depth END')} AS surface
    FROM depth d LEFT JOIN labels l ON l.scene_id = d.scene_id AND l."row" = d."row" AND l.col = d.col
    LEFT JOIN keep k ON k.scene_id = l.scene_id AND k.label = l.label""",
)
def ground_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of at least six cells are lowered onto the ground surface."""
    region_cells = materialise(labelled(spark, sf_dir))
    accepted = extent_of_regions(region_cells).where("area >= 6")
    cells = fx.depth(spark, sf_dir).withColumn("surface", F.col("depth").cast("double"))
    cells = cells.withColumn("ground", F.col("surface") * 0.5)
    out = regions.lower_to_ground(cells, region_cells, accepted, "surface")
    return out.select(*CELL, half_even("surface", 6).alias("surface"))


def extent_of_regions(region_cells: DataFrame) -> DataFrame:
    return region_cells.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area"), *extent_aggs())


@query("roof_levelling")
def roof_levelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = regions.level_roofs(fx.truth(spark, sf_dir), "value", F.col("valid"), radius=8, min_area=MIN_AREA)
    return out.select(*CELL, "roofed", "ground")
