"""Neighbourhood filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions import pixel, ramps
from relief.functions.core import dbl, half_even
from relief.operators import diffuse, focal
from relief.operators.grid import attach
from relief.operators.regions import GROUND_RADIUS
from relief.operators.stats import range_stats
from relief.plans import fixtures as fx
from relief.plans.fixtures import q6
from relief.queries.registry import query

CELL = ["scene_id", "row", "col"]


def _frames(radius: int) -> str:
    return (
        f'WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING),'
        f' c AS (PARTITION BY scene_id, col ORDER BY "row" ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)'
    )


def _square(source: str, target: str, columns: dict[str, str], radius: int, fn: str = "sum") -> str:
    """Two CTEs reducing `columns` over a square window, along rows then columns."""
    one = ", ".join(f"{fn}({e}) OVER r AS {n}" for n, e in columns.items())
    two = ", ".join(f"{fn}({n}) OVER c AS {n}" for n in columns)
    return (
        f"{target}_1 AS (SELECT * EXCLUDE ({', '.join(c for c in columns if c.startswith('k_'))}), {one} FROM {source} {_frames(radius)})"
        if any(c.startswith("k_") for c in columns)
        else f"{target}_1 AS (SELECT *, {one} FROM {source} {_frames(radius)})"
    ) + f", {target} AS (SELECT * EXCLUDE ({', '.join(columns)}), {two} FROM {target}_1 {_frames(radius)})"


@query(
    "box_mean",
    f"""WITH {fx.DEPTH}, {_square('depth', 'box', {'s': 'depth', 'n': '1'}, 5)}
    SELECT scene_id, "row", col, {q6('s / n')} AS box_mean, CAST(n AS BIGINT) AS cells FROM box""",
)
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.box_mean(fx.depth(spark, sf_dir), "depth", 5)
    return out.select(*CELL, half_even("box_mean", 6).alias("box_mean"), F.col("box_count").cast("long").alias("cells"))


def _morph(name: str, sql_fn: str, reducer) -> None:
    @query(
        name,
        f"""WITH {fx.DEPTH}, {_square('depth', 'w', {'v': 'depth'}, 3, sql_fn)}
        SELECT scene_id, "row", col, {q6('v')} AS {name} FROM w""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = focal.morphology(fx.depth(spark, sf_dir), "depth", 3, reducer, name)
        return out.select(*CELL, half_even(name, 6).alias(name))


_morph("erosion", "min", F.min)
_morph("dilation", "max", F.max)


@query(
    "ground_opening",
    f"""WITH {fx.DEPTH}, {_square('depth', 'er', {'v': 'depth'}, 8, 'min')},
     {_square('er', 'di', {'g': 'v'}, 8, 'max')}
    SELECT scene_id, "row", col, {q6('g')} AS ground FROM di""",
)
def ground_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.ground_surface(fx.depth(spark, sf_dir), "depth", 8)
    return out.select(*CELL, half_even("ground", 6).alias("ground"))


@query(
    "ground_opening_default",
    f"""WITH {fx.DEPTH}, {_square('depth', 'er', {'v': 'depth'}, 32, 'min')},
     {_square('er', 'di', {'g': 'v'}, 32, 'max')}
    SELECT scene_id, "row", col, {q6('g')} AS ground FROM di""",
)
def ground_opening_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2a at the radius that segmentation uses."""
    out = focal.ground_surface(fx.depth(spark, sf_dir), "depth", GROUND_RADIUS)
    return out.select(*CELL, half_even("ground", 6).alias("ground"))


def _gradient_sql(source: str, target: str, value: str = "v") -> str:
    def diff(window: str) -> str:
        return (
            f"CASE WHEN lag({value}) OVER {window} IS NULL AND lead({value}) OVER {window} IS NULL THEN 0e0 "
            f"WHEN lag({value}) OVER {window} IS NULL THEN lead({value}) OVER {window} - {value} "
            f"WHEN lead({value}) OVER {window} IS NULL THEN {value} - lag({value}) OVER {window} "
            f"ELSE (lead({value}) OVER {window} - lag({value}) OVER {window}) / 2e0 END"
        )

    return (
        f"{target} AS (SELECT *, {diff('r')} AS {value}_dx, {diff('c')} AS {value}_dy FROM {source} "
        'WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY "row"))'
    )


@query(
    "gradient",
    f"""WITH {fx.DEPTH}, v AS (SELECT scene_id, "row", col, depth AS v FROM depth), {_gradient_sql('v', 'g')}
    SELECT scene_id, "row", col, {q6('v_dx')} AS dx, {q6('v_dy')} AS dy, {q6('sqrt(v_dx * v_dx + v_dy * v_dy)')} AS magnitude FROM g""",
)
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.gradient(fx.depth(spark, sf_dir), "depth")
    return out.select(
        *CELL,
        half_even("dx", 6).alias("dx"),
        half_even("dy", 6).alias("dy"),
        half_even(F.hypot("dx", "dy"), 6).alias("magnitude"),
    )


@query(
    "normal_map",
    f"""WITH {fx.TRUTH}, s AS (SELECT scene_id, median(CAST(value AS DOUBLE)) AS fill FROM truth WHERE valid GROUP BY scene_id),
     f AS (SELECT t.scene_id, "row", col, CASE WHEN valid THEN CAST(value AS DOUBLE) ELSE CAST(CAST(fill AS FLOAT) AS DOUBLE) END AS z FROM truth t JOIN s USING (scene_id)),
     m AS (SELECT scene_id, min(z) AS lo, max(z) AS hi FROM f GROUP BY scene_id),
     v AS (SELECT f.scene_id, "row", col, CASE WHEN hi - lo > 1.1920928955078125e-07 THEN (z - lo) / (hi - lo) ELSE z END AS v FROM f JOIN m USING (scene_id)),
     {_gradient_sql('v', 'g')},
     n AS (SELECT *, sqrt((-v_dx * 24e0) * (-v_dx * 24e0) + (-v_dy * 24e0) * (-v_dy * 24e0) + 1e0) AS len FROM g)
    SELECT scene_id, "row", col, CAST(floor(((-v_dx * 24e0) / len * 0.5e0 + 0.5e0) * 255e0) AS INTEGER) AS nr,
      CAST(floor((-((-v_dy * 24e0) / len) * 0.5e0 + 0.5e0) * 255e0) AS INTEGER) AS ng,
      CAST(floor((1e0 / len * 0.5e0 + 0.5e0) * 255e0) AS INTEGER) AS nb FROM n""",
)
def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relief.operators.mesh import normal_map as encode

    return encode(fx.truth(spark, sf_dir), "value", F.col("valid"), 24.0).select(*CELL, "nr", "ng", "nb")


def _guided_sql(guide: str, source: str, radius: int, epsilon: float) -> str:
    """CTEs from a table `gs` with columns g and s to `guided` with column q."""
    first = {"sg": "g", "ss": "s", "sgg": "g * g", "sgs": "g * s", "n": "1e0"}
    return (
        f"{_square('gs', 'm', first, radius)}, "
        f"ab0 AS (SELECT *, (sgs / n - sg / n * (ss / n)) / (sgg / n - sg / n * (sg / n) + {epsilon}) AS a FROM m), "
        f"ab AS (SELECT *, ss / n - a * (sg / n) AS b FROM ab0), "
        f"{_square('ab', 'mab', {'ma': 'a', 'mb': 'b'}, radius)}, "
        f"guided AS (SELECT *, ma / n * g + mb / n AS q FROM mab)"
    )


@query(
    "guided_filter",
    f"""WITH {fx.RGB}, gs AS (SELECT scene_id, "row", col, (r * 0.299e0 + g * 0.587e0 + b * 0.114e0) / 255e0 AS g,
      depth AS s FROM rgb), {_guided_sql('g', 's', 4, 0.001)}
    SELECT scene_id, "row", col, {q6('q')} AS filtered FROM guided""",
)
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.rgb(spark, sf_dir).withColumn("guide", focal.luma() / 255.0)
    out = focal.guided_filter(cells, "guide", "depth", 4, 0.001)
    return out.select(*CELL, half_even("filtered", 6).alias("filtered"))


@query(
    "refine_surface",
    f"""WITH {fx.RGB}, ok AS (SELECT *, (("row" * 7 + col * 3) % 11) <> 0 AS valid FROM rgb),
     s AS (SELECT scene_id, min(depth) AS lo, max(depth) AS hi, median(depth) AS med FROM ok WHERE valid GROUP BY scene_id),
     gs AS (SELECT o.scene_id, "row", col, valid, depth, lo, hi, (r * 0.299e0 + g * 0.587e0 + b * 0.114e0) / 255e0 AS g,
      ((CASE WHEN valid THEN depth ELSE med END) - lo) / (hi - lo) AS s FROM ok o JOIN s USING (scene_id)),
     {_guided_sql('g', 's', 6, 0.001)}
    SELECT scene_id, "row", col, {q6('CASE WHEN valid THEN CAST(CAST(q * (hi - lo) + lo AS FLOAT) AS DOUBLE) ELSE depth END', 5)} AS refined FROM guided""",
)
def refine_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = ((F.col("row") * 7 + F.col("col") * 3) % 11) != 0
    out = focal.refine_with_image(fx.rgb(spark, sf_dir), "depth", ok, radius=6)
    return out.select(*CELL, half_even("refined", 5).alias("refined"))


def _flux(neighbour: str) -> str:
    return f"coalesce(exp(-((({neighbour}) - v) / lim) * ((({neighbour}) - v) / lim)) * (({neighbour}) - v), 0e0)"


def _diffuse_sql(steps: int) -> str:
    out = []
    for k in range(steps):
        source = f"d{k}"
        total = " + ".join(
            _flux(f"{fn}(v) OVER {w}") for fn, w in (("lag", "c"), ("lead", "c"), ("lag", "r"), ("lead", "r"))
        )
        out.append(
            f'd{k + 1} AS (SELECT scene_id, "row", col, lim, v + 0.25e0 * ({total}) AS v FROM {source} '
            'WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY "row"))'
        )
    return ", ".join(out)


@query(
    "diffuse_3steps",
    f"""WITH {fx.DEPTH}, s AS (SELECT scene_id, (max(depth) - min(depth)) * 0.12e0 AS lim FROM depth GROUP BY scene_id),
     d0 AS (SELECT scene_id, "row", col, lim, depth AS v FROM depth JOIN s USING (scene_id)), {_diffuse_sql(3)}
    SELECT scene_id, "row", col, {q6('v')} AS levelled FROM d3""",
)
def diffuse_3steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diffuse.diffuse(fx.depth(spark, sf_dir), "depth", 3, 0.12, storage="double")
    return out.select(*CELL, half_even("levelled", 6).alias("levelled"))


@query("diffuse_80")
def diffuse_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diffuse.diffuse(fx.truth(spark, sf_dir), "value", 80, 0.12, F.col("valid"))
    return out.select(*CELL, "levelled")


def _bilateral_sql() -> str:
    near = {
        "nw": ("lag", "w", 1), "nn": ("lag", "v", 2), "ne": ("lag", "e", 1),
        "sw": ("lead", "w", 1), "ss": ("lead", "v", 2), "se": ("lead", "e", 1),
    }
    weights = [("nw", 1), ("nn", 2), ("ne", 1), ("w", 2), ("v", 4), ("e", 2), ("sw", 1), ("ss", 2), ("se", 1)]
    columns = ", ".join(f"{fn}({c}) OVER c AS {n}" for n, (fn, c, _) in near.items())
    weight = {n: f"{k}e0 * exp(-(({n} - v) * ({n} - v)) / den)" for n, k in weights}
    return (
        'rows_ AS (SELECT *, lag(v) OVER r AS w, lead(v) OVER r AS e FROM b0 WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col)), '
        f'near AS (SELECT *, {columns} FROM rows_ WINDOW c AS (PARTITION BY scene_id, col ORDER BY "row")), '
        f"b1 AS (SELECT *, CASE WHEN nw IS NOT NULL AND se IS NOT NULL AND ne IS NOT NULL AND sw IS NOT NULL THEN "
        f"({' + '.join(f'{n} * {weight[n]}' for n, _ in weights)}) / ({' + '.join(weight[n] for n, _ in weights)}) ELSE v END AS q FROM near)"
    )


@query(
    "bilateral_1pass",
    f"""WITH {fx.DEPTH}, s AS (SELECT scene_id, 2e0 * pow((max(depth) - min(depth)) * 0.06e0, 2) AS den FROM depth GROUP BY scene_id),
     b0 AS (SELECT scene_id, "row", col, den, depth AS v FROM depth JOIN s USING (scene_id)), {_bilateral_sql()}
    SELECT scene_id, "row", col, {q6('q')} AS smoothed FROM b1""",
)
def bilateral_1pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.bilateral(fx.depth(spark, sf_dir), "depth", 1, storage="double")
    return out.select(*CELL, half_even("smoothed", 6).alias("smoothed"))


@query(
    "detrend",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") AS h, max(col) AS w FROM depth GROUP BY scene_id),
     p AS (SELECT d.scene_id, "row", col, depth AS z, col / w - 0.5e0 AS x, "row" / h - 0.5e0 AS y FROM depth d JOIN size USING (scene_id)),
     s AS (SELECT scene_id, (sum(x * z) - sum(x) * sum(z) / count(*)) / sum(x * x) AS sx,
      (sum(y * z) - sum(y) * sum(z) / count(*)) / sum(y * y) AS sy FROM p GROUP BY scene_id)
    SELECT p.scene_id, "row", col, {q6('z - (sx * x + sy * y) * 0.7e0')} AS detrended FROM p JOIN s USING (scene_id)""",
)
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.detrend(fx.depth(spark, sf_dir), "depth", storage="double")
    return out.select(*CELL, half_even("detrended", 6).alias("detrended"))


@query(
    "edge_score",
    f"""WITH {fx.RGB}, s AS (SELECT scene_id, quantile_cont(depth, 0.01) AS lo, quantile_cont(depth, 0.99) AS hi FROM rgb GROUP BY scene_id),
     u AS (SELECT x.scene_id, "row", col, least(1e0, greatest(0e0, (depth - lo) / (hi - lo))) AS d,
      floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0) / 255e0 AS y FROM rgb x JOIN s USING (scene_id)),
     {_gradient_sql('u', 'gd', 'd')}, {_gradient_sql('gd', 'gy', 'y')},
     m AS (SELECT scene_id, CAST(CAST(sqrt(d_dx * d_dx + d_dy * d_dy) AS FLOAT) AS DOUBLE) AS dm, CAST(CAST(sqrt(y_dx * y_dx + y_dy * y_dy) AS FLOAT) AS DOUBLE) AS ym FROM gy),
     q AS (SELECT scene_id, covar_pop(dm, ym) / (stddev_pop(dm) * stddev_pop(ym)) AS r, quantile_cont(dm, 0.95) / median(dm) AS contrast,
      median(ym) AS quiet FROM m GROUP BY scene_id),
     f AS (SELECT m.scene_id, median(dm) AS flat FROM m JOIN q USING (scene_id) WHERE ym <= quiet GROUP BY m.scene_id)
    SELECT scene_id, {q6('r', 4)} AS edge_alignment, {q6('contrast', 3)} AS edge_contrast, {q6('flat', 6)} AS flat_noise
    FROM q JOIN f USING (scene_id)""",
)
def edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.rgb(spark, sf_dir).withColumn("gray", F.floor(focal.luma()))
    return focal.edge_quality(cells, "depth", "gray")


@query(
    "facade_shade",
    f"""WITH {fx.DEPTH}, size AS (SELECT scene_id, max("row") AS h, max(col) AS w, min(depth) AS lo, max(depth) AS hi FROM depth GROUP BY scene_id),
     p AS (SELECT d.*, h, w, hi - lo AS span, CASE WHEN w + 1 >= h + 1 THEN 5.6e0 ELSE 5.6e0 * ((w + 1) / (h + 1)) END AS pw,
      CASE WHEN w + 1 >= h + 1 THEN 5.6e0 / ((w + 1) / (h + 1)) ELSE 5.6e0 END AS pd FROM depth d JOIN size USING (scene_id)),
     e AS (SELECT *, coalesce(lead(depth) OVER r, depth) - coalesce(lag(depth) OVER r, depth) AS dh,
      coalesce(lead(depth) OVER c, depth) - coalesce(lag(depth) OVER c, depth) AS dv FROM p
      WINDOW r AS (PARTITION BY scene_id, "row" ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY "row")),
     k AS (SELECT *, least(1e0, sqrt(pow(dh / span * 0.55e0 / (2e0 * (pw / w)), 2) + pow(dv / span * 0.55e0 / (2e0 * (pd / h)), 2))) AS steep FROM e)
    SELECT scene_id, "row", col, {q6('steep')} AS verticality,
      {q6('least(1e0, greatest(0e0, (steep - 0.35e0) / 0.45e0)) * 0.85e0')} AS amount FROM k""",
)
def facade_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relief.operators.mesh import verticality

    cells = fx.depth(spark, sf_dir)
    stats = range_stats(cells, "depth").drop("n")
    out = verticality(attach(cells, stats, keep_extent=True), "depth", F.col("low"), F.col("high"))
    steep = F.col("verticality")
    # the share of wall colour mixed in, recovered from the red channel
    wall = ramps.hex_to_linear(ramps.WALL_COLOUR)[0]
    amount = (1.0 - ramps.facade_shade(steep)["red"]) / (1.0 - wall)
    return out.select(*CELL, half_even(steep, 6).alias("verticality"), half_even(amount, 6).alias("amount"))


__all__ = ["dbl", "pixel"]
