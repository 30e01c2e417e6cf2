"""The deterministic synthetic scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relief.functions.core import clamp, dbl
from relief.operators.focal import gradient
from relief.operators.grid import attach, extent
from relief.operators.stats import range_stats

DEMO_WIDTH, DEMO_HEIGHT = 256, 176
DEMO_NOTICE = "Precomputed synthetic demonstration fixture — not live model output"


def lattice(spark: SparkSession, width: int = DEMO_WIDTH, height: int = DEMO_HEIGHT, scene_id: str = "demo") -> DataFrame:
    return spark.range(width * height).select(
        F.lit(scene_id).alias("scene_id"),
        F.expr(f"cast(id div {width} as int)").alias("row"),
        F.expr(f"cast(id % {width} as int)").alias("col"),
    )


def demo_terrain(cells: DataFrame, storage: str = "float") -> DataFrame:
    """Hill, ridge and basin over [-1, 1]^2 with truth in metres and a depth of
    negative orientation that carries a structured error."""
    sized = attach(cells, extent(cells), keep_extent=True)
    x = -1.0 + 2.0 * dbl("col") / (F.col("n_cols") - 1)
    y = -1.0 + 2.0 * dbl("row") / (F.col("n_rows") - 1)
    placed = sized.withColumns({"x": x, "y": y})
    x, y = F.col("x"), F.col("y")
    ridge = y - 0.32 * F.sin(2.4 * x)
    raw = (
        0.18 * (1.0 - y)
        + 0.72 * F.exp(-4.5 * ((x + 0.28) * (x + 0.28) + (y + 0.08) * (y + 0.08)))
        + 0.36 * F.exp(-18.0 * ridge * ridge)
        - 0.18 * F.exp(-10.0 * ((x - 0.48) * (x - 0.48) + (y + 0.38) * (y + 0.38)))
    )
    shaped = placed.withColumn("_z", raw).drop("n_rows", "n_cols")
    stats = range_stats(shaped, "_z").drop("n")
    unit = (F.col("_z") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    out = attach(shaped, stats).withColumn("terrain", unit.cast(storage))
    t = dbl("terrain")
    error = 0.028 * F.sin(8.0 * x) * F.cos(5.0 * y)
    return out.select(
        "scene_id",
        "row",
        "col",
        "terrain",
        (132.0 + 86.0 * t).cast(storage).alias("truth"),
        (-(t + error)).cast(storage).alias("depth"),
    )


def demo_scene(spark: SparkSession, width: int = DEMO_WIDTH, height: int = DEMO_HEIGHT) -> DataFrame:
    """Terrain, truth, depth and the shaded colours of the demo scene."""
    shaded = gradient(demo_terrain(lattice(spark, width, height)), "terrain")
    shade = clamp(0.76 - 1.25 * F.col("dx") - 0.9 * F.col("dy"), 0.42, 1.12)
    t = dbl("terrain")
    colours = {"r": 48.0 + t * 133.0, "g": 82.0 + t * 118.0, "b": 58.0 + (1.0 - t) * 85.0}
    return shaded.withColumns(
        {n: F.floor(clamp(c * shade, 0.0, 255.0)).cast("smallint") for n, c in colours.items()}
    ).drop("dx", "dy")
