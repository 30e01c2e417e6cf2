"""Heights from cast shadows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import dbl
from relief.functions.pixel import shadow_height
from relief.functions.solar import elevation_problem
from relief.operators.grid import attach, extent
from relief.operators.stats import exact_percentiles, exact_percentiles_of, range_stats
from relief.session import materialise

CELL = ("scene_id", "row", "col")

# Darkness percentile, sampling step, shortest run, least evidence.
DARK_PERCENTILE = 0.12
STEP = 4
MIN_RUN = 3
MIN_RUNS = 20
MIN_FRACTION = 0.005
# steps looked ahead per round; later rounds only hold the runs still going
LOOKAHEAD = (4, 16, 64, 256)


def shadow_mask(cells: DataFrame, darkness: float = DARK_PERCENTILE) -> DataFrame:
    """Cells that are dark and, relative to their red, blue.

    The whole image counts; a validity mask is not consulted.
    """
    top = range_stats(cells, F.greatest("r", "g", "b")).select(
        "scene_id", F.when(F.col("high") > 1.5, 255.0).otherwise(1.0).alias("_full"), "n_rows", "n_cols"
    )
    scaled = attach(cells.select(*CELL, "r", "g", "b"), top)
    r, g, b = (dbl(c) / F.col("_full") for c in "rgb")
    toned = scaled.withColumns(
        {"_luma": 0.299 * r + 0.587 * g + 0.114 * b, "_blue": (b + 1e-6) / (r + 1e-6)}
    )
    cuts = exact_percentiles_of(toned, {"luma": "_luma", "blue": "_blue"}, {"dark": darkness, "mid": 0.5})
    judged = attach(toned, cuts.select("scene_id", "luma_dark", "blue_mid", "n_rows", "n_cols"))
    return judged.select(
        *CELL, ((F.col("_luma") <= F.col("luma_dark")) & (F.col("_blue") >= F.col("blue_mid"))).alias("shadow")
    )


def shadow_runs(mask: DataFrame, azimuths: DataFrame) -> DataFrame:
    """Lengths of shadow runs away from the sun, at least three steps long.

    `mask` has shadow per cell; `azimuths` has scene_id and azimuth in degrees.
    Steps are accumulated one by one, so a position is exactly what walking
    gives. Each round joins a bounded number of steps per live run to the mask.
    """
    size = extent(mask)
    away = F.radians(F.pmod(F.col("azimuth") + 180.0, F.lit(360.0)))
    motion = size.join(azimuths.select("scene_id", "azimuth"), "scene_id").select(
        "scene_id",
        F.sin(away).alias("sx"),
        (-F.cos(away)).alias("sy"),
        (F.greatest("n_rows", "n_cols") + 1).cast("long").alias("longest"),
        "n_rows",
        "n_cols",
    )
    dark = materialise(mask.where("shadow").select(*CELL))
    starts = attach(dark.where(f"row % {STEP} = 0 AND col % {STEP} = 0"), motion)
    starts = starts.withColumns({"x": dbl("col"), "y": dbl("row")})
    behind = starts.withColumn("_r", F.rint(F.col("y") - F.col("sy")).cast("int")).withColumn(
        "_c", F.rint(F.col("x") - F.col("sx")).cast("int")
    )
    on_edge = behind.join(
        dark.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c")), ["scene_id", "_r", "_c"], "left_anti"
    )
    live = materialise(
        on_edge.select(*CELL, "x", "y", "sx", "sy", "longest", F.lit(0).cast("long").alias("length"))
    )
    hit = dark.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(True).alias("_hit"))
    done, level = [], 0
    while True:
        ahead = LOOKAHEAD[min(level, len(LOOKAHEAD) - 1)]
        # positions 0..ahead; the last is where the next round starts
        path = F.aggregate(
            F.sequence(F.lit(1), F.lit(ahead)),
            F.array(F.struct("x", "y")),
            lambda acc, _: F.concat(
                acc,
                F.array(
                    F.struct(
                        (F.element_at(acc, -1)["x"] + F.col("sx")).alias("x"),
                        (F.element_at(acc, -1)["y"] + F.col("sy")).alias("y"),
                    )
                ),
            ),
        )
        steps = live.withColumn("_path", path).withColumn("_end", F.element_at("_path", -1))
        steps = steps.select("*", F.posexplode(F.slice("_path", 1, ahead)).alias("_k", "_p")).drop("_path")
        steps = steps.withColumn("_r", F.rint("_p.y").cast("int")).withColumn("_c", F.rint("_p.x").cast("int"))
        walked = steps.join(hit, ["scene_id", "_r", "_c"], "left").groupBy(*CELL).agg(
            F.min(F.when(F.col("_hit").isNull(), F.col("_k"))).alias("_stop"),
            *[F.first(c).alias(c) for c in ("sx", "sy", "longest", "length", "_end")],
        )
        walked = materialise(
            walked.withColumn("length", F.col("length") + F.coalesce("_stop", F.lit(ahead))).withColumn(
                "_going", F.col("_stop").isNull() & (F.col("length") < F.col("longest"))
            )
        )
        done.append(walked.where("NOT _going").select(*CELL, F.least("length", "longest").alias("length")))
        live = walked.where("_going").select(
            *CELL, F.col("_end.x").alias("x"), F.col("_end.y").alias("y"), "sx", "sy", "longest", "length"
        )
        if live.isEmpty():
            break
        level += 1
    runs = done[0]
    for more in done[1:]:
        runs = runs.unionByName(more)
    return runs.where(F.col("length") >= MIN_RUN)


def height_report(
    mask: DataFrame, runs: DataFrame, scenes: DataFrame, min_runs: int = MIN_RUNS
) -> DataFrame:
    """Distribution of shadow heights per scene, or the reason there is none.

    `scenes` has scene_id, elevation (degrees) and pixel_size (metres).
    """
    fraction = mask.groupBy("scene_id").agg(F.avg(F.col("shadow").cast("double")).alias("_fraction"))
    tall = runs.join(materialise(scenes.select("scene_id", "elevation", "pixel_size")), "scene_id").withColumn(
        "_h", shadow_height(dbl("length"), F.col("pixel_size"), F.col("elevation"))
    )
    heights = exact_percentiles(tall, "_h", {"_50": 0.5, "_90": 0.9, "_99": 0.99}).select(
        "scene_id", F.col("n").alias("samples"), "_50", "_90", "_99", F.col("high").alias("_max")
    )
    joined = scenes.join(fraction, "scene_id", "left").join(heights, "scene_id", "left")
    samples = F.coalesce("samples", F.lit(0))
    reason = (
        F.when(F.col("elevation").isNull(), "No solar position for the scene")
        .when(elevation_problem(F.col("elevation")).isNotNull(), elevation_problem(F.col("elevation")))
        .when(F.col("_fraction") < MIN_FRACTION, "Too little shadow detected to estimate heights")
        .when(
            samples < min_runs,
            F.format_string(f"Only %d shadow runs found; need at least {min_runs}", samples),
        )
    )
    usable = F.col("reason").isNull()

    def shown(name: str) -> Column:
        return F.when(usable, F.rint(F.col(name) * 100.0) / 100.0)

    return joined.withColumn("reason", reason).select(
        "scene_id",
        usable.alias("usable"),
        "reason",
        F.when(usable, samples).otherwise(F.lit(0)).cast("long").alias("samples"),
        (F.rint(F.col("_fraction") * 1e4) / 1e4).alias("shadow_fraction"),
        *[shown(c).alias(f"height_{n}") for c, n in (("_50", "p50"), ("_90", "p90"), ("_99", "p99"), ("_max", "max"))],
    )
