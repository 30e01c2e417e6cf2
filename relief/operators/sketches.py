"""A8/A9 by mergeable quantile sketches, where a small error of rank is allowed.

Exact percentiles read a scene twice and count its values. A sketch of fixed
size per block of cells is made in one reading; sketches of blocks merge into
those of scenes, or of any coarser key, and may be stored and merged again by
later runs, which sketch only the blocks that are new. Exact percentiles stay
what the library uses unless a size of sketches is given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relief.functions.core import dbl, is_finite
from relief.operators.grid import BLOCK_COLS, BLOCK_ROWS, SCENE, extent_aggs
from relief.operators.stats import EXTENT, exact_percentiles
from relief.session import materialise
from relief.stores import replace_rows, stored, stored_rows

SIZE = 2048
BLOCK = ("_br", "_bc")


def rank_error(size: int) -> float:
    """Share of all values by which a returned percentile's rank may be off, at 99 % confidence."""
    return 2.296 / size**0.9723


def block_sketches(
    cells: DataFrame, value: Column | str, keys: Sequence[str] = SCENE, where: Column | None = None, size: int = SIZE
) -> DataFrame:
    """One sketch of the finite values per key and block of cells, with count, range and extent.

    A block without a finite value has a count of 0 and a null range; its extent counts.
    """
    ok = is_finite(value) if where is None else is_finite(value) & F.coalesce(where, F.lit(False))
    v = F.when(ok, dbl(value))
    blocks = {"_br": F.expr(f"cast(row div {BLOCK_ROWS} as int)"), "_bc": F.expr(f"cast(col div {BLOCK_COLS} as int)")}
    return (
        cells.withColumns({**blocks, "_v": v})
        .groupBy(*keys, *BLOCK)
        .agg(
            F.kll_sketch_agg_double("_v", size).alias("sketch"),
            F.count("_v").alias("n"),
            F.min("_v").alias("low"),
            F.max("_v").alias("high"),
            *extent_aggs(),
        )
    )


def sketched_percentiles(sketches: DataFrame, probs: Mapping[str, float], keys: Sequence[str] = SCENE) -> DataFrame:
    """Merge sketches per key; the columns are those of `exact_percentiles`.

    A percentile is a value of the key whose rank is off by `rank_error` at most
    of all values; the ends 0 and 1 are the exact range, as are `n`, `low` and `high`.
    """
    merged = sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("_all"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        *[(F.max if c.startswith("n_") else F.min)(c).alias(c) for c in EXTENT],
    )
    ends = {0.0: "low", 1.0: "high"}
    named = [
        (F.col(ends[float(p)]) if float(p) in ends else F.kll_sketch_get_quantile_double("_all", F.lit(float(p)))).alias(n)
        for n, p in probs.items()
    ]
    return merged.where("n > 0").select(*keys, *named, "n", "low", "high", *EXTENT)


def renew_sketches(new: DataFrame, path: str) -> DataFrame:
    """Store sketches by scene: new blocks take the place of their earlier ones, others stay.

    Only scenes of `new` are read and written. Returns all stored sketches of those scenes.
    """
    spark = new.sparkSession
    new = materialise(new)
    scenes = new.select("scene_id").distinct()
    rows = new.withColumn("scene_id", F.col("scene_id").cast("string"))
    if stored(spark, path):
        old = stored_rows(spark, path, only=scenes).select(*rows.columns)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("scene_id", *BLOCK)]
        left = old.alias("o").join(rows.select("scene_id", *BLOCK).alias("m"), same, "left_anti")
        rows = materialise(left.unionByName(rows))
    replace_rows(rows, path)
    return rows


def percentiles(
    cells: DataFrame,
    value: Column | str,
    probs: Mapping[str, float],
    keys: Sequence[str] = SCENE,
    where: Column | None = None,
    sketch: int | None = None,
) -> DataFrame:
    """Exact percentiles, or those of sketches of the given size."""
    if sketch is None:
        return exact_percentiles(cells, value, probs, keys, where)
    return sketched_percentiles(block_sketches(cells, value, keys, where, sketch), probs, keys)
