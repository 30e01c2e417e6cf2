"""Keys, extents and joins that stay balanced when one scene is huge.

A scene may hold a large share of all cells, so nothing here groups or joins
cells on `scene_id` alone: per-scene values are repeated once per cell block and
joined on (scene, block). A small scene has a single block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relief.session import materialise

BLOCK_ROWS = 256
BLOCK_COLS = 4096
SCENE = ("scene_id",)


def extent(cells: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Grid size per key, from the cells themselves."""
    return cells.groupBy(*keys).agg(*extent_aggs()).drop("row_0", "col_0")


def extent_aggs() -> list[Column]:
    return [
        (F.max("row") + 1).cast("int").alias("n_rows"),
        (F.max("col") + 1).cast("int").alias("n_cols"),
        F.min("row").cast("int").alias("row_0"),
        F.min("col").cast("int").alias("col_0"),
    ]


def attach(
    cells: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = SCENE,
    how: str = "inner",
    keep_extent: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Join per-scene values back onto cells, spread over cell blocks.

    `per_key` carries n_rows and n_cols covering the cells it will meet, and
    row_0 and col_0 when they do not start at the origin. It is written first,
    so Spark knows its real size: it is broadcast when that is small, and
    otherwise joined on a key that splits a hot scene. `stored` says the caller
    has written it already.
    """
    blocks = per_key if stored else materialise(per_key)
    for block, start, end, side in (
        ("_br", "row_0", "n_rows", BLOCK_ROWS),
        ("_bc", "col_0", "n_cols", BLOCK_COLS),
    ):
        first = F.expr(f"cast({start} div {side} as int)") if start in per_key.columns else F.lit(0)
        blocks = blocks.withColumn(
            block, F.explode(F.sequence(first, F.expr(f"cast(({end} - 1) div {side} as int)")))
        )
    blocks = blocks.drop("row_0", "col_0")
    if not keep_extent:
        blocks = blocks.drop("n_rows", "n_cols")
    keyed = cells.withColumn("_br", F.expr(f"row div {BLOCK_ROWS}").cast("int")).withColumn(
        "_bc", F.expr(f"col div {BLOCK_COLS}").cast("int")
    )
    return keyed.join(blocks, [*keys, "_br", "_bc"], how).drop("_br", "_bc")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, alias: str, block: int = 1 << 16
) -> DataFrame:
    """0-based position inside each key by a unique integer column.

    Equivalent to row_number() - 1 but no task sees a whole key: rows are
    numbered inside blocks of the ordering column and shifted by block offsets.
    """
    blocked = df.withColumn("_nb", F.expr(f"`{order}` div {block}"))
    counts = blocked.groupBy(*keys, "_nb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_nb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_nb").orderBy(order)
    return (
        blocked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_nb"])
        .withColumn(alias, F.col("_offset") + F.col("_rn") - 1)
        .drop("_nb", "_rn", "_offset")
    )
