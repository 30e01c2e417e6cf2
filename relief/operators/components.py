"""4-connected regions of a mask, numbered by their first cell.

Cells are labelled inside tiles, tile regions that touch across a border become
graph edges, and the graph is contracted by alternating star rounds. Each round
is written to the shared folder. No step sees more than a tile or a vertex's
minimum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relief.operators.grid import number_rows
from relief.session import materialise

TILE_SIDE = 512
# a cell's raster position as one sortable number
_STRIDE = 1 << 31


def _tile_roots(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """First raster position of each cell's region within one tile."""
    position = rows.astype(np.int64) * _STRIDE + cols
    order = np.argsort(position, kind="stable")
    key = position[order]
    # horizontal runs, then edges between runs that touch vertically
    run = np.cumsum(np.concatenate(([0], (np.diff(key) != 1).astype(np.int64))))
    below = np.searchsorted(key, key + _STRIDE)
    below = np.minimum(below, len(key) - 1)
    hit = key[below] == key + _STRIDE
    edges = np.unique(np.stack([run[hit], run[below[hit]]], axis=1), axis=0)
    upper, lower = edges[:, 0], edges[:, 1]
    leader = np.arange(run[-1] + 1)
    while len(edges) and not np.array_equal(leader[upper], leader[lower]):
        least = np.minimum(leader[upper], leader[lower])
        np.minimum.at(leader, leader[upper], least)
        np.minimum.at(leader, leader[lower], least)
        jumped = leader[leader]
        while not np.array_equal(jumped, leader):
            leader, jumped = jumped, jumped[jumped]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
    out = np.empty(len(key), dtype=np.int64)
    out[order] = key[starts][leader][run]
    return out


def _tile_labels(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "scene_id": group["scene_id"],
            "row": group["row"],
            "col": group["col"],
            "root": _tile_roots(group["row"].to_numpy(), group["col"].to_numpy()),
        }
    )


def _border_edges(local: DataFrame, axis: str) -> DataFrame:
    """Pairs of tile regions whose cells touch across a tile border."""
    near = local.where(F.col(axis) % TILE_SIDE == 0)
    far = local.where(F.col(axis) % TILE_SIDE == TILE_SIDE - 1).withColumn(axis, F.col(axis) + 1)
    return near.join(
        far.withColumnRenamed("root", "other"), ["scene_id", "row", "col"]
    ).select("scene_id", F.col("root").alias("a"), F.col("other").alias("b"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest around it."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("scene_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.where("b > a").join(least, ["scene_id", "a"]).select(
        "scene_id", F.col("b").alias("a"), F.col("m").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them; edges go from the larger vertex a to b."""
    least = edges.groupBy("scene_id", "a").agg(F.min("b").alias("m"))
    # the edge to the smallest stays, so that one join gives both kinds of edges
    moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return edges.join(least, ["scene_id", "a"]).select("scene_id", moved.alias("a"), F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex is a centre or has one neighbour, a smaller centre: neither star moves an edge then."""
    around = _both_ways(edges).groupBy("scene_id", "a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    return around.where("least < a and least <> most").isEmpty()


def contract(edges: DataFrame) -> DataFrame:
    """Map every vertex of an undirected graph to the least vertex it reaches.

    Returns (scene_id, root, target) for vertices that are not their own target.
    Edges are read more than once, so the caller has written them. A round of
    both stars is written once, and the last needs no other to confirm it.
    """
    current = edges.where("a <> b")
    while True:
        current = materialise(_small_star(_large_star(current)).distinct())
        if _settled(current):
            return current.select("scene_id", F.col("a").alias("root"), F.col("b").alias("target"))


def label_regions(mask_cells: DataFrame, min_area: int = 16) -> DataFrame:
    """Label the given cells; returns (scene_id, row, col, label) of kept regions.

    Labels count from 1 in raster order of the first cell, after regions smaller
    than `min_area` are dropped.
    """
    cells = mask_cells.select(
        "scene_id",
        "row",
        "col",
        F.expr(f"cast(row div {TILE_SIDE} as int)").alias("_ty"),
        F.expr(f"cast(col div {TILE_SIDE} as int)").alias("_tx"),
    )
    local = materialise(
        cells.groupBy("scene_id", "_ty", "_tx").applyInPandas(
            _tile_labels, "scene_id string, row int, col int, root long"
        )
    )
    edges = _border_edges(local, "row").unionByName(_border_edges(local, "col"))
    merged = contract(materialise(edges.distinct()))
    roots = local.groupBy("scene_id", "root").agg(F.count(F.lit(1)).alias("cells"))
    joined = roots.join(merged, ["scene_id", "root"], "left").withColumn(
        "first", F.coalesce("target", "root")
    )
    joined = materialise(joined.drop("target"))
    kept = joined.groupBy("scene_id", "first").agg(F.sum("cells").alias("area")).where(F.col("area") >= min_area)
    numbered = number_rows(kept, ["scene_id"], "first", "_k", block=_STRIDE << 8)
    # tile roots are the join key, so one vast region is many small groups
    labels = joined.join(
        numbered.select("scene_id", "first", (F.col("_k") + 1).cast("int").alias("label")), ["scene_id", "first"]
    ).select("scene_id", "root", "label")
    return local.join(labels, ["scene_id", "root"]).select("scene_id", "row", "col", "label")
