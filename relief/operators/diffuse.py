"""Edge-stopping diffusion by rounds on tiles of a fixed size.

One step reads the four neighbours, so k steps depend on cells at most k away. A
tile that holds its neighbours' borders, k cells wide, is therefore right after
k steps without any further exchange. Steps are taken in rounds: in each, every
tile goes on as one packed row and only strips of its border go to the eight
tiles around it. The size of a tile and of its strips depends neither on the
scene nor on the number of steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relief.functions.core import EPS32, dbl, is_finite
from relief.operators.focal import TILE
from relief.operators.grid import attach
from relief.operators.stats import exact_percentiles
from relief.session import materialise

STEP = 0.25  # stability limit of the explicit four-neighbour scheme
SIDE = 512  # cells along a tile
ROUND = 32  # most steps between two exchanges, at most SIDE
KEEP = 8  # rounds after which the tiles are written, which ends their lineage

_PIECE = ["top", "left", "height", "width", "limit", "data"]


def _steps(grid: np.ndarray, threshold: float, iterations: int) -> np.ndarray:
    """Flux form: what leaves a cell across an edge enters its neighbour."""
    limit = grid.dtype.type(threshold)
    for _ in range(iterations):
        change = np.zeros_like(grid)
        for axis in (0, 1):
            slope = np.diff(grid, axis=axis)
            # cells missing from a ragged tile conduct nothing
            flux = np.nan_to_num(np.exp(-np.square(slope / limit)) * slope, nan=0.0)
            before = (slice(None, -1), slice(None)) if axis == 0 else (slice(None), slice(None, -1))
            after = (slice(1, None), slice(None)) if axis == 0 else (slice(None), slice(1, None))
            change[before] += flux
            change[after] -= flux
        grid = grid + grid.dtype.type(STEP) * change
    return grid


def _own(grid: np.ndarray, corner: tuple[int, int], at: tuple[int, int], side: int, halo: int = 0):
    """The part of a grid that tile `at` covers, with `halo` cells around it, and its corner."""
    start = [max(c, a * side - halo) for c, a in zip(corner, at)]
    stop = [min(c + n, (a + 1) * side + halo) for c, n, a in zip(corner, grid.shape, at)]
    rows, cols = (slice(s - c, max(e, s) - c) for s, e, c in zip(start, stop, corner))
    return grid[rows, cols], tuple(start)


def _sent(key: tuple, grid: np.ndarray, corner: tuple[int, int], limit: float, side: int, halo: int) -> pd.DataFrame:
    """A tile for itself and strips of its border for the tiles around it, as packed rows."""
    scene, ty, tx = key
    rows = []
    for y in (ty - 1, ty, ty + 1):
        for x in (tx - 1, tx, tx + 1):
            part, (top, left) = _own(grid, corner, (y, x), side, halo)
            if part.size and y >= 0 and x >= 0:
                rows.append((scene, y, x, top, left, *part.shape, limit, part.tobytes()))
    return pd.DataFrame(rows, columns=[*TILE, *_PIECE])


def _joined(pieces: pd.DataFrame, kind) -> tuple[np.ndarray, tuple[int, int]]:
    """A tile and the strips around it as one grid; cells that do not exist are NaN."""
    top, left = int(pieces["top"].min()), int(pieces["left"].min())
    bottom, right = (int((pieces[a] + pieces[b]).max()) for a, b in (("top", "height"), ("left", "width")))
    grid = np.full((bottom - top, right - left), np.nan, dtype=kind)
    for p in pieces.itertuples():
        part = np.frombuffer(p.data, dtype=kind).reshape(p.height, p.width)
        grid[p.top - top : p.top - top + p.height, p.left - left : p.left - left + p.width] = part
    return grid, (top, left)


def diffuse(
    cells: DataFrame,
    value: str,
    iterations: int = 80,
    kappa: float = 0.12,
    valid: Column | None = None,
    alias: str = "levelled",
    storage: str = "float",
) -> DataFrame:
    """Level the surface inside regions; the threshold is a share of the spread.

    Invalid cells diffuse as the median and keep their own value in the output.
    The result is the same for every size of tiles and rounds.
    """
    ok = is_finite(value) if valid is None else is_finite(value) & valid
    if iterations <= 0:
        return cells.withColumn(alias, F.col(value).cast(storage))
    stats = exact_percentiles(cells, value, {"_median": 0.5}, where=valid).drop("n")
    span = F.col("high") - F.col("low")
    # read twice, by the first round and the last; what `cells` rests on may be costly
    ready = materialise(
        attach(cells, stats, how="left").select(
            *cells.columns,
            F.when(ok, dbl(value)).otherwise(F.col("_median")).cast(storage).alias("_w"),
            F.when(span > EPS32, F.greatest(span * float(kappa), F.lit(EPS32))).alias("_limit"),
            ok.alias("_ok"),
        )
    )
    side, kind = SIDE, np.float32 if storage == "float" else np.float64
    rounds = -(-iterations // min(ROUND, side))
    steps = [iterations // rounds + (k < iterations % rounds) for k in range(rounds)]
    tiled = ready.withColumns({"_ty": F.expr(f"cast(row div {side} as int)"), "_tx": F.expr(f"cast(col div {side} as int)")})
    packed = T.StructType(
        [ready.schema["scene_id"]]
        + [T.StructField(n, T.IntegerType()) for n in (*TILE[1:], *_PIECE[:4])]
        + [T.StructField("limit", T.DoubleType()), T.StructField("data", T.BinaryType())]
    )

    def pack(halo: int):
        def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            rows, cols = group["row"].to_numpy(), group["col"].to_numpy()
            top, left = int(rows.min()), int(cols.min())
            grid = np.full((int(rows.max()) - top + 1, int(cols.max()) - left + 1), np.nan, dtype=kind)
            grid[rows - top, cols - left] = group["_w"].to_numpy(dtype=kind)
            return _sent(key, grid, (top, left), float(group["_limit"].iloc[0]), side, halo)

        return first

    def advance(count: int, halo: int):
        def step(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
            grid, corner = _joined(pieces, kind)
            limit = float(pieces["limit"].iloc[0])
            grid, corner = _own(_steps(grid, limit, count), corner, key[1:], side)
            return _sent(key, grid, corner, limit, side, halo)

        return step

    kept = [*cells.columns, "_ok", "_limit"]

    def settle(group: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        new = np.full(len(group), np.nan, dtype=kind)
        if len(group) and len(pieces):
            grid, (top, left) = _joined(pieces, kind)
            grid = _steps(grid, float(pieces["limit"].iloc[0]), steps[-1])
            new = grid[group["row"].to_numpy() - top, group["col"].to_numpy() - left]
        return group[kept].assign(_new=new)

    # scenes without a usable spread are not sent
    narrow = tiled.where(F.col("_limit").isNotNull()).select(*TILE, "row", "col", "_w", "_limit")
    pieces = narrow.groupBy(*TILE).applyInPandas(pack(steps[0]), packed)
    for k in range(rounds - 1):
        if k % KEEP == KEEP - 1:
            pieces = materialise(pieces)
        pieces = pieces.groupBy(*TILE).applyInPandas(advance(steps[k], steps[k + 1]), packed)
    # the last round meets the cells, whose own columns are shuffled this once
    schema = T.StructType([ready.schema[c] for c in kept] + [T.StructField("_new", ready.schema["_w"].dataType)])
    levelled = tiled.groupBy(*TILE).cogroup(pieces.groupBy(*TILE)).applyInPandas(settle, schema)
    # invalid cells are left as they are
    changed = F.col("_ok") & F.col("_limit").isNotNull()
    out = F.when(changed, F.col("_new")).otherwise(F.col(value).cast(storage))
    return levelled.withColumn(alias, out).drop("_ok", "_limit", "_new")
