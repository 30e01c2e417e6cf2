"""Spatial joins on quadtree cells, each shape on the level of its own size.

The unit square is halved again and again on both axes; a cell is its level and
Morton number, so that the cell above it is the number without its last two
bits. A box lies on the deepest level whose cells are as large as itself, where
it touches four cells at most, however large or small it is. What may meet it is
looked up on every level that holds boxes: points by the cell around them, boxes
also by the cells above their own. A dense town of small shapes is spread over
as many deep cells, and a country is one to four rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relief.session import materialise

DEEPEST = 24
_CELL = ["_level", "_z"]


def _spread_bits(x: Column) -> Column:
    """Put a zero before every bit of a number of up to 31 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column) -> Column:
    """Bits of two cell numbers in turns."""
    return _spread_bits(x.cast("long")).bitwiseOR(F.shiftleft(_spread_bits(y.cast("long")), 1))


def cell_number(value: Column, level: Column | int = DEEPEST) -> Column:
    """Cell of a coordinate on one axis; what lies outside of the square belongs to its rim."""
    cells = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return F.greatest(F.lit(0.0), F.least(cells - 1, F.floor(value * cells).cast("double"))).cast("long")


def box_level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The deepest level whose cells are no smaller than the box."""
    side = F.greatest(x1 - x0, y1 - y0, F.lit(2.0**-DEEPEST))
    return F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.floor(-F.log2(side)).cast("int")))


def box_cells(boxes: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """One row for each cell of a box on its level: adds _level and _z. Boxes without coordinates have none."""
    corners = [F.col(c) for c in (x0, y0, x1, y1)]
    placed = boxes.where(" and ".join(f"{c} is not null" for c in (x0, y0, x1, y1))).withColumn("_level", box_level(*corners))
    for name, low, high in (("_x", x0, x1), ("_y", y0, y1)):
        first, last = (cell_number(F.col(c), F.col("_level")) for c in (low, high))
        placed = placed.withColumn(name, F.explode(F.sequence(first, last)))
    return placed.withColumn("_z", morton(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def levels_of(cells: DataFrame) -> list[int]:
    """Levels in use, DEEPEST + 1 at most."""
    return sorted(r["_level"] for r in cells.select("_level").distinct().collect())


def point_cells(points: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """One row for each level in use: adds _level and _z of the cell around a point."""
    deepest = morton(cell_number(F.col(x)), cell_number(F.col(y)))
    rows = F.array(
        *(F.struct(F.lit(k).alias("_level"), F.shiftright(F.col("_deep"), 2 * (DEEPEST - k)).alias("_z")) for k in levels)
    )
    if not levels:
        rows = F.array().cast("array<struct<_level:int,_z:bigint>>")
    names = points.columns
    return points.withColumn("_deep", deepest).select(*names, F.inline(rows))


def _above(cells: DataFrame, levels: list[int], key: list[str]) -> DataFrame:
    """The cells above a box's own on the other levels in use; `_own` is the box's level."""
    rows = F.array(
        *(
            F.when(F.lit(k) < F.col("_level"), F.struct(F.lit(k).alias("l"), F.expr(f"shiftright(_z, 2 * (_level - {k}))").alias("z")))
            for k in levels
        )
    )
    spread = cells.withColumn("_own", F.col("_level")).withColumn("_up", F.explode(F.array_compact(rows)))
    spread = spread.withColumns({"_level": F.col("_up.l"), "_z": F.col("_up.z")}).drop("_up")
    # the cells of a box often share those above
    return spread.dropDuplicates([*key, *_CELL])


def overlapping(
    left: DataFrame, right: DataFrame, left_box: list[str], right_box: list[str], left_key: list[str], right_key: list[str], on: list[str]
) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1 in the unit square) that touch; every pair once.

    Columns of the two sides differ but for `on`, which must be equal.
    """
    a = materialise(box_cells(left, *left_box))
    b = materialise(box_cells(right, *right_box))
    if not on and not (a.columns and b.columns):
        raise ValueError("boxes need columns")
    in_a, in_b = levels_of(a), levels_of(b)
    same = [*on, *_CELL]
    own = F.col("_level")
    found = a.join(b, same)
    if in_b and in_a:
        found = found.unionByName(a.join(_above(b, in_a, [*on, *right_key]).drop("_own"), same)).unionByName(
            _above(a, in_b, [*on, *left_key]).drop("_own").join(b, same)
        )
    low = [F.greatest(p, q) for p, q in zip(left_box[:2], right_box[:2], strict=True)]
    high = [F.least(p, q) for p, q in zip(left_box[2:], right_box[2:], strict=True)]
    touch = (low[0] <= high[0]) & (low[1] <= high[1])
    # the cell that holds the lower corner of what is common
    here = morton(cell_number(low[0], own), cell_number(low[1], own)) == F.col("_z")
    return found.where(touch & here).drop(*_CELL)
