"""Quadtree joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from relief.operators import quadtree as q


def boxes(seed: int, count: int):
    """Boxes of all sizes, some points, some on cell borders, some beyond the square."""
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        side = 2.0 ** -rng.randrange(0, 26)
        x, y = rng.random(), rng.random()
        if k % 5 == 0:
            x, y, side = round(x * 8) / 8, round(y * 8) / 8, rng.choice([0.0, 0.125, 0.25])
        if k % 17 == 0:
            x -= 1
        rows.append((k, x, y, x + side, y + side * rng.random()))
    return [*rows, (count, 0.0, 0.0, 1.0, 1.0), (count + 1, None, 0.0, 1.0, 1.0)]


NAMES = ["x0", "y0", "x1", "y1"]


def table(spark, rows, prefix):
    return spark.createDataFrame(rows, f"{prefix}id long, " + ", ".join(f"{prefix}{n} double" for n in NAMES))


def test_boxes_meet_once(spark):
    a, b = boxes(1, 120), boxes(2, 150)
    found = q.overlapping(table(spark, a, "a"), table(spark, b, "b"), [f"a{n}" for n in NAMES], [f"b{n}" for n in NAMES], ["aid"], ["bid"], [])
    got = sorted((r["aid"], r["bid"]) for r in found.collect())
    want = sorted(
        (p[0], r[0]) for p in a for r in b
        if None not in p and None not in r and p[1] <= r[3] and r[1] <= p[3] and p[2] <= r[4] and r[2] <= p[4]
    )
    assert got == want


def test_points_find_the_boxes_around_them(spark):
    rng = random.Random(3)
    points = [(k, rng.random(), rng.random()) for k in range(200)] + [(200, 0.125, 0.125), (201, 1.0, 1.0), (202, 0.0, 0.5)]
    cells = q.box_cells(table(spark, boxes(4, 150), ""), *NAMES).cache()
    placed = q.point_cells(spark.createDataFrame(points, "p long, x double, y double"), "x", "y", q.levels_of(cells))
    met = placed.join(cells, ["_level", "_z"]).where("x between x0 and x1 and y between y0 and y1")
    got = sorted((r["p"], r["id"]) for r in met.collect())
    assert got == sorted((p, b[0]) for p, x, y in points for b in boxes(4, 150) if None not in b and b[1] <= x <= b[3] and b[2] <= y <= b[4])


def test_a_large_box_is_few_rows(spark):
    country = [(1, 0.40001, 0.3, 0.43, 0.355)]
    assert q.box_cells(table(spark, country, ""), *NAMES).count() <= 4
    assert q.box_cells(table(spark, boxes(5, 300), ""), *NAMES).groupBy("id").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("x, y", [(0, 0), (5, 3), (2**24 - 1, 2**23 + 7), (2**31 - 1, 2**31 - 1)])
def test_morton_numbers_take_bits_in_turns(spark, x, y):
    (row,) = spark.range(1).select(q.morton(F.lit(x), F.lit(y)).alias("z")).collect()
    assert row["z"] == sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(31))
