"""Polygon columns: ARRAY<STRUCT<u, v>> rings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relief.functions.core import EPS64, as_col

OSM_GAP = 1e-5
RING_GAP = 1e-9


def next_point(points: Column | str, i: Column) -> Column:
    """Point after position i (0-based), wrapping round."""
    points = as_col(points)
    return F.element_at(points, ((i + 1) % F.size(points) + 1).cast("int"))


def ring_area(points: Column | str) -> Column:
    """Signed shoelace area; fewer than three points have none."""
    points = as_col(points)
    shifted = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crosses = F.zip_with(points, shifted, lambda a, b: a["u"] * b["v"] - a["v"] * b["u"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(
        F.aggregate(crosses, F.lit(0.0), lambda acc, c: acc + c) * 0.5
    )


def _apart(a: Column, b: Column, gap: float) -> Column:
    return (F.abs(a["u"] - b["u"]) > gap) | (F.abs(a["v"] - b["v"]) > gap)


def tidy_ring(points: Column | str, gap: float = OSM_GAP, open_above: int = 1) -> Column:
    """Drop points too close to the last kept one, then a closing duplicate.

    The closing point is dropped when more than `open_above` points remain.
    NULL when fewer than three are left.
    """
    # each array is bound once, by transforming an array that holds it alone
    kept = F.transform(
        F.array(as_col(points)),
        lambda whole: F.aggregate(
            whole,
            F.slice(whole, 1, 0),
            lambda acc, p: F.when(
                (F.size(acc) == 0) | _apart(F.element_at(acc, -1), p, gap), F.concat(acc, F.array(p))
            ).otherwise(acc),
        ),
    )
    opened = F.transform(
        kept,
        lambda k: F.when(
            (F.size(k) > open_above) & ~_apart(F.element_at(k, 1), F.element_at(k, -1), gap),
            F.slice(k, F.lit(1), F.size(k) - 1),
        ).otherwise(k),
    )
    return F.transform(opened, lambda k: F.when(F.size(k) >= 3, k))[0]


def ring_edges(points: Column | str) -> Column:
    """Edges of a ring, each with what the even-odd test asks of it."""
    points = as_col(points)
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1))
    rise = lambda p, q: F.when(q["v"] == p["v"], EPS64).otherwise(q["v"] - p["v"])
    return F.zip_with(
        points,
        before,
        lambda p, q: F.struct(
            p["u"].alias("u"), p["v"].alias("v"), q["v"].alias("w"), (q["u"] - p["u"]).alias("run"), rise(p, q).alias("rise")
        ),
    )


def crosses(edges: Column | str, u: Column, v: Column) -> Column:
    """Even-odd test of a point against the edges of a ring."""
    hit = F.filter(
        as_col(edges), lambda e: ((e["v"] > v) != (e["w"] > v)) & (u < e["run"] * (v - e["v"]) / e["rise"] + e["u"])
    )
    return F.size(hit) % 2 == 1


def contains(points: Column | str, u: Column, v: Column) -> Column:
    """Whether a ring holds a point."""
    return crosses(ring_edges(points), u, v)


def level_count(text: Column | str) -> Column:
    """Digits with at most one dot, else NULL."""
    text = as_col(text)
    return F.when(text.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))
