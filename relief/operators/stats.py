"""Scene statistics: exact percentiles by rank selection, extents, medians.

`percentile()` keeps every distinct value of a group in one task. Here the two
order statistics around each requested position are found by counting: a coarse
monotone bin, then a linear refinement inside the selected bins, then the few
distinct values left. Every step is a map-side combined aggregate, and the
source is read twice however often the result is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relief.functions.core import as_col, dbl, is_finite
from relief.operators.grid import SCENE, attach, extent_aggs
from relief.session import materialise

EXTENT = ("n_rows", "n_cols", "row_0", "col_0")
COARSE = 256.0
FINE = 4096


def _coarse_bin(v: Column) -> Column:
    """Monotone integer bin, 0.4% wide in relative terms, needing no scene range."""
    size = F.floor((F.ln(F.abs(v)) + 750.0) * COARSE)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _holding(hist: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the histogram rows whose cumulative range contains a wanted rank."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.col("_upto") - F.col("_n")
    return (
        hist.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_start", start)
        .withColumn(
            "_ranks",
            F.filter(
                "_ranks",
                lambda k: (k >= F.col("_start")) & (k < F.col("_start") + F.col("_n")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .withColumn("_before", F.col("_start"))
        .drop("_upto", "_start")
    )


def exact_percentiles(
    cells: DataFrame,
    value: Column | str,
    probs: Mapping[str, float],
    keys: Sequence[str] = SCENE,
    where: Column | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles over the finite values.

    Returns one row per key that has a finite value: the named percentiles, the
    count `n`, `low`, `high` and the extent of all cells of the key.
    """
    keys = list(keys)
    ok = is_finite(value) if where is None else is_finite(value) & F.coalesce(where, F.lit(False))
    rows = cells.select(*keys, "row", "col", F.when(ok, dbl(value)).alias("_v"))
    rows = rows.withColumn("_b1", _coarse_bin(F.col("_v")))

    whole = Window.partitionBy(*keys)
    whole_extent = ["_all_rows", "_all_cols", "_first_row", "_first_col"]
    coarse = (
        rows.groupBy(*keys, "_b1")
        .agg(
            F.count("_v").alias("_n"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            *extent_aggs(),
        )
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("low", F.min("_lo").over(whole))
        .withColumn("high", F.max("_hi").over(whole))
        .withColumn("_all_rows", F.max("n_rows").over(whole))
        .withColumn("_all_cols", F.max("n_cols").over(whole))
        .withColumn("_first_row", F.min("row_0").over(whole))
        .withColumn("_first_col", F.min("col_0").over(whole))
        .where("_n > 0")
    )
    last = F.col("_total") - 1
    wanted = [
        f(last * F.lit(float(p))).cast("long") for p in probs.values() for f in (F.floor, F.ceil)
    ]
    coarse = materialise(
        _holding(
            coarse.withColumn("_ranks", F.array_distinct(F.array(*wanted))).withColumn(
                "_before", F.lit(0).cast("long")
            ),
            keys,
            "_b1",
        ).drop("_n")
    )

    span = F.col("_hi") - F.col("_lo")
    fine = F.when(
        span > 0,
        F.least(F.lit(FINE - 1), F.floor((F.col("_v") - F.col("_lo")) / span * FINE)),
    ).otherwise(F.lit(0))
    distinct = materialise(
        attach(rows, coarse.select(*keys, "_b1", "_lo", "_hi", *EXTENT), [*keys, "_b1"], stored=True)
        .withColumn("_b2", fine.cast("int"))
        .groupBy(*keys, "_b1", "_b2", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    wanted_in = coarse.select(
        *keys, "_b1", "_ranks", "_before", "_total", "low", "high", *whole_extent
    )
    chosen = _holding(
        distinct.groupBy(*keys, "_b1", "_b2").agg(F.sum("_n").alias("_n")).join(wanted_in, [*keys, "_b1"]),
        [*keys, "_b1"],
        "_b2",
    ).drop("_n")
    values = _holding(distinct.join(chosen, [*keys, "_b1", "_b2"]), [*keys, "_b1", "_b2"], "_v")
    found = values.groupBy(*keys).agg(
        F.map_from_entries(
            F.flatten(F.collect_list(F.transform("_ranks", lambda k: F.struct(k, F.col("_v")))))
        ).alias("_at"),
        F.max("_total").alias("n"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
        *[F.max(c).alias(name) for c, name in zip(whole_extent, EXTENT)],
    )
    end = F.col("n") - 1
    out = []
    for name, p in probs.items():
        position = end * F.lit(float(p))
        below = F.element_at("_at", F.floor(position).cast("long"))
        above = F.element_at("_at", F.ceil(position).cast("long"))
        out.append((below + (above - below) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *out, "n", "low", "high", *EXTENT)


def exact_percentiles_of(
    cells: DataFrame,
    values: Mapping[str, Column | str],
    probs: Mapping[str, float],
    keys: Sequence[str] = SCENE,
    where: Column | None = None,
) -> DataFrame:
    """Percentiles of several values in the same two readings of the source.

    Columns are named <value>_<percentile>, with the extent of the key.
    """
    keys = list(keys)
    pieces = [F.struct(F.lit(n).alias("_name"), dbl(c).alias("_value")) for n, c in values.items()]
    kept = cells if where is None else cells.where(where)
    long = kept.select(*keys, "row", "col", F.inline(F.array(*pieces)))
    found = exact_percentiles(long, "_value", probs, [*keys, "_name"])
    wide = [
        F.max(F.when(F.col("_name") == n, F.col(p))).alias(f"{n}_{p}") for n in values for p in probs
    ]
    corner = [F.max(c).alias(c) for c in EXTENT[:2]] + [F.min(c).alias(c) for c in EXTENT[2:]]
    return found.groupBy(*keys).agg(*wide, *corner)


def range_stats(cells: DataFrame, value: Column | str, keys: Sequence[str] = SCENE, where=None) -> DataFrame:
    """A10: finite minimum, maximum and count per key, with the extent."""
    ok = is_finite(value) if where is None else is_finite(value) & where
    v = F.when(ok, dbl(value))
    return cells.groupBy(*keys).agg(
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.count(v).alias("n"),
        *extent_aggs(),
    )


def bounded_percentiles(value: Column | str, probs: Mapping[str, float]) -> list[Column]:
    """Percentiles for groups with a fixed size bound (a tile, one model's runs)."""
    return [F.percentile(as_col(value), F.lit(float(p))).alias(n) for n, p in probs.items()]
