from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relief import sinks
from relief.operators import sketches
from relief.operators.stats import EXTENT, exact_percentiles

PROBS = {"least": 0.0, "p02": 0.02, "p50": 0.5, "p98": 0.98, "most": 1.0}


@pytest.fixture(scope="module")
def values():
    noise = np.random.default_rng(9).lognormal(size=(700, 60))
    noise[3, 5] = np.inf
    noise[600:, 10] = np.nan
    return noise


def _near(row, clean, size):
    """The rank of each value is within twice the 99 % bound of what was asked."""
    assert row["least"] == clean.min() and row["most"] == clean.max()
    for name in ("p02", "p50", "p98"):
        share = np.searchsorted(np.sort(clean), row[name], side="right") / clean.size
        assert abs(share - PROBS[name]) <= 2 * sketches.rank_error(size) + 1 / clean.size
        assert row[name] in clean


@pytest.mark.parametrize("size", [256, 2048])
def test_sketches_of_blocks_meet_their_error(grid, values, size):
    cells = grid(v=values)
    blocks = sketches.block_sketches(cells, "v", size=size)
    assert blocks.count() == 3
    row = sketches.sketched_percentiles(blocks, PROBS).first()
    clean = values[np.isfinite(values)]
    assert row["n"] == clean.size
    _near(row, clean, size)
    exact = exact_percentiles(cells, "v", PROBS)
    assert exact.columns == sketches.percentiles(cells, "v", PROBS, sketch=size).columns
    assert [exact.first()[c] for c in ("n", "low", "high", *EXTENT)] == [row[c] for c in ("n", "low", "high", *EXTENT)]


def test_masked_empty_and_few_values(spark, grid, values):
    few = grid("few", v=np.array([[4.0, 1.0, np.nan]]))
    none = grid("none", v=np.full((2, 2), np.nan))
    cells = few.unionByName(none)
    rows = sketches.percentiles(cells, "v", PROBS, sketch=64).collect()
    assert [(r["scene_id"], r["n"], r["low"], r["high"], r["n_cols"]) for r in rows] == [("few", 2, 1.0, 4.0, 3)]
    masked = sketches.percentiles(cells, "v", PROBS, where=F.col("v") > 2, sketch=64).collect()
    assert [(r["n"], r["p50"]) for r in masked] == [(1, 4.0)]
    assert sketches.percentiles(cells.limit(0), "v", PROBS, sketch=64).collect() == []


def test_later_runs_sketch_their_blocks_alone(spark, grid, values, tmp_path):
    path, size = str(tmp_path / "sketches"), 512
    cells = grid("a", v=values).unionByName(grid("b", v=values[:50]))
    sketches.renew_sketches(sketches.block_sketches(cells, "v", size=size), path)
    changed = values.copy()
    changed[256:512] += 100.0
    new = sketches.block_sketches(grid("a", v=changed).where("row >= 256 AND row < 512"), "v", size=size)
    assert new.count() == 1
    kept = sketches.renew_sketches(new, path)
    row = sketches.sketched_percentiles(kept, PROBS).first()
    clean = changed[np.isfinite(changed)]
    assert (row["scene_id"], row["n"]) == ("a", clean.size)
    _near(row, clean, size)
    stored = {r["scene_id"]: r["n"] for r in sketches.sketched_percentiles(sketches.stored_rows(spark, path), PROBS).collect()}
    assert stored == {"a": clean.size, "b": int(np.isfinite(values[:50]).sum())}


def test_previews_from_sketches_stay_close(grid, values):
    cells = grid(v=np.nan_to_num(values, nan=1.0, posinf=1.0))
    exact, near = (sinks.preview_table(cells, "v", None, sketch=s) for s in (None, 4096))
    both = exact.alias("e").join(near.alias("s"), ["row", "col"])
    off = both.agg(*[F.avg(F.abs(F.col(f"e.{c}") - F.col(f"s.{c}"))).alias(c) for c in ("red", "green", "blue")]).first()
    assert max(off) < 8
