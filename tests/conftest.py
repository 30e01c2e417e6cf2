from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
# workers import the estimators that tests define
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")]
).rstrip(os.pathsep)

from relief.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        4,
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """Make a cell table from named 2-D arrays."""

    def make(scene_id: str = "a", **bands):
        shape = next(iter(bands.values())).shape
        rows, cols = np.indices(shape)
        data = {"scene_id": scene_id, "row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32)}
        data.update({name: np.asarray(band).ravel() for name, band in bands.items()})
        return spark.createDataFrame(pd.DataFrame(data))

    return make


@pytest.fixture(scope="session")
def array():
    """Read one column of a scene back as a 2-D array."""

    def read(df, column: str):
        pdf = df.select("row", "col", column).toPandas().sort_values(["row", "col"])
        return pdf[column].to_numpy().reshape(pdf["row"].max() + 1, pdf["col"].max() + 1)

    return read
