import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def odd(spark):
    import helpers

    return helpers.clashing(helpers.table(spark, helpers.odd_rows()))


@pytest.fixture(scope="session")
def empty(spark):
    import helpers

    return helpers.clashing(helpers.table(spark, []))
