import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowgate.functions.schema import CELLS, RAW_ROW_SCHEMA  # noqa: E402
from rowgate.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "rowgate-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sheet(spark):
    """Builds raw rows from (sheet_name, sheet_order, row_num, {cell: value})."""

    def build(*rows):
        data = [(n, o, r, *[cells.get(c) for c in CELLS]) for n, o, r, cells in rows]
        return spark.createDataFrame(data, RAW_ROW_SCHEMA)

    return build
