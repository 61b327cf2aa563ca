from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillwise.session import build_session  # noqa: E402
from tillwise.sources.schemas import TABLES  # noqa: E402
from tillwise.sources.store import FrameStore  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(folder / "checkpoints"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(kind: T.DataType, value):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return date.fromisoformat(value)
    return value


@pytest.fixture(scope="session")
def frame(spark):
    """frame("orders", [{...}]): a table with the given cells, null elsewhere."""

    def build(name, rows):
        columns = TABLES[name].columns
        unknown = {c for row in rows for c in row} - set(columns)
        assert not unknown, unknown
        data = [tuple(_value(k, row.get(c)) for c, k in columns.items()) for row in rows]
        return spark.createDataFrame(data, TABLES[name].struct)

    return build


@pytest.fixture(scope="session")
def store(frame):
    """store(orders=[...], customers=[...]): a store of hand-made tables, the ones not
    given being empty."""

    def build(**tables):
        return FrameStore({name: frame(name, tables.get(name, [])) for name in TABLES})

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]


def dicts(df):
    return [r.asDict() for r in df.collect()]
