import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.session import build_session  # noqa: E402

SERIES = "date date, store long, item long, sales double"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_series(spark):
    """Series table rows from {item: {date or start: value or values}}."""

    def make(items, start="2026-01-01", store=1):
        rows = []
        for item, values in items.items():
            if isinstance(values, dict):
                rows += [(dt.date.fromisoformat(d), store, item, v) for d, v in values.items()]
            else:
                first = dt.date.fromisoformat(start)
                rows += [(first + dt.timedelta(days=i), store, item, v) for i, v in enumerate(values)]
        rows = [(d, s, i, None if v is None else float(v)) for d, s, i, v in rows]
        return spark.createDataFrame(rows, SERIES)

    return make


@pytest.fixture
def values_by_day():
    """{item: [values in date order]} of a collected frame."""

    def collect(df, column="sales"):
        out = {}
        for row in df.orderBy("store", "item", "date").collect():
            out.setdefault(row["item"], []).append(row[column])
        return out

    return collect
