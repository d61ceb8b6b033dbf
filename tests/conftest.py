import datetime as dt
import tempfile

import pytest

from dayloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "dayloom-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dayloom-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def edge_panel(spark):
    """A panel with a gap, a null key, an early end, a negative correction and first days."""
    rows = [
        ("A", "x", day("2020-03-01"), 10), ("A", "x", day("2020-03-02"), 15), ("A", "x", day("2020-03-04"), 12),
        ("A", "x", day("2020-03-05"), 20), ("A", None, day("2020-03-01"), 1), ("A", None, day("2020-03-02"), 4),
        ("A", None, day("2020-03-05"), 9), ("B", "y", day("2020-03-01"), 7), ("B", "y", day("2020-03-02"), 5),
    ]
    return spark.createDataFrame(rows, "Country string, Province string, Date date, n bigint")
