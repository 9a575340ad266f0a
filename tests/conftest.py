import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glycoflow.schemas import EVENTS, META  # noqa: E402
from glycoflow.session import local_session  # noqa: E402

BASE = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minutes: float = 0.0, ms: int = 0) -> datetime:
    return BASE + timedelta(minutes=minutes, milliseconds=ms)


def event(id, ts, event_type, value, subject=1, **meta):
    known = tuple(meta.get(f.name) for f in META.fields)
    value = None if value is None else float(value)
    return (id, subject, ts, event_type, value, known, ts, ts, False)


@pytest.fixture(autouse=True)
def shuffle_partitions_kept(request):
    """A test that changes the number of shuffle partitions does not change it for those after it."""
    session = request.getfixturevalue("spark") if "spark" in request.fixturenames else None
    before = session and session.conf.get("spark.sql.shuffle.partitions")
    yield
    if session:
        session.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def make_log(spark):
    return lambda rows: spark.createDataFrame(rows, EVENTS)


def utc_ms(moment) -> int:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return round(moment.timestamp() * 1000)
