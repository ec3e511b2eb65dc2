import os
import sys
from datetime import datetime, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from loomlog.session import build_session  # noqa: E402

LOG_DDL = (
    "id BIGINT, received_at TIMESTAMP, service STRING, level STRING, trace_id STRING, body STRING"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.fixture
def make_logs(spark):
    """Rows from (time, service, level, trace_id, body), ids counting from 1."""

    def make(*rows):
        full = [
            (i, at(r[0]), *(list(r[1:]) + [None, None, None, "{}"][len(r) - 1 :]))
            for i, r in enumerate(rows, 1)
        ]
        return spark.createDataFrame(full, LOG_DDL)

    return make
