"""A shared local session and the driver's tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    made = session(
        "tests",
        f"local[{min(8, os.cpu_count() or 2)}]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf() -> str:
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are absent")
    return path
