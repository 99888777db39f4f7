from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


BOOK = """A Lantern for Saltmere

Chapter 1: The Ferry

By May 9, 1887, Mrs. Tolliver had sold the lower meadow for $3.4M and kept
only the boathouse at 27 Quay St. The buyers would come on the 22nd.
"Nobody told me the price," said the ferryman, counting the bags again.

Her notebook had 2,318 lines. Every line was numbered twice. About 2/5 of the numbers agreed.

Chapter 2: The Guest

Around 6:20 PM the bell rang. The guest was Dr. Penhale, who kept rooms on Birch Dr.
"We ask for very little," he began. "Roughly 80kg of lamp oil, or 15% of the harbour dues."
She rang 555-418-2760 at once and sent a note to office@saltmere.example about it.

King George VI, he insisted, had lit that lantern. Nobody had touched it since the 1790s.
"""

ARTICLE = """# Tides and Toll Roads

## Setting

By 2019 the tolls brought in $4.5B a year, up 8% on the year before.

## Approach

We follow 6 harbours from the 3rd of each month. Section VII lists them all.
"""
