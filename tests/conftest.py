from __future__ import annotations

import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from answerlog import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("answerlog-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def moment(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make_log(spark):
    """Build a log from dicts; missing columns are NULL."""

    def make(rows: list[dict]):
        records = []
        for number, row in enumerate(rows, 1):
            record = {"id": number, "query": "P", "success": True, **row}
            if isinstance(record.get("timestamp"), str):
                record["timestamp"] = moment(record["timestamp"])
            records.append(tuple(record.get(name) for name in schema.RESULTS.names))
        return spark.createDataFrame(records, schema.RESULTS)

    return make


@pytest.fixture(scope="session")
def empty_log(make_log):
    return make_log([])


@pytest.fixture(scope="session")
def diverse(make_log):
    """Thirty runs of three models over thirty days."""
    rows = []
    for i in range(30):
        links = ",".join(f'{{"url":"https://s{k}.example/{i}","text":"t{k}"}}' for k in range(i % 11))
        rows.append(
            {
                "query": f"prompt {i % 7}",
                "model": ["alpha", "beta", "gamma"][i % 3],
                "timestamp": datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(days=max(0, i - 3)),
                "answer_text": "x" * (100 + 163 * i),
                "sources": f"[{links}]",
                "execution_time_seconds": 5.0 + i * 1.9,
                "success": i % 5 != 0,
            }
        )
    return make_log(rows)


def rows_of(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def one(df) -> dict:
    rows = rows_of(df)
    assert len(rows) == 1
    return rows[0]
