from __future__ import annotations

import random
import statistics

import pytest

from answerlog.operators import distribution, rollups, timeseries
from tests.conftest import one, rows_of


@pytest.fixture(scope="module")
def runs(diverse):
    return rows_of(diverse)


def test_six_numbers(diverse, runs):
    times = [r["execution_time_seconds"] for r in runs]
    got = one(rollups.execution_time_stats(diverse))
    assert got["total_queries"] == 30
    assert got["mean"] == pytest.approx(statistics.mean(times))
    assert got["median"] == pytest.approx(statistics.median(times))
    assert got["std_dev"] == pytest.approx(statistics.stdev(times))
    assert (got["min"], got["max"]) == (min(times), max(times))
    lengths = [len(r["answer_text"]) for r in runs if r["model"] == "beta"]
    got = one(rollups.answer_length_stats(diverse, "beta"))
    assert got["median"] == statistics.median(lengths) and got["total_answers"] == 10
    counts = [i % 11 for i in range(30)]
    got = one(rollups.source_count_stats(diverse))
    assert got["mean"] == pytest.approx(statistics.mean(counts)) and got["max"] == 10


def test_single_and_empty(make_log, empty_log):
    single = make_log([{"execution_time_seconds": 10.5, "answer_text": "x" * 9, "sources": "[1]"}])
    got = one(rollups.execution_time_stats(single))
    assert got == {"mean": 10.5, "median": 10.5, "std_dev": 0.0, "min": 10.5, "max": 10.5, "total_queries": 1}
    assert rows_of(rollups.execution_time_stats(empty_log)) == []
    assert rows_of(rollups.success_rate_stats(empty_log)) == []
    assert rows_of(rollups.summary_overall(empty_log)) == []
    assert rows_of(rollups.model_comparison(empty_log)) == []
    assert rows_of(distribution.percentiles(empty_log)) == []
    assert rows_of(distribution.histogram(empty_log)) == []
    assert rows_of(distribution.outliers(empty_log)) == []
    summary = one(rollups.database_summary(empty_log))
    assert summary["date_range_start"] is None
    assert {v for k, v in summary.items() if not k.startswith("date")} == {0}


def test_totals_agree(diverse):
    summary = one(rollups.database_summary(diverse))
    rates = one(rollups.success_rate_stats(diverse))
    models = rows_of(rollups.model_comparison(diverse))
    assert summary["total_records"] == rates["total"] == sum(m["count"] for m in models) == 30
    assert summary["success_rate"] == pytest.approx(rates["success_rate"])
    assert rates["success_rate"] + rates["failure_rate"] == pytest.approx(1)
    assert summary["unique_queries"] == 7 and summary["unique_models"] == 3
    approximate = one(rollups.database_summary(diverse, approximate=True))
    assert approximate["unique_queries"] == 7
    volume = rows_of(timeseries.query_volume(diverse, "day", limit=100))
    assert sum(v["count"] for v in volume) == 30
    assert [v["period"] for v in volume] == sorted((v["period"] for v in volume), reverse=True)
    stats = one(rollups.database_stats(diverse))
    assert stats["success_rate"] == pytest.approx(100 * rates["success_rate"])


def test_missing_values(make_log):
    log = make_log(
        [
            {"model": "m", "execution_time_seconds": 4.0, "answer_text": "abcd", "sources": "[1,2]"},
            {"model": "m", "answer_text": "", "success": False, "sources": "oops"},
            {"model": "m", "success": None},
            {"model": None, "execution_time_seconds": 1.0},
        ]
    )
    m = one(rollups.model_comparison(log))
    assert (m["execution_time_mean"], m["answer_length_mean"]) == (4.0, 4.0)
    assert m["success_rate"] == pytest.approx(1 / 3)
    per_model = {r["model"]: r for r in rows_of(rollups.model_stats_all(log))}
    assert per_model["m"]["avg_answer_length"] == 2.0 and None in per_model
    assert one(rollups.model_stats_one(log, "m"))["avg_sources"] == 2.0
    shown = {r["model"]: r for r in rows_of(rollups.performance_comparison(log))}
    assert shown["m"]["avg_time"] == pytest.approx(4 / 3) and "default" in shown
    table = {r["model"]: r for r in rows_of(rollups.comparison_table(log, "P"))}
    assert table["m"]["avg_time"] == pytest.approx(4 / 3) and "unknown" in table
    assert one(rollups.summary_by_model(log))["count"] == 3
    overall = one(rollups.summary_overall(log))
    assert overall["total_sources"] == 2 and overall["avg_chars"] == 1.0
    trend = one(timeseries.trend_report(log, "answer_length", "day"))
    assert trend["period"] is None and trend["value"] == 2.0 and trend["count"] == 4


def test_query_counts(make_log):
    log = make_log([{"query": q} for q in ["b", "a", "b", "c" * 60]])
    counts = rows_of(rollups.summary_query_counts(log, 3))
    assert [(r["query"], r["count"]) for r in counts] == [("a", 1), ("b", 2), ("c" * 50 + "...", 1)]
    assert rows_of(rollups.top_queries(log, 1)) == [{"query": "b", "count": 2}]


def test_trends(diverse, runs):
    for metric in timeseries.METRICS:
        for period in ("hour", "day", "week", "month"):
            values = rows_of(timeseries.trend(diverse, metric, period))
            assert 0 < len(values) <= 30
    first_day = rows_of(timeseries.trend(diverse, "execution_time", "day"))[-1]
    times = [r["execution_time_seconds"] for r in runs[:4]]
    assert first_day == {"period": "2024-01-01 00:00:00", "value": pytest.approx(statistics.mean(times))}
    volume = rows_of(timeseries.trend_report(diverse, "query_volume", "month"))
    assert volume == [{"period": "2024-01", "value": 30.0, "count": 7}]
    for call in (
        lambda: timeseries.trend(diverse, "nope"),
        lambda: timeseries.trend(diverse, period="year"),
        lambda: timeseries.query_volume(diverse, limit=0),
        lambda: timeseries.trend_report(diverse, "nope", "day"),
    ):
        with pytest.raises(ValueError):
            call()


def test_percentiles_interpolate_over_many_partitions(spark, make_log):
    rnd = random.Random(3)
    values = [round(rnd.choice([rnd.gauss(50, 9), 7.0]), 3) for _ in range(2000)]
    log = make_log([{"execution_time_seconds": v} for v in values])
    percents = [0, 12.5, 25, 50, 75, 90, 95, 99, 100]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["percentile"]: r["value"] for r in rows_of(distribution.percentiles(log, percents=percents))}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(values)
    for percent in percents:
        place = percent / 100 * (len(ordered) - 1)
        low = int(place)
        high = min(low + 1, len(ordered) - 1)
        want = ordered[low] * (1 - place + low) + ordered[high] * (place - low)
        assert got[percent] == pytest.approx(want)
    sketch = {r["percentile"]: r["value"] for r in rows_of(distribution.percentiles(log, percents=[50], approximate=True))}
    assert sketch[50] == pytest.approx(got[50], abs=0.1)
    with pytest.raises(ValueError):
        distribution.percentiles(log, percents=[101])


def test_outliers(make_log):
    log = make_log([{"execution_time_seconds": v} for v in [1.0, 1.1, 0.9] * 10 + [50.0]])
    assert [r["id"] for r in rows_of(distribution.outliers(log))] == [31]
    flat = make_log([{"execution_time_seconds": 2.0}] * 5)
    assert rows_of(distribution.outliers(flat)) == []


def test_histograms(make_log):
    rnd = random.Random(4)
    values = [round(rnd.uniform(0, 3), 1) for _ in range(500)]
    log = make_log([{"execution_time_seconds": v, "answer_text": "x" * int(v * 10)} for v in values])
    for metric, given in [("execution_time", values), ("answer_length", [float(int(v * 10)) for v in values])]:
        for bins in (1, 3, 7, 10):
            got = rows_of(distribution.histogram(log, metric, bins))
            low, width = min(given), (max(given) - min(given)) / bins
            want = [0] * bins
            for v in given:
                place = max(i for i in range(bins) if v >= low + i * width)
                want[place] += 1
            assert [r["count"] for r in got] == want and sum(want) == 500
    flat = make_log([{"execution_time_seconds": 2.0}] * 5)
    assert rows_of(distribution.histogram(flat)) == [
        {"bin": 0, "bin_start": 2.0, "bin_end": 2.0, "count": 5}
    ]
    with pytest.raises(ValueError):
        distribution.histogram(flat, bins=0)


def test_first_appearance(spark):
    data = [
        ("a", "s1", 1.0, False, 0),
        ("a", "s1", 2.0, True, 4),
        ("a", "s2", 1.5, True, 2),
        ("a", "s1", 3.0, True, 9),
        ("a", "s3", 1.0, False, 0),
    ]
    df = spark.createDataFrame(data, "entity string, selector string, elapsed double, found boolean, cnt int")
    assert rows_of(rollups.first_appearance(df)) == [
        {"selector": "s2", "elapsed": 1.5, "cnt": 2, "recommended": True},
        {"selector": "s1", "elapsed": 2.0, "cnt": 4, "recommended": False},
    ]
