"""Lookups by date read only the days they need."""

from __future__ import annotations

import re

import pytest

from answerlog.operators import lookups, retention, rollups
from answerlog.session import new_folder
from answerlog.sources import results
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def stored(spark, diverse):
    path = new_folder(spark, "days")
    results.append_results(spark, diverse, path)
    return results.scan_results(spark, path, keep_day=True)


def partition_filters(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(re.findall(r"PartitionFilters: \[(.*?)(?:\], PushedFilters|\.\.\.)", plan))


def same(left, right):
    assert rows_of(left.orderBy("id")) == rows_of(right.orderBy("id"))
    assert left.count()


@pytest.mark.parametrize("end_mode", ["instant", "end_of_day", "date"])
def test_ranges_prune_days(stored, end_mode):
    found = lookups.by_date_range(stored, "2024-01-05", "2024-01-09", end_mode=end_mode)
    assert "dt" in partition_filters(found) and "dt" not in found.columns
    same(found, lookups.by_date_range(stored.drop("dt"), "2024-01-05", "2024-01-09", end_mode=end_mode))


def test_filters_and_archives_prune_days(stored):
    plain = stored.drop("dt")
    bounds = {"start": "2024-01-05", "end": "2024-01-09"}
    for profile in ("library", "report"):
        found = lookups.advanced_filter(stored, profile=profile, **bounds)
        assert "dt" in partition_filters(found)
        same(found, lookups.advanced_filter(plain, profile=profile, **bounds))
    dates = {"start_date": "2024-01-05", "end_date": "2024-01-09"}
    found, _ = lookups.export_matches(stored, dates)
    assert "dt" in partition_filters(found)
    same(found, lookups.export_matches(plain, dates)[0])
    old, rest = retention.archive_split(stored, "2024-01-10")
    assert "dt" in partition_filters(old) and "dt" in partition_filters(rest)
    same(old, retention.archive_split(plain, "2024-01-10")[0])
    same(rest, retention.archive_split(plain, "2024-01-10")[1])
    same(retention.failed_runs(stored, "2024-01-20"), retention.failed_runs(plain, "2024-01-20"))
    same(retention.without_failed(stored, "2024-01-20"), retention.without_failed(plain, "2024-01-20"))


@pytest.mark.parametrize(
    "statistic",
    [rollups.execution_time_stats, rollups.answer_length_stats, rollups.source_count_stats, rollups.success_rate_stats,
     rollups.model_comparison, rollups.model_stats_all, rollups.performance_comparison,
     lambda rows, start, end: rollups.model_stats_one(rows, "beta", start, end)],
)
def test_statistics_prune_days(stored, statistic):
    bounds = {"start": "2024-01-05", "end": "2024-01-20"}
    seen = rollups._selected(stored, None, **bounds)
    assert "dt" in partition_filters(seen)
    got = sorted(map(str, rows_of(statistic(stored, **bounds))))
    assert got == sorted(map(str, rows_of(statistic(stored.drop("dt"), **bounds)))) and got


def test_the_newest_runs_come_from_the_newest_days(spark, stored):
    found = lookups.recent(stored, 5)
    assert "dt" in partition_filters(found) and "dt" not in found.columns
    assert rows_of(found) == rows_of(lookups.recent(stored.drop("dt"), 5))
    assert rows_of(lookups.recent(stored, 1000)) == rows_of(lookups.recent(stored.drop("dt"), 1000))
    assert rows_of(lookups.by_model(stored, "beta", 3)) == rows_of(lookups.by_model(stored.drop("dt"), "beta", 3))
    assert lookups.recent(stored, 0).count() == 0
