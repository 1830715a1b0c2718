from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from answerlog.functions import predicates as P
from answerlog.operators import lookups
from answerlog.sources.results import with_parsed_sources
from tests.conftest import rows_of


def ids(df):
    return [row["id"] for row in df.select("id").collect()]


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(
        [
            {"query": "What is RAM?", "model": "m1", "timestamp": "2024-01-01 00:00:00", "answer_text": "Hello World", "sources": '[{"url":"https://A.example"}]', "execution_time_seconds": 0.0},
            {"query": "What is RAM?", "model": "m2", "timestamp": "2024-01-02 23:59:59", "answer_text": "100% sure_thing", "sources": "[]", "execution_time_seconds": -1.0},
            {"query": "", "model": None, "timestamp": "2024-01-03 00:00:00", "answer_text": "", "sources": "", "execution_time_seconds": None, "success": False},
            {"query": "日本 \\ query", "model": "", "timestamp": "2024-01-03 12:00:00", "answer_text": None, "sources": None, "execution_time_seconds": 1e6},
            {"query": "'; DROP TABLE results; --", "model": "m1", "timestamp": None, "answer_text": "😀", "sources": "bad", "execution_time_seconds": 3.5},
        ]
    )


def test_by_query_and_model(log):
    assert ids(lookups.by_query(log, "What is RAM?")) == [2, 1]
    assert ids(lookups.by_query(log, "What is RAM?", "m1")) == [1]
    assert ids(lookups.by_query(log, "What is RAM?", "")) == [2, 1]
    assert ids(lookups.by_query(log, "'; DROP TABLE results; --")) == [5]
    assert ids(lookups.by_query(log, "")) == [3]
    assert ids(lookups.by_model(log, "m1", 1)) == [1]


def test_recent_limits(log):
    assert ids(lookups.recent(log, 2)) == [4, 3]
    assert ids(lookups.recent(log, 0)) == []
    assert ids(lookups.recent(log, -1)) == [4, 3, 2, 1, 5]


def test_date_ranges(log):
    assert ids(lookups.by_date_range(log, "2024-01-02", "2024-01-03")) == [3, 2]
    assert ids(lookups.by_date_range(log, None, "2024-01-02", end_mode="end_of_day")) == [2, 1]
    assert ids(lookups.by_date_range(log, "2024-01-03", "2024-01-03", end_mode="date")) == [4, 3, 5]
    assert ids(lookups.by_date_range(log, "junk", "2024-01-01", end_mode="end_of_day")) == [1]
    assert ids(lookups.by_date_range(log, datetime.datetime(2024, 1, 3), "2024-01-03T11:59:59Z")) == [3]
    for mode in ("date", "instant"):
        with pytest.raises(ValueError):
            lookups.by_date_range(log, "junk", end_mode=mode)
    for limit in (0, -3, 1.5, True):
        with pytest.raises(ValueError):
            lookups.by_date_range(log, limit=limit)


def test_success_and_latency(log):
    assert ids(lookups.by_success(log, False)) == [3]
    assert ids(lookups.by_execution_time(log)) == [2, 1, 5, 4]
    assert ids(lookups.by_execution_time(log, 0, 3.5)) == [1, 5]
    assert ids(lookups.by_execution_time(log, limit=1)) == [2]


def test_text_search(log):
    assert ids(lookups.search(log, "WORLD")) == [1]
    assert ids(lookups.search(log, "WORLD", case_sensitive=True)) == []
    assert ids(lookups.search(log, "World", case_sensitive=True)) == [1]
    assert sorted(ids(lookups.search(log, ""))) == [1, 2, 3, 5]
    assert ids(lookups.search(log, "%")) == [2]
    assert ids(lookups.search(log, "*")) == []
    assert ids(lookups.search(log, "😀")) == [5]
    assert ids(lookups.search(log, "a.EXAMPLE", "sources")) == [1]
    assert ids(lookups.search(log, "URL", "sources")) == [1]
    assert ids(lookups.search(log, "ram", "queries", model="m2")) == [2]
    assert ids(lookups.search(log, "e", "all", limit=1)) == [4]
    with pytest.raises(ValueError):
        lookups.search(log, "x", "titles")


def test_like_patterns(log):
    assert ids(lookups.query_like(log, "what%")) == [2, 1]
    assert ids(lookups.query_like(log, "%\\%")) == [4]
    assert ids(lookups.query_like(log, "What_is RAM_")) == [2, 1]
    assert ids(lookups.query_like(log, "RAM")) == []


def test_advanced_filter(log):
    assert ids(lookups.advanced_filter(log, query_pattern="%ram%", sources=True)) == [1]
    assert ids(lookups.advanced_filter(log, sources=False)) == [4, 2]
    assert ids(lookups.advanced_filter(log, sources=False, sources_mode="parsed")) == [4, 3, 2, 5]
    assert ids(lookups.advanced_filter(log, min_length=1, max_length=11)) == [1, 5]
    assert ids(lookups.advanced_filter(log, order_by="id", descending=False, limit=2)) == [1, 2]
    assert ids(lookups.advanced_filter(log, order_by="evil; drop")) == [4, 3, 2, 1, 5]
    report = lookups.advanced_filter(log, query_pattern="ram", end="2024-01-02", profile="report")
    assert ids(report) == [2, 1]
    assert ids(lookups.advanced_filter(log, sources=True, profile="report")) == [2, 1, 5]
    with pytest.raises(ValueError):
        lookups.advanced_filter(log, order_by="evil", profile="report")
    with pytest.raises(ValueError):
        lookups.advanced_filter(log, profile="other")


def test_export_filters(log):
    rows, applied = lookups.export_filter(
        log, {"query_pattern": "ram", "start_date": "2024-01-01", "end_date": "2024-01-01"}
    )
    assert ids(rows) == [1] and applied == 2
    rows, applied = lookups.export_filter(log, {"max_exec_time": 0, "success": False})
    assert ids(rows) == [3] and applied == 2
    with pytest.raises(ValueError):
        lookups.export_filter(log, {"nope": 1})


def test_export_selection(log):
    assert ids(lookups.export_selection(log, query="What is RAM?", limit=1)) == [2, 1]
    assert ids(lookups.export_selection(log, model="m1", limit=1)) == [1]
    assert len(ids(lookups.export_selection(log))) == 5
    assert ids(lookups.export_selection(log, limit=1)) == [4]


def test_citation_tests(log):
    flags = log.orderBy("id").select(
        *[P.has_sources(F.col("sources"), mode) for mode in ("parsed", "not_empty_list", "not_blank")]
    )
    assert [tuple(row) for row in flags.collect()] == [
        (True, True, True),
        (False, False, True),
        (False, True, False),
        (False, False, False),
        (False, True, True),
    ]


def test_distinct_and_comparison(log):
    assert [r["model"] for r in rows_of(lookups.unique_models(log))] == ["", "m1", "m2"]
    assert len(rows_of(lookups.unique_queries(log))) == 4
    compared = rows_of(lookups.compare_models(log, "What is RAM?"))
    assert [r["model_label"] for r in compared] == ["m1", "m2"]
    latest = rows_of(lookups.latest_per_model(log, "What is RAM?"))
    assert {r["model_label"]: r["source_count"] for r in latest} == {"m1": 1, "m2": 0}


def test_parsed_sources(log):
    parsed = rows_of(with_parsed_sources(log).orderBy("id"))
    assert [len(row["sources"]) for row in parsed] == [1, 0, 0, 0, 0]


def test_latest_per_model_limits_groups_before_the_shuffle(log):
    plan = lookups.latest_per_model(log, "P")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_search_shuffles_its_matches_once(spark, diverse):
    for found in (lookups.search(diverse, "x"), lookups.query_like(diverse, "prompt%")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
        assert found.count() == 30
