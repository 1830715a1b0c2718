"""Lookups that return whole runs: filters, text search, newest-first reads.

Ties in an ordering are broken by ``id``, newest first, so results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.functions import predicates as P
from answerlog.functions.scalars import answer_length, model_label, source_count

ORDER_COLUMNS = ("timestamp", "query", "model", "execution_time_seconds", "id")


def without_day(results: DataFrame) -> DataFrame:
    """Runs without the column of the daily partitions, which only serves for pruning."""
    return results.drop(P.DAY)


def newest_first(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest runs first; with a limit Spark keeps a top-k per task instead of sorting all.

    Of a log with its daily partitions a limit reads only the newest days that hold so many.
    """
    if limit is not None and P.DAY in results.columns:
        results = results.filter(_newest_days(results, limit))
    results = without_day(results)
    ordered = results.orderBy(F.desc("timestamp"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def _newest_days(results: DataFrame, limit: int) -> Column:
    """The newest days with at least ``limit`` runs, by a count per day that reads no texts."""
    counts = results.groupBy(P.DAY).agg(F.count(F.lit(1)).alias("count"))
    missing, first = limit, None
    for day, count in sorted((r for r in counts.collect() if r[0] is not None), reverse=True):
        missing, first = missing - count, day
        if missing <= 0:
            return F.col(P.DAY) >= F.lit(first)
    return F.lit(True)


def by_query(results: DataFrame, query: str, model: str | None = None) -> DataFrame:
    """Runs of one prompt, of one model if given."""
    return newest_first(results.filter((F.col("query") == F.lit(query)) & P.equals_model(model)))


def by_model(results: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Runs of one model, newest first; all of them unless a limit is given."""
    return recent(results.filter(F.col("model") == F.lit(model)), -1 if limit is None else limit)


def recent(results: DataFrame, limit: int) -> DataFrame:
    """The newest runs; 0 gives none and a negative limit gives all."""
    return newest_first(results, None if limit < 0 else limit)


def by_date_range(
    results: DataFrame,
    start: str | None = None,
    end: str | None = None,
    model: str | None = None,
    limit: int | None = None,
    end_mode: str = "instant",
) -> DataFrame:
    """Runs within a time range, both ends included."""
    P.check_limit(limit)
    window = P.within(results, start, end, end_mode)
    return newest_first(results.filter(window & P.equals_model(model)), limit)


def by_success(results: DataFrame, success: bool = True, limit: int | None = None) -> DataFrame:
    """Runs that succeeded, or that failed."""
    P.check_limit(limit)
    return newest_first(results.filter(F.col("success") == F.lit(success)), limit)


def by_execution_time(
    results: DataFrame,
    low: float | None = None,
    high: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Runs with a known latency in a range, fastest first."""
    P.check_limit(limit)
    time = F.col("execution_time_seconds")
    kept = results.filter(time.isNotNull() & P.value_range(time, low, high))
    ordered = kept.orderBy(F.asc("execution_time_seconds"), F.asc("id"))
    return ordered if limit is None else ordered.limit(limit)


def search(
    results: DataFrame,
    term: str,
    search_in: str = "answers",
    case_sensitive: bool = False,
    model: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Runs whose answer, raw source text, prompt or any of these contains a term."""
    P.check_limit(limit)
    found = results.filter(P.search_term(term, search_in, case_sensitive, model))
    return newest_first(found, limit)


def query_like(results: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Runs whose prompt matches a LIKE pattern."""
    P.check_limit(limit)
    found = results.filter(P.like_pattern(F.col("query"), pattern))
    return newest_first(found, limit)


def advanced_matches(
    results: DataFrame,
    query_pattern: str | None = None,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
    success: bool | None = None,
    min_time: float | None = None,
    max_time: float | None = None,
    min_length: int | None = None,
    max_length: int | None = None,
    sources: bool | None = None,
    sources_mode: str | None = None,
    profile: str = "library",
) -> DataFrame:
    """Runs that meet all given conditions, in no order.

    Profile ``library``: the pattern is used as it is and bounds are points in time.
    Profile ``report``: the pattern may match anywhere and bounds are dates up to 23:59:59.
    """
    if profile not in ("library", "report"):
        raise ValueError(f"unknown profile {profile!r}")
    report = profile == "report"
    conditions = [
        P.equals_model(model),
        P.within(results, start, end, "end_of_day" if report else "instant"),
        P.value_range(F.col("execution_time_seconds"), min_time, max_time),
        P.value_range(F.length("answer_text"), min_length, max_length),
    ]
    if query_pattern:
        pattern = f"%{query_pattern}%" if report else query_pattern
        conditions.append(P.like_pattern(F.col("query"), pattern))
    if success is not None:
        conditions.append(F.col("success") == F.lit(success))
    if sources or (sources is False and not report):
        mode = sources_mode or ("not_blank" if report else "not_empty_list")
        cited = P.has_sources(F.col("sources"), mode)
        conditions.append(cited if sources else ~cited)
    return without_day(results.filter(P.all_of(conditions)))


def advanced_filter(
    results: DataFrame,
    order_by: str = "timestamp",
    descending: bool = True,
    limit: int | None = None,
    profile: str = "library",
    **conditions,
) -> DataFrame:
    """The matches of :func:`advanced_matches` in a chosen order.

    An unknown order column means ``timestamp``; in the ``report`` profile it is an error.
    """
    P.check_limit(limit)
    if order_by not in ORDER_COLUMNS:
        if profile == "report":
            raise ValueError(f"order_by must be one of {ORDER_COLUMNS}, got {order_by!r}")
        order_by = "timestamp"
    direction = F.desc if descending else F.asc
    matches = advanced_matches(results, profile=profile, **conditions)
    ordered = matches.orderBy(direction(order_by), direction("id"))
    return ordered if limit is None else ordered.limit(limit)


EXPORT_FILTERS = (
    "query_pattern",
    "model",
    "success",
    "min_exec_time",
    "max_exec_time",
    "start_date",
    "end_date",
)


def export_matches(results: DataFrame, filters: dict | None = None) -> tuple[DataFrame, int]:
    """Rows for an export and how many filters were applied (both dates are one).

    The prompt pattern is a plain substring; a missing latency counts as 0.
    """
    filters = filters or {}
    unknown = set(filters) - set(EXPORT_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    time = F.coalesce(F.col("execution_time_seconds"), F.lit(0.0))
    conditions: list[Column | None] = []
    if "query_pattern" in filters:
        conditions.append(P.contains_text(F.col("query"), filters["query_pattern"]))
    if "model" in filters:
        conditions.append(F.col("model").eqNullSafe(F.lit(filters["model"])))
    if "success" in filters:
        conditions.append(F.col("success") == F.lit(filters["success"]))
    if "min_exec_time" in filters:
        conditions.append(time >= F.lit(filters["min_exec_time"]))
    if "max_exec_time" in filters:
        conditions.append(time <= F.lit(filters["max_exec_time"]))
    start, end = filters.get("start_date"), filters.get("end_date")
    if start or end:
        conditions.append(P.within(results, start, end, "date"))
    return without_day(results.filter(P.all_of(conditions))), len(conditions)


def export_filter(results: DataFrame, filters: dict | None = None) -> tuple[DataFrame, int]:
    """The rows of :func:`export_matches`, newest first, and the number of filters."""
    matches, applied = export_matches(results, filters)
    return newest_first(matches), applied


def export_selection(
    results: DataFrame,
    query: str | None = None,
    model: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows for a JSON export: a prompt wins over a model, a model over the newest rows."""
    if query:
        return by_query(results, query, model)
    if model:
        return by_model(results, model, limit)
    return recent(results, limit or -1)


def unique_queries(results: DataFrame) -> DataFrame:
    """All prompts once, in order."""
    return results.select("query").distinct().orderBy("query")


def unique_models(results: DataFrame) -> DataFrame:
    """All known models once, in order."""
    return results.filter(F.col("model").isNotNull()).select("model").distinct().orderBy("model")


def compare_models(results: DataFrame, query: str) -> DataFrame:
    """Runs of one prompt under their model label, newest first within a model."""
    return (
        results.filter(F.col("query") == F.lit(query))
        .withColumn("model_label", model_label(F.col("model"), "unknown"))
        .orderBy("model_label", F.desc("timestamp"), F.desc("id"))
    )


def latest_per_model(results: DataFrame, query: str) -> DataFrame:
    """The newest run of each model for one prompt, with answer length and citation count.

    The rank filter becomes a per-task group limit, so a model with most of the rows sends
    only its candidates through the shuffle.
    """
    newest = Window.partitionBy("model_label").orderBy(F.desc("timestamp"), F.desc("id"))
    return (
        results.filter(F.col("query") == F.lit(query))
        .select(
            model_label(F.col("model"), "unknown").alias("model_label"),
            "id",
            "timestamp",
            "execution_time_seconds",
            F.coalesce(answer_length(F.col("answer_text")), F.lit(0)).alias("answer_length"),
            source_count(F.col("sources")).alias("source_count"),
        )
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") == 1)
        .drop("place")
    )
