"""Summary statistics. One aggregation each; empty input gives no row unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlog.functions import predicates as P
from answerlog.functions.scalars import (
    answer_length,
    json_array_length,
    model_label,
    source_count,
    success_number,
)
from answerlog.operators.distribution import quantiles, value_counts

TIME = "execution_time_seconds"


def _selected(
    results: DataFrame,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
    end_mode: str = "instant",
) -> DataFrame:
    """Runs of a model and a time range; of a log with its daily partitions only these days."""
    return results.filter(P.equals_model(model) & P.within(results, start, end, end_mode))


def _share(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """Share in floating point, 0 for an empty whole."""
    share = F.try_divide(part.cast("double") * factor, whole.cast("double"))
    return F.coalesce(share, F.lit(0.0))


def _successes() -> Column:
    return F.count_if(F.coalesce(F.col("success"), F.lit(False)))


def _zero_filled_mean(value: Column) -> Column:
    """Mean over all rows where a missing value counts 0."""
    return F.coalesce(
        F.try_divide(F.sum(F.coalesce(value, F.lit(0))).cast("double"), F.count(F.lit(1))),
        F.lit(0.0),
    )


def _six_numbers(rows: DataFrame, value: Column, total: str) -> DataFrame:
    """Mean, median, sample deviation, minimum, maximum and count of the known values.

    All six come from the counted values, so the log is read once.
    """
    counts = value_counts(rows.select(value.alias("value")), "value")
    number, times = F.col("value"), F.col("times")
    mean = counts.agg(F.sum(number * times) / F.sum(times)).scalar()
    median = quantiles(counts, [50]).select("value").scalar()
    squares = F.sum(times * (number - mean) * (number - mean))
    deviation = F.try_divide(squares, (F.sum(times) - 1).cast("double"))
    return (
        counts.agg(
            F.sqrt(F.coalesce(deviation, F.lit(0.0))).alias("std_dev"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.coalesce(F.sum("times"), F.lit(0)).alias(total),
        )
        .filter(F.col(total) > 0)
        .select(mean.alias("mean"), median.alias("median"), "std_dev", "min", "max", total)
    )


def execution_time_stats(
    results: DataFrame,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Six numbers of the known latencies."""
    return _six_numbers(_selected(results, model, start, end), F.col(TIME), "total_queries")


def answer_length_stats(
    results: DataFrame,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Six numbers of the answer lengths; empty answers count with length 0."""
    rows = _selected(results, model, start, end)
    return _six_numbers(rows, answer_length(F.col("answer_text")), "total_answers")


def source_count_stats(
    results: DataFrame,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Six numbers of the citation counts; malformed source text counts 0."""
    rows = _selected(results, model, start, end).filter(F.col("sources").isNotNull())
    return _six_numbers(rows, source_count(F.col("sources")), "total_results")


def success_rate_stats(
    results: DataFrame,
    model: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Counts and shares of successes and failures."""
    total, good = F.col("total"), F.col("successful")
    return (
        _selected(results, model, start, end)
        .agg(F.count(F.lit(1)).alias("total"), _successes().alias("successful"))
        .filter(total > 0)
        .select(
            "total",
            "successful",
            (total - good).alias("failed"),
            _share(good, total).alias("success_rate"),
            _share(total - good, total).alias("failure_rate"),
        )
    )


def model_comparison(
    results: DataFrame,
    query: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Per known model: mean known latency, success rate, mean length of non-empty answers."""
    rows = _selected(results, None, start, end).filter(F.col("model").isNotNull())
    if query:
        rows = rows.filter(F.col("query") == F.lit(query))
    length = F.when(F.col("answer_text") != "", answer_length(F.col("answer_text")))
    return rows.groupBy("model").agg(
        F.coalesce(F.avg(TIME), F.lit(0.0)).alias("execution_time_mean"),
        F.avg(success_number(F.col("success"))).alias("success_rate"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("answer_length_mean"),
        F.count(F.lit(1)).alias("count"),
    )


def database_summary(results: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals over the whole log, one row even when it is empty.

    ``approximate`` counts distinct prompts and models by a sketch, without the extra shuffle.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    totals = results.agg(
        F.count(F.lit(1)).alias("total_records"),
        _successes().alias("total_successful"),
        distinct("query").alias("unique_queries"),
        distinct("model").alias("unique_models"),
        F.min("timestamp").alias("date_range_start"),
        F.max("timestamp").alias("date_range_end"),
        F.coalesce(F.avg(TIME), F.lit(0.0)).alias("avg_execution_time"),
        F.coalesce(F.sum(source_count(F.col("sources"))), F.lit(0)).alias("total_sources"),
        F.coalesce(F.avg(F.length("answer_text")), F.lit(0.0)).alias("avg_answer_length"),
    )
    total, good = F.col("total_records"), F.col("total_successful")
    return totals.select(
        "total_records",
        "total_successful",
        (total - good).alias("total_failed"),
        _share(good, total).alias("success_rate"),
        "unique_queries",
        "unique_models",
        "date_range_start",
        "date_range_end",
        "avg_execution_time",
        "total_sources",
        "avg_answer_length",
    )


def database_stats(results: DataFrame) -> DataFrame:
    """The shorter overview, with the success rate in percent."""
    summary = database_summary(results)
    return summary.select(
        "total_records",
        "unique_models",
        "unique_queries",
        "date_range_start",
        "date_range_end",
        F.col("total_successful").alias("successful_records"),
        (F.col("success_rate") * 100).alias("success_rate"),
        "avg_execution_time",
        "avg_answer_length",
    )


def _model_stats(rows: DataFrame, last: Column) -> DataFrame:
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("record_count"),
        _successes().alias("successful"),
        F.avg(TIME).alias("avg_exec_time"),
        F.min(TIME).alias("min_exec_time"),
        F.max(TIME).alias("max_exec_time"),
        F.avg(F.length("answer_text")).alias("avg_answer_length"),
        last,
    )


def model_stats_all(
    results: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Per model, runs without a model included: counts, latency, length, distinct prompts."""
    rows = _selected(results, None, start, end, "end_of_day")
    stats = _model_stats(rows, F.countDistinct("query").alias("unique_queries"))
    return stats.orderBy(F.desc("record_count"), "model")


def model_stats_one(
    results: DataFrame, model: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One model, with the mean number of citations of well-formed source lists."""
    rows = _selected(results, model, start, end, "end_of_day")
    return _model_stats(rows, F.avg(json_array_length(F.col("sources"))).alias("avg_sources"))


def performance_comparison(
    results: DataFrame,
    query_pattern: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Per model label: count, success percent and means over all runs, missing values as 0."""
    rows = _selected(results, None, start, end, "end_of_day")
    if query_pattern:
        rows = rows.filter(P.like_pattern(F.col("query"), f"%{query_pattern}%"))
    return (
        rows.groupBy(model_label(F.col("model"), "default").alias("model"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            _share(_successes(), F.count(F.lit(1)), 100.0).alias("success_percent"),
            _zero_filled_mean(F.col(TIME)).alias("avg_time"),
            _zero_filled_mean(F.length("answer_text")).alias("avg_length"),
        )
        .orderBy("model")
    )


def comparison_table(results: DataFrame, query: str) -> DataFrame:
    """Models side by side for one prompt; a missing latency counts 0."""
    rows = results.filter(F.col("query") == F.lit(query))
    return _summary_rows(rows, model_label(F.col("model"), "unknown")).orderBy("model")


def summary_by_model(results: DataFrame) -> DataFrame:
    """Known models with count, success percent and mean latency, missing latency as 0."""
    rows = results.filter(F.col("model").isNotNull())
    return _summary_rows(rows, F.col("model")).orderBy("model")


def _summary_rows(rows: DataFrame, model: Column) -> DataFrame:
    return rows.groupBy(model.alias("model")).agg(
        F.count(F.lit(1)).alias("count"),
        _zero_filled_mean(F.col(TIME)).alias("avg_time"),
        _share(_successes(), F.count(F.lit(1)), 100.0).alias("success_percent"),
    )


def summary_overall(results: DataFrame) -> DataFrame:
    """Totals and means over all runs, missing values as 0."""
    sources = source_count(F.col("sources"))
    count = F.count(F.lit(1))
    return results.agg(
        count.alias("total_results"),
        F.sum(F.coalesce(F.col(TIME), F.lit(0.0))).alias("total_time"),
        _zero_filled_mean(F.col(TIME)).alias("avg_time"),
        _successes().alias("successful"),
        _share(_successes(), count, 100.0).alias("success_percent"),
        F.sum(sources).alias("total_sources"),
        _zero_filled_mean(sources).alias("avg_sources"),
        F.sum(F.coalesce(F.length("answer_text"), F.lit(0))).alias("total_chars"),
        _zero_filled_mean(F.length("answer_text")).alias("avg_chars"),
    ).filter(F.col("total_results") > 0)


def _shown_query(query: Column, chars: int = 50) -> Column:
    cut = F.concat(F.substring(query, 1, chars), F.lit("..."))
    return F.when(F.length(query) > chars, cut).otherwise(query)


def summary_query_counts(results: DataFrame, limit: int | None = None) -> DataFrame:
    """The prompts in alphabetical order, or the first of them, with their number of runs."""
    counts = results.groupBy("query").agg(F.count(F.lit(1)).alias("count")).orderBy("query")
    counts = counts if limit is None else counts.limit(limit)
    return counts.select(_shown_query(F.col("query")).alias("query"), "count")


def top_queries(results: DataFrame, limit: int | None = None) -> DataFrame:
    """The prompts, most runs first; all of them unless a limit is given."""
    counts = results.groupBy("query").agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), "query")
    return ordered if limit is None else ordered.limit(limit)


def first_appearance(observations: DataFrame) -> DataFrame:
    """Per selector the earliest check that found it, earliest selector marked.

    ``observations`` has ``entity, selector, elapsed, found, cnt``. ``min`` of a struct is
    combined inside each task, so one busy selector is no hot spot.
    """
    first = F.min(F.struct("elapsed", "entity", "cnt"))
    firsts = observations.filter("found").groupBy("selector").agg(first.alias("first"))
    best = firsts.agg(F.min(F.struct("first.elapsed", "selector"))["selector"]).scalar()
    return firsts.select(
        "selector",
        F.col("first.elapsed").alias("elapsed"),
        F.col("first.cnt").alias("cnt"),
        (F.col("selector") == best).alias("recommended"),
    ).orderBy("elapsed", "selector")
