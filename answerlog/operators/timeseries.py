"""Counts and means per hour, day, week or month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlog.functions import predicates as P
from answerlog.functions.scalars import check_period, period_key, success_number

METRICS = ("execution_time", "success_rate", "answer_length")


def check_metric(metric: str, allowed: tuple[str, ...] = METRICS) -> None:
    if metric not in allowed:
        raise ValueError(f"metric must be one of {allowed}, got {metric!r}")


def metric_value(metric: str):
    """The metric of one run as a column."""
    check_metric(metric)
    return {
        "execution_time": F.col("execution_time_seconds"),
        "success_rate": success_number(F.col("success")),
        "answer_length": F.length("answer_text"),
    }[metric].cast("double")


def query_volume(
    results: DataFrame, period: str = "day", model: str | None = None, limit: int | None = None
) -> DataFrame:
    """Runs per period, newest period first; all periods unless a limit is given."""
    check_period(period)
    P.check_limit(limit)
    counts = (
        results.filter(P.equals_model(model))
        .groupBy(period_key(F.col("timestamp"), period).alias("period"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("period"))
    )
    return counts if limit is None else counts.limit(limit)


def trend(
    results: DataFrame,
    metric: str = "execution_time",
    period: str = "day",
    model: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Mean of a metric per period over the runs that have it, newest period first; all
    periods unless a limit is given."""
    check_period(period)
    P.check_limit(limit)
    means = (
        results.filter(P.equals_model(model))
        .select(
            period_key(F.col("timestamp"), period).alias("period"),
            metric_value(metric).alias("value"),
        )
        .filter(F.col("value").isNotNull())
        .groupBy("period")
        .agg(F.avg("value").alias("value"))
        .orderBy(F.desc("period"))
    )
    return means if limit is None else means.limit(limit)


def trend_report(
    results: DataFrame,
    metric: str,
    period: str,
    limit: int | None = None,
    model: str | None = None,
) -> DataFrame:
    """Mean and number of runs per period; a period without any value shows NULL.

    Success is in percent. ``query_volume`` gives runs and distinct prompts.
    """
    check_period(period)
    P.check_limit(limit)
    check_metric(metric, METRICS + ("query_volume",))
    rows = results.filter(P.equals_model(model)).withColumn(
        "period", period_key(F.col("timestamp"), period, "short")
    )
    if metric == "query_volume":
        grouped = rows.groupBy("period").agg(
            F.count(F.lit(1)).cast("double").alias("value"),
            F.countDistinct("query").alias("count"),
        )
    else:
        factor = 100.0 if metric == "success_rate" else 1.0
        grouped = rows.groupBy("period").agg(
            (F.avg(metric_value(metric)) * factor).alias("value"),
            F.count(F.lit(1)).alias("count"),
        )
    ordered = grouped.orderBy(F.desc("period"))
    return ordered if limit is None else ordered.limit(limit)


# Partial sums: per hour and model the runs, and number and sum of the known values of each
# metric. Sums of the same hour are added, so they may come in any order and number.
PARTS = "hour timestamp_ntz, model string, runs long, " + ", ".join(
    f"{metric}_n long, {metric}_sum double" for metric in METRICS
)


def hourly_parts(results: DataFrame) -> DataFrame:
    """The partial sums of some runs."""
    hour = period_key(F.col("timestamp"), "hour").cast("timestamp_ntz")
    sums = [
        column
        for metric in METRICS
        for column in (
            F.count(metric_value(metric)).alias(f"{metric}_n"),
            F.sum(metric_value(metric)).alias(f"{metric}_sum"),
        )
    ]
    return results.groupBy(hour.alias("hour"), "model").agg(F.count(F.lit(1)).alias("runs"), *sums)


def volume_of_parts(parts: DataFrame, period: str = "day", model: str | None = None) -> DataFrame:
    """:func:`query_volume` of the runs that partial sums were made of."""
    check_period(period)
    grouped = parts.filter(P.equals_model(model)).groupBy(period_key(F.col("hour"), period).alias("period"))
    return grouped.agg(F.sum("runs").alias("count")).orderBy(F.desc("period"))


def trend_of_parts(
    parts: DataFrame, metric: str = "execution_time", period: str = "day", model: str | None = None
) -> DataFrame:
    """:func:`trend` of the runs that partial sums were made of."""
    check_period(period)
    check_metric(metric)
    grouped = parts.filter(P.equals_model(model)).groupBy(period_key(F.col("hour"), period).alias("period"))
    sums = grouped.agg(F.sum(f"{metric}_n").alias("n"), F.sum(f"{metric}_sum").alias("sum"))
    value = F.col("sum") / F.col("n")
    return sums.filter("n > 0").select("period", value.alias("value")).orderBy(F.desc("period"))
