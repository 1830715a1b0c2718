"""Percentiles, outliers and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.functions import predicates as P
from answerlog.session import pin

DEFAULT_PERCENTILES = [25, 50, 75, 90, 95, 99]


def _metric(metric: str) -> Column:
    from answerlog.operators.timeseries import metric_value

    return metric_value(metric)


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    """Known values in order and how often each occurs: ``value, times, place``, pinned.

    The rows are read once; whatever is derived from the counts does not read them again.
    The counts lie in value order over range partitions, and ``place`` holds the partition.
    """
    counted = (
        rows.select(F.col(value).cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    ordered = counted.repartitionByRange("value").sortWithinPartitions("value")
    return pin(ordered.withColumn("place", F.monotonically_increasing_id()))


def quantiles(counts: DataFrame, percents: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each: ``percentile, value``.

    ``counts`` comes from :func:`value_counts`. The totals per partition (a few numbers)
    tell which partitions hold the wanted ranks, and only those are ranked. No task sees
    more than one range of the values, where Spark's own ``percentile`` merges all distinct
    values into one task.
    """
    spark = counts.sparkSession
    counted = counts.withColumn("part", F.shiftrightunsigned("place", 33))
    sizes = counted.groupBy("part").agg(F.sum("times").alias("size")).orderBy("part").collect()
    total = sum(row["size"] for row in sizes)
    wanted, before = [], {}
    for percent in sorted(set(percents)) if total else []:
        rank = percent / 100.0 * (total - 1)
        low = int(rank)
        wanted.append((float(percent), low, min(low + 1, total - 1), rank - low))
    first = 0
    for row in sizes:
        end = first + row["size"]
        if any(first <= rank < end for _, low, high, _ in wanted for rank in (low, high)):
            before[row["part"]] = first
        first = end
    offsets = spark.createDataFrame(list(before.items()), "part long, first long")
    targets = spark.createDataFrame(
        wanted, "percentile double, low long, high long, fraction double"
    )
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(F.broadcast(offsets), "part").withColumn(
        "end", F.col("first") + F.sum("times").over(upto)
    )
    start = F.col("end") - F.col("times")

    def covers(rank: str) -> Column:
        return (F.col(rank) >= start) & (F.col(rank) < F.col("end"))

    low_value = F.max(F.when(covers("low"), F.col("value")))
    high_value = F.max(F.when(covers("high"), F.col("value")))
    fraction = F.first("fraction")
    return (
        ranked.join(F.broadcast(targets), covers("low") | covers("high"))
        .groupBy("percentile")
        .agg((low_value * (1 - fraction) + high_value * fraction).alias("value"))
    )


def percentiles(
    results: DataFrame,
    metric: str = "execution_time",
    percents: list[float] | None = None,
    model: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Percentiles of a metric; ``approximate`` answers from a sketch in a single pass."""
    percents = DEFAULT_PERCENTILES if percents is None else percents
    if not all(0 <= percent <= 100 for percent in percents):
        raise ValueError("percentiles lie between 0 and 100")
    rows = results.filter(P.equals_model(model)).select(_metric(metric).alias("value"))
    if approximate:
        shares = F.array(*[F.lit(percent / 100.0) for percent in percents])
        names = F.array(*[F.lit(float(percent)) for percent in percents])
        found = rows.agg(F.percentile_approx("value", shares, 100_000).alias("found"))
        pairs = found.select(F.explode(F.arrays_zip(names.alias("p"), "found")).alias("pair"))
        return pairs.select(
            F.col("pair.p").alias("percentile"), F.col("pair.found").alias("value")
        ).filter(F.col("value").isNotNull())
    return quantiles(value_counts(rows, "value"), percents).orderBy("percentile")


def outliers(
    results: DataFrame,
    metric: str = "execution_time",
    deviations: float = 3.0,
    model: str | None = None,
) -> DataFrame:
    """Runs further from the mean than ``deviations`` sample deviations.

    Mean and deviation are a one-row subquery, so the rows are never shuffled.
    """
    value = _metric(metric)
    rows = results.filter(P.equals_model(model) & value.isNotNull())
    spread = F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread")
    stats = rows.agg(F.struct(F.avg(value).alias("mean"), spread)).scalar()
    far = F.abs(value - stats["mean"]) > F.lit(deviations) * stats["spread"]
    return rows.filter((stats["spread"] > 0) & far)


def histogram(
    results: DataFrame,
    metric: str = "execution_time",
    bins: int = 10,
    model: str | None = None,
) -> DataFrame:
    """Equal-width intervals from minimum to maximum, half open but for the last.

    Empty intervals are kept; if all values are equal there is one interval.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    values = (
        results.filter(P.equals_model(model))
        .select(_metric(metric).alias("value"), F.lit(1).alias("times"))
        .filter(F.col("value").isNotNull())
    )
    if metric != "execution_time":
        # Few distinct values: both passes below read the shuffled counts, not the texts.
        values = values.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    bounds = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).filter(
        F.col("low").isNotNull()
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    guess = F.floor((F.col("value") - F.col("low")) / width)
    # Division and interval edges round differently; the edges decide.
    edge = F.when(F.col("value") >= F.col("low") + (guess + 1) * width, 1).when(
        F.col("value") < F.col("low") + guess * width, -1
    )
    inside = F.least(guess + F.coalesce(edge, F.lit(0)), F.lit(bins - 1))
    place = F.when(width > 0, inside).otherwise(F.lit(0))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    counts = (
        values.withColumns({"low": low, "high": high})
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.sum("times").alias("count"))
    )
    last = F.when(F.col("high") > F.col("low"), F.lit(bins - 1)).otherwise(F.lit(0))
    frame = bounds.withColumn("width", width).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), last))
    )
    start = F.col("low") + F.col("bin") * F.col("width")
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        start.alias("bin_start"),
        (start + F.col("width")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    ).orderBy("bin")
