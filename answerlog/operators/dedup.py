"""Exact duplicates: finding them, choosing which run to keep, and what would go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.session import join_groups

KEEP = ("latest", "earliest", "best")


def duplicate_queries(results: DataFrame) -> DataFrame:
    """Prompts with more than one run, most frequent first."""
    return (
        results.groupBy(F.col("query").alias("query_text"))
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > 1)
        .orderBy(F.desc("count"), "query_text")
    )


def _group_key(ignore_case: bool) -> Column:
    return (F.lower("query") if ignore_case else F.col("query")).alias("group_query")


def duplicate_groups(results: DataFrame, ignore_case: bool = False) -> DataFrame:
    """One row per prompt with several runs: number of runs and of distinct known models."""
    return (
        results.groupBy(_group_key(ignore_case))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.countDistinct("model").alias("model_count"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
        .filter(F.col("count") > 1)
    )


def duplicate_group_members(results: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Ids and models of every duplicate group, one row per run.

    The list of a group is given in rows, since one group may hold most of the table.
    """
    rows = results.select(_group_key(ignore_case), "id", "model")
    groups = duplicate_groups(results, ignore_case).select("group_query", "count")
    return join_groups(rows, groups, ["group_query"])


def duplicate_group_models(results: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Distinct known models of every duplicate group, one row per model."""
    groups = duplicate_groups(results, ignore_case).select("group_query")
    models = (
        results.filter(F.col("model").isNotNull())
        .select(_group_key(ignore_case), "model")
        .distinct()
    )
    return models.join(groups, "group_query", "left_semi")


def keepers(results: DataFrame, keep: str = "latest") -> DataFrame:
    """Ids of the run to keep for each prompt and model; a missing model is a group of its own.

    ``best`` is the fastest success; an unknown latency comes before all others. Only the
    sort columns take part, and the rank filter is applied in every task before the shuffle.
    """
    orders = {
        "latest": [F.desc("timestamp"), F.desc("id")],
        "earliest": [F.asc("timestamp"), F.asc("id")],
        "best": [F.desc("success"), F.asc_nulls_first("execution_time_seconds"), F.asc("id")],
    }
    if keep not in orders:
        raise ValueError(f"keep must be one of {KEEP}, got {keep!r}")
    place = F.row_number().over(Window.partitionBy("query", "model").orderBy(*orders[keep]))
    return results.withColumn("place", place).filter(F.col("place") == 1).select("id")


def deduplicate(results: DataFrame, keep: str = "latest") -> DataFrame:
    """The kept runs. Whole rows are only joined by their unique id."""
    return results.join(keepers(results, keep), "id", "left_semi")


def removable(results: DataFrame, keep: str = "latest") -> DataFrame:
    """Ids that :func:`deduplicate` leaves out; nothing is changed."""
    return results.select("id").join(keepers(results, keep), "id", "left_anti")


def removal_report(results: DataFrame, keep: str = "latest") -> DataFrame:
    """How many runs would be kept and removed."""
    groups = results.groupBy("query", "model").agg(F.count(F.lit(1)).alias("size"))
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}, got {keep!r}")
    return groups.agg(
        F.count(F.lit(1)).alias("kept_count"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("removed_count"),
    )


def first_of_triplet(results: DataFrame) -> DataFrame:
    """Smallest id for each prompt, model and time."""
    return results.groupBy("query", "model", "timestamp").agg(F.min("id").alias("id")).select("id")


def deduplicate_triplets(results: DataFrame) -> DataFrame:
    """One run for each prompt, model and time: the one with the smallest id."""
    return results.join(first_of_triplet(results), "id", "left_semi")


def removable_triplets(results: DataFrame) -> DataFrame:
    """The runs that :func:`deduplicate_triplets` leaves out."""
    return results.join(first_of_triplet(results), "id", "left_anti")
