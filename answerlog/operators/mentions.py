"""Who is mentioned, who is cited, and how answers change over time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.functions.scalars import check_period, domain_of_url, model_label, period_key
from answerlog.session import pin

MOST_TERMS = 1_000_000
FOUND = "array<struct<term:int,mentions:int>>"


def _mentions(spark: SparkSession, terms: list[str]):
    """For a text the terms it holds and how often, by one pass over the text."""
    shared = spark.sparkContext.broadcast(terms)
    built: list = []

    @F.pandas_udf(FOUND)
    def mentions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not built:
            automaton = ahocorasick.Automaton()
            for number, term in enumerate(shared.value):
                automaton.add_word(term, number)
            automaton.make_automaton()
            built.append(automaton)
        for texts in batches:
            counts = (Counter(number for _, number in built[0].iter(text)) for text in texts)
            yield pd.Series([[{"term": k, "mentions": n} for k, n in found.items()] for found in counts])

    return mentions


def mention_share(results: DataFrame, terms: DataFrame, period: str = "month") -> DataFrame:
    """Per model label, period and term: ``answers`` of the model in the period, how many of
    them are ``mentioning`` the term, all ``mentions``, and the ``share`` of the answers.

    ``terms`` has a column ``term``; case is folded, equal terms count once and empty ones
    not at all. Every occurrence counts, also inside a longer term or overlapping one. Runs
    without an answer are left out; a term that nobody mentions in a period has no row.
    All terms are looked for in one pass over an answer, so their number hardly matters.
    """
    check_period(period)
    folded = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct()
    known = [r["term"] for r in folded.limit(MOST_TERMS + 1).collect()]
    if len(known) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms; share them out over several calls")
    spark = results.sparkSession
    answers = results.filter(F.col("answer_text") != "").select(
        model_label(F.col("model"), "unknown").alias("model"),
        period_key(F.col("timestamp"), period).alias("period"),
        F.lower("answer_text").alias("text"),
    )
    keys = ["model", "period"]
    if not known:
        return spark.createDataFrame([], "model string, period string, term string, answers long, "
                                         "mentioning long, mentions long, share double")
    found = answers.select(*keys, _mentions(spark, known)("text").alias("found"))
    # One pass gives both: a row per term of an answer, and one with term -1 per answer.
    none = F.array(F.struct(F.lit(-1).alias("term"), F.lit(0).alias("mentions")))
    each = found.select(*keys, F.explode(F.concat(none, "found")).alias("x")).groupBy(*keys, "x.term").agg(
        F.count(F.lit(1)).alias("mentioning"), F.sum("x.mentions").alias("mentions")
    )
    answered = F.max(F.when(F.col("term") < 0, F.col("mentioning"))).over(Window.partitionBy(*keys))
    named = spark.createDataFrame(list(enumerate(known)), "number int, name string")
    counted = each.withColumn("answers", answered).join(F.broadcast(named), F.col("term") == F.col("number"))
    share = F.col("mentioning").cast("double") / F.col("answers")
    return counted.select(*keys, F.col("name").alias("term"), "answers", "mentioning", "mentions", share.alias("share"))


def domain_citation_share(links: DataFrame) -> DataFrame:
    """Per model label and domain: ``citations`` and their ``share`` of the model's citations.

    ``links`` has ``model`` and ``url``; a url without a host is under the domain ``''``.
    """
    counts = links.groupBy(
        model_label(F.col("model"), "unknown").alias("model"), domain_of_url(F.col("url")).alias("domain")
    ).agg(F.count(F.lit(1)).alias("citations"))
    counts = pin(counts)
    totals = counts.groupBy(F.col("model").alias("of")).agg(F.sum("citations").alias("total"))
    share = F.col("citations").cast("double") / F.col("total")
    return counts.join(totals, F.col("model") == F.col("of")).select("model", "domain", "citations", share.alias("share"))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """``rows`` with the ``value`` of the row before in its group, null for the first.

    The rows are range-partitioned by group and order, so a group with most of the rows is
    spread over many tasks. A partition learns what came before it from one row per group
    that lies in several partitions; of such groups there are fewer than partitions.
    """
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = pin(sorted_.withColumn("_chunk", F.spark_partition_id()))
    last = placed.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    spans = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("_chunks")).filter("_chunks > 1").drop("_chunks")

    def equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        same = F.lit(True)
        for name in names:
            same = same & left[name].eqNullSafe(right[f"_{name}"])
        return same

    spans = F.broadcast(spans.withColumnsRenamed({key: f"_{key}" for key in keys}))
    crossing = last.join(spans, equal(last, spans, keys), "left_semi")
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before")
    carried = crossing.select(*[F.col(key).alias(f"_{key}") for key in keys], F.col("_chunk").alias("__chunk"), before)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    near = placed.withColumns({into: F.lag(value).over(local), "_first": F.row_number().over(local) == 1})
    joined = near.join(F.broadcast(carried), equal(near, carried, keys + ["_chunk"]), "left")
    whole = F.when(F.col("_first"), F.col("_before")[value]).otherwise(F.col(into))
    return joined.withColumn(into, whole).select(*rows.columns, into)


def answer_change(results: DataFrame, period: str = "month") -> DataFrame:
    """Per prompt, model label and period: answers ``compared`` with the one before them by
    the same model to the same prompt, how many ``changed``, and the ``rate``.

    A change counts in the period of the later answer. Runs without an answer are passed
    over; the first answer has nothing before it. Only hashes of the answers are moved.
    """
    check_period(period)
    answers = results.filter(F.col("answer_text") != "").select(
        "query", model_label(F.col("model"), "unknown").alias("model"), "timestamp", "id",
        F.md5("answer_text").alias("digest"),
    )
    pairs = with_previous(answers, ["query", "model"], ["timestamp", "id"], "digest", "before").filter("before IS NOT NULL")
    counted = pairs.groupBy("query", "model", period_key(F.col("timestamp"), period).alias("period")).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("digest") != F.col("before")).alias("changed")
    )
    return counted.withColumn("rate", F.col("changed").cast("double") / F.col("compared"))
