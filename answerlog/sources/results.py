"""Reading and appending the results table.

The table is stored by day and batch (``dt=…/batch=…``), by batch jobs and streams alike;
``batch`` is the number of its commit (see :mod:`answerlog.sources.commits`). Beside the
runs, each batch keeps fences: which blocks of ids it holds on which day. So a run that
arrives is looked for in the few days whose batches can hold its id, not in the whole log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlog import schema
from answerlog.functions.scalars import parse_sources
from answerlog.session import numbered, open_files, pin, with_dense_index
from answerlog.sources.commits import CommitLog, Intent

FENCE = 12  # a fence is a block of 2**12 ids
FENCES = "block long, dt date, batch long"
FEW_IDS = 1_000_000  # so many ids are broadcast
TASK_RUNS = 25_000  # a batch of more runs may be written by more tasks than there are cores
FILE_RUNS = 5_000  # an appended batch is gathered by day where its files would hold fewer runs on average
MOST_RUNS = 100_000  # of a task that holds the files of its days open, some 100 MB of answers in zstd
MOST_DAYS = 200  # files that a task holds open
ORDER = ("timestamp", "query", "model", "execution_time_seconds")


def scan_results(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    keep_day: bool = False,
    batches: Column | None = None,
) -> DataFrame:
    """Read the committed runs of a results table.

    ``start`` and ``end`` are dates; they prune the daily partitions. With ``keep_day`` the
    column ``dt`` of these partitions stays, and lookups with date bounds prune by it.
    ``batches`` is a further condition on the number of the ``batch``.
    """
    visible, table = CommitLog(spark, path).visible(), stored(spark, path)
    if start:
        table = table.filter(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        table = table.filter(F.col("dt") <= F.lit(end).cast("date"))
    table = table.filter(visible)
    if batches is not None:
        table = table.filter(batches)
    return table.select(*schema.RESULTS.names, *["dt"] * keep_day)


def with_parsed_sources(results: DataFrame) -> DataFrame:
    """Replace the raw ``sources`` text by an array of links; bad or missing text gives []."""
    return results.withColumn("sources", parse_sources(F.col("sources")))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All that lies in the folders of a log, with ``dt`` and ``batch``, committed or not."""
    parts = [T.StructField("dt", T.DateType()), T.StructField("batch", T.LongType())]
    return spark.read.schema(T.StructType([*schema.RESULTS.fields, *parts])).parquet(path)


def _write(rows: DataFrame, path: str, intent: Intent) -> int:
    """Write the runs of a batch and then its fences; the number of runs."""
    spark = rows.sparkSession
    daily = rows.select(*schema.RESULTS.names, F.to_date("timestamp").alias("dt"), F.lit(intent.number).alias("batch"))
    writer = daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("compression", "zstd")
    writer.partitionBy("dt", "batch").parquet(path)
    mine = stored(spark, path).filter(F.col("batch") == intent.number)
    fences = mine.groupBy(F.shiftright("id", FENCE).alias("block"), "dt").agg(F.count(F.lit(1)).alias("runs"))
    folder = f"{path}/_log/fences/batch={intent.number}"
    fences.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder).agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]


def write_runs(rows: DataFrame, path: str) -> None:
    """Add runs that have ids, none of which the log holds yet, as one batch."""
    log = CommitLog(rows.sparkSession, path)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    intent = log.reserve(f"runs-{uuid.uuid4().hex}", 0, 0, low, high)
    log.commit(intent, _write(rows, path, intent))


def append_results(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """Add a batch of runs and return it, as the log holds it, with its new ids, which go on
    after the largest id.

    Runs are numbered in the order of their time, and only the columns of that order are
    shuffled for it. The ids are a block reserved beforehand, so writers append side by side.
    The batch is read more than once and has to hold the same runs each time.
    """
    rows, keys = numbered(schema.conform(batch).drop("id"), list(ORDER), "_number")
    rows = rows.withColumn("id", F.col("_number"))
    count, days = keys.agg(F.count(F.lit(1)), F.countDistinct(F.to_date("timestamp"))).first()
    if not count:
        return rows.select(*schema.RESULTS.names)
    log = CommitLog(spark, path)
    intent = log.reserve(f"append-{uuid.uuid4().hex}", 0, count)
    rows = rows.withColumn("id", F.col("_number") + F.lit(intent.first))
    tasks = _tasks_in_place(spark, count, days)
    if tasks:
        with open_files(spark, MOST_DAYS):
            size = _write(rows.coalesce(tasks), path, intent)
    else:
        size = _write(_gathered(rows, count), path, intent)
    log.commit(intent, size)
    return scan_results(spark, path, batches=F.col("batch") == F.lit(intent.number))


def _tasks_in_place(spark: SparkSession, count: int, days: int) -> int:
    """How many tasks may each write a file per day, or 0 if the runs are to be gathered."""
    tasks = count // (days * FILE_RUNS)
    fits = days <= MOST_DAYS and tasks >= spark.sparkContext.defaultParallelism
    return max(tasks, count // MOST_RUNS) if fits else 0


def _gathered(rows: DataFrame, count: int) -> DataFrame:
    """Rows with a ``_number`` from 0 on in as few tasks as can hold them, those of a day together."""
    tasks = count // TASK_RUNS + 1
    task = F.floor(F.col("_number") * F.lit(tasks) / F.lit(count)).cast("int")
    return rows.repartitionById(tasks, F.least(task, F.lit(tasks - 1)))


def append_arrived(
    batch: DataFrame, path: str, writer: str, number: int, patience: float = 3600.0
) -> None:
    """Add a batch of a stream; a run with an id that the log holds already is a copy.

    A batch is known by its writer and number: once committed it is not added again, and
    tried again it takes the number and the ids of the first try. Runs without an id get
    one. The batch is read more than once and has to hold the same runs each time, as the
    batches of a stream do; only its ids are pinned. Writers that bring the same ids take turns: each looks for its ids when the
    batches before it are committed, or given up after ``patience`` seconds.
    """
    spark = batch.sparkSession
    log = CommitLog(spark, path)
    intent = log.earlier(writer, number)
    if intent and log.outcome(intent.number):
        return
    arrived = schema.conform(batch)
    named, nameless = arrived.filter("id IS NOT NULL"), arrived.filter("id IS NULL")
    ids = pin(arrived.select("id"))
    low, high, missing, count = ids.agg(
        F.min("id"), F.max("id"), F.count_if(F.col("id").isNull()), F.count(F.lit(1))
    ).first()
    if not count:
        return
    if intent is None:
        intent = log.reserve(writer, number, missing, low, high)
        log.note(intent)
    log.wait_for_earlier(intent, patience)
    fresh = named if low is None else _added_once(named, ids.filter("id IS NOT NULL"), path)
    if missing:
        order = [F.col(name) for name in ORDER]
        fresh = fresh.unionByName(with_dense_index(nameless.drop("id"), order, "id", intent.first).select(*fresh.columns))
    # A task writes a file per day, so a small batch is not written by many tasks.
    tasks = max(spark.sparkContext.defaultParallelism, count // TASK_RUNS + 1)
    log.commit(intent, _write(fresh.coalesce(tasks), path, intent))


def _added_once(rows: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """Runs whose id no committed batch holds, one of each id; ``ids`` are those of ``rows``.

    What to leave out is found by the ids alone. Where that is little, as in most batches, it
    is broadcast and the runs stay where they are; else they are shuffled by their ids.
    """
    known = pin(ids.join(known_ids(ids, path), "id", "left_semi").distinct())
    size = known.count()
    if size:
        rows = rows.join(F.broadcast(known) if size <= FEW_IDS else known, "id", "left_anti")
    repeated = pin(ids.groupBy("id").count().filter("count > 1").select("id"))
    size = repeated.count()
    if size > FEW_IDS:
        return rows.dropDuplicates(["id"])
    if not size:
        return rows
    again = rows.join(F.broadcast(repeated), "id", "left_semi").dropDuplicates(["id"])
    return rows.join(F.broadcast(repeated), "id", "left_anti").unionByName(again)


def holding_days(rows: DataFrame, path: str) -> list:
    """The days whose committed batches can hold an id of ``rows``; read from the fences.
    There are no more of them than days in the calendar."""
    spark = rows.sparkSession
    log = CommitLog(spark, path)
    if not any(size for name, size in log.names().items() if name.endswith(".done")):
        return []
    blocks = rows.select(F.shiftright("id", FENCE).alias("block")).distinct()
    low, high = blocks.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return []
    fences = spark.read.schema(FENCES).parquet(f"{log.root}/fences")
    near = fences.filter(log.visible() & F.col("block").between(low, high))
    return [r["dt"] for r in near.join(blocks, "block", "left_semi").select("dt").distinct().collect()]


def known_ids(rows: DataFrame, path: str) -> DataFrame:
    """Ids of the days that can hold an id of ``rows``."""
    spark = rows.sparkSession
    days = holding_days(rows, path)
    inside = F.col("dt").isin([day for day in days if day is not None])
    inside = inside | F.col("dt").isNull() if None in days else inside
    if not days:
        return spark.createDataFrame([], "id long")
    return stored(spark, path).filter(CommitLog(spark, path).visible() & inside).select("id")


def without_known(rows: DataFrame, path: str) -> DataFrame:
    """Runs whose id no committed batch of the log holds."""
    return rows.join(known_ids(rows, path), "id", "left_anti")
