"""Structured Streaming forms of appending, trends and stability checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from answerlog.operators import timeseries
from answerlog.sources import results
from answerlog.sources.commits import CommitLog


def _writer(batch: DataFrame, name: str | None) -> str:
    """Who writes: the given name, or the id that a query keeps with its checkpoint."""
    own = name or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not own:
        raise ValueError("the query has no id here; name the writer")
    return own


def append_stream(
    runs: DataFrame, path: str, writer: str | None = None, patience: float = 3600.0
) -> DataStreamWriter:
    """Append arriving runs to the log of :func:`answerlog.sources.results.append_results`.

    A run is added once by its id, however late it or its copy arrives and whoever wrote the
    first; runs without an id get one. A micro-batch that is run again after a failure is
    known by the query's id (or ``writer``) and its number. Missing columns get the defaults
    of a batch. Set the checkpoint location before starting.
    """

    def write(batch: DataFrame, number: int) -> None:
        results.append_arrived(batch, path, _writer(batch, writer), number, patience)

    return runs.writeStream.foreachBatch(write)


def trend_stream(runs: DataFrame, path: str, writer: str | None = None) -> DataStreamWriter:
    """Add the hourly sums of every micro-batch to a table of partial sums.

    :func:`trend_parts` reads the table. Sums of one hour from many batches are added when
    they are read, so a run counts however late it comes, and the last hour is there at once.
    """

    def write(batch: DataFrame, number: int) -> None:
        log = CommitLog(batch.sparkSession, path)
        name = _writer(batch, writer)
        intent = log.earlier(name, number)
        if intent is None:
            intent = log.reserve(name, number, 0)
            log.note(intent)
        elif log.outcome(intent.number):
            return
        parts = timeseries.hourly_parts(batch)
        folder = f"{path}/batch={intent.number}"
        parts.write.mode("overwrite").parquet(folder)
        log.commit(intent, 0)

    return runs.writeStream.foreachBatch(write)


def trend_parts(spark, path: str) -> DataFrame:
    """The committed partial sums, for :func:`answerlog.operators.timeseries.trend_of_parts`
    and :func:`answerlog.operators.timeseries.volume_of_parts`."""
    table = spark.read.schema(f"{timeseries.PARTS}, batch long").parquet(path)
    return table.filter(CommitLog(spark, path).visible()).drop("batch")
