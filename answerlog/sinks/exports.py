"""Writing the log as CSV, JSON and Markdown. Executors write; the driver sees counts only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from answerlog.functions import predicates as P
from answerlog.functions.scalars import (
    answer_length,
    export_key,
    model_label,
    period_key,
    safe_name,
    show_time,
    source_count,
)
from answerlog.operators import lookups
from answerlog.sinks import reports
from answerlog.sources.results import with_parsed_sources
from answerlog.session import open_files, with_number

FORMATS = ("json", "csv", "md")


def check_output(path: str, suffix: str | None = None) -> None:
    """Refuse a wrong ending, and a local path that is a symbolic link."""
    if not path:
        raise ValueError("an output path is required")
    if suffix and not path.lower().endswith(suffix):
        raise ValueError(f"output path must end with {suffix}, got {path!r}")
    local = path.removeprefix("file://")
    if "://" not in local and os.path.islink(local):
        raise ValueError(f"output path must not be a symbolic link: {path!r}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of everything below a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(folder).getLength()


def _require_rows(rows: DataFrame) -> None:
    if rows.isEmpty():
        raise ValueError("no results match the filters")


def _written(rows: DataFrame, path: str, write, filters_applied: int = 0) -> DataFrame:
    """Write once, count while writing, and return the export's summary row."""
    spark = rows.sparkSession
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    summary = [(path, seen.get["rows"], folder_bytes(spark, path), filters_applied)]
    return spark.createDataFrame(
        summary, "path string, record_count long, file_size_bytes long, filters_applied int"
    )


def _write_csv(
    rows: DataFrame, path: str, partition: str | None = None, compression: str = "none"
) -> None:
    writer = rows.write.mode("errorifexists").option("header", True).option("compression", compression)
    writer = writer.option("escape", '"').option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy(partition) if partition else writer).csv(path)


def csv_columns() -> dict[str, Column]:
    """Columns of the CSV export, with the number of links as text."""
    return {
        "id": F.col("id"),
        "query": F.col("query"),
        "model": model_label(F.col("model"), "unknown"),
        "timestamp": show_time(F.col("timestamp")),
        "answer_text": F.coalesce("answer_text", F.lit("")),
        "sources": source_count(F.col("sources")).cast("string"),
        "execution_time_seconds": F.coalesce("execution_time_seconds", F.lit(0.0)),
        "success": F.coalesce("success", F.lit(True)),
    }


def csv_rows(results: DataFrame, include_sources: bool = True) -> DataFrame:
    """Runs as rows of the CSV export."""
    columns = [column.alias(name) for name, column in csv_columns().items()]
    rows = results.select(*columns)
    return rows if include_sources else rows.drop("sources")


def export_csv(
    results: DataFrame, path: str, filters: dict | None = None, include_sources: bool = True
) -> DataFrame:
    """Filtered runs as CSV, newest first; an empty selection is an error."""
    check_output(path, ".csv")
    matches, applied = lookups.export_matches(results, filters)
    _require_rows(matches)
    rows = lookups.newest_first(matches)
    return _written(csv_rows(rows, include_sources), path, lambda r: _write_csv(r, path), applied)


def csv_report_rows(results: DataFrame, include_sources: bool = False) -> DataFrame:
    """Columns of the short CSV report: lengths and counts in place of texts."""
    rows = results.select(
        "id",
        "query",
        model_label(F.col("model"), "default").alias("model"),
        "timestamp",
        "success",
        "execution_time_seconds",
        F.coalesce(answer_length(F.col("answer_text")), F.lit(0)).alias("answer_length"),
        source_count(F.col("sources")).alias("source_count"),
    )
    return rows if include_sources else rows.drop("source_count")


def export_csv_report(
    results: DataFrame,
    path: str,
    include_sources: bool = False,
    limit: int | None = None,
    **conditions,
) -> DataFrame:
    """The short CSV report of an advanced filter, newest first."""
    check_output(path)
    _require_rows(lookups.advanced_matches(results, profile="report", **conditions))
    rows = lookups.advanced_filter(results, limit=limit, profile="report", **conditions)
    short = csv_report_rows(rows, include_sources)
    return _written(short, path, lambda r: _write_csv(r, path))


def export_json(
    results: DataFrame,
    path: str,
    query: str | None = None,
    model: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Whole runs with parsed links as JSON lines."""
    check_output(path)
    chosen = F.col("query") == F.lit(query) if query else P.equals_model(model)
    _require_rows(results.filter(chosen & P.equals_model(model)))
    rows = with_parsed_sources(lookups.export_selection(results, query, model, limit))
    return _written(rows, path, lambda r: r.write.mode("errorifexists").json(path))


def json_documents(results: DataFrame) -> DataFrame:
    """One JSON document per run under its own name: ``key, document``."""
    missing = {"id", "query", "timestamp"} - set(results.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    key = export_key(F.col("query"), F.col("timestamp"), F.col("model"))
    whole = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})
    return results.select(key.alias("key"), whole.alias("document"))


def export_json_documents(results: DataFrame, path: str) -> DataFrame:
    """Documents with their names as one table; a file per run would not scale."""
    check_output(path)
    documents = json_documents(with_parsed_sources(results))
    return _written(documents, path, lambda r: r.write.mode("errorifexists").parquet(path))


def export_markdown(
    results: DataFrame, path: str, filters: dict | None = None, full: bool = True
) -> DataFrame:
    """Filtered runs as Markdown blocks, newest first, after a heading with the total."""
    check_output(path, ".md")
    rows, applied = lookups.export_matches(results, filters)
    _require_rows(rows)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    heading = rows.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(0).alias("section"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(0).cast("long").alias("id"),
        F.concat_ws(
            "\n\n",
            F.lit("# Search Results Export"),
            F.concat(F.lit("Generated: "), now),
            F.concat(F.lit("Total Results: "), F.col("total").cast("string")),
            F.lit(f"Filters Applied: {applied}") if applied else F.lit(None),
            F.lit("## Results\n"),
        ).alias("value"),
    )
    blocks = with_parsed_sources(rows).select(
        F.lit(1).alias("section"), "timestamp", "id", reports.markdown_block(full).alias("value")
    )
    pieces = heading.unionByName(blocks).orderBy("section", F.desc("timestamp"), F.desc("id"))
    return _written(
        pieces.select("value"), path, lambda r: r.write.mode("errorifexists").text(path), applied
    ).withColumn("record_count", F.col("record_count") - 1)


def export_markdown_report(
    results: DataFrame, path: str, full: bool = True, limit: int | None = None, **conditions
) -> DataFrame:
    """Numbered sections of an advanced filter, newest first."""
    check_output(path)
    rows = lookups.advanced_matches(results, profile="report", **conditions)
    _require_rows(rows)
    if limit is not None:
        rows = lookups.newest_first(rows, limit)
    numbered = with_number(rows, ["timestamp", "id"], "number", 1, descending=True)
    numbered = with_parsed_sources(numbered)
    sections = numbered.orderBy("number").select(reports.report_block(full).alias("value"))
    return _written(sections, path, lambda r: r.write.mode("errorifexists").text(path))


def export_report(pieces: DataFrame, path: str) -> DataFrame:
    """Write a comparison or summary report."""
    check_output(path, ".md")
    _require_rows(pieces)
    lines = pieces.orderBy("section", "place").select(F.col("line").alias("value"))
    return _written(lines, path, lambda r: r.write.mode("errorifexists").text(path))


def model_groups(results: DataFrame) -> DataFrame:
    """Known models under a name that is safe in paths."""
    known = results.filter(F.coalesce("model", F.lit("")) != "")
    return known.withColumn("group_key", safe_name(F.col("model")))


def period_groups(results: DataFrame, period: str = "day") -> DataFrame:
    """Runs under their day, ISO week or month."""
    if period not in ("day", "week", "month"):
        raise ValueError(f"period must be day, week or month, got {period!r}")
    return results.withColumn("group_key", period_key(F.col("timestamp"), period, "iso"))


def label_groups(results: DataFrame, by: str = "model") -> DataFrame:
    """Runs under their model label or their date."""
    if by not in ("model", "date"):
        raise ValueError(f"group by model or date, got {by!r}")
    day = F.coalesce(F.substring(F.col("timestamp").cast("string"), 1, 10), F.lit("unknown"))
    key = model_label(F.col("model"), "default") if by == "model" else day
    return results.withColumn("group_key", key)


def group_counts(grouped: DataFrame) -> DataFrame:
    """Runs per export group."""
    return grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("record_count"))


FILE_RUNS = 5_000  # a group is gathered where its files would hold fewer runs on average
MOST_GROUPS = 200  # files that a task holds open


def _tasks_in_place(grouped: DataFrame) -> int:
    """How many tasks may each write a file per group, or 0 if the groups are to be gathered."""
    runs, groups = group_counts(grouped).agg(F.sum("record_count"), F.count(F.lit(1))).first()
    if not runs:
        raise ValueError("no results match the filters")
    tasks = runs // (groups * FILE_RUNS)
    least = grouped.sparkSession.sparkContext.defaultParallelism
    return tasks if groups <= MOST_GROUPS and tasks >= least else 0


def export_groups(
    grouped: DataFrame, path: str, format: str = "json", compression: str = "gzip"
) -> DataFrame:
    """One folder per group, and the manifest: ``group_key, record_count, files, bytes``.

    Where every task has thousands of runs of each group on average, tasks write what they
    hold, and no text is shuffled. Else rows are range-partitioned by group and id, so small
    groups share a task and a group with most of the rows is written by many tasks.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    check_output(path)
    tasks = _tasks_in_place(grouped)
    if tasks:
        spread, files = grouped.coalesce(tasks), MOST_GROUPS
    else:
        spread = grouped.repartitionByRange("group_key", "id").sortWithinPartitions("group_key", "id")
        files = 0
    if format == "csv":
        columns = [column.alias(name) for name, column in csv_columns().items()]
        rows = spread.select("group_key", *columns)
    elif format == "json":
        rows = with_parsed_sources(spread)
    else:
        block = _guarded(reports.markdown_block(full=True)).alias("value")
        rows = with_parsed_sources(spread).select("group_key", block)
    with open_files(grouped.sparkSession, files):
        if format == "csv":
            _write_csv(rows, path, "group_key", compression)
        else:
            writer = rows.write.mode("errorifexists").option("compression", compression)
            if format == "json":
                writer.partitionBy("group_key").json(path)
            else:
                writer.option("lineSep", BLOCK_END).partitionBy("group_key").text(path)
    return manifest(grouped.sparkSession, path, format)


# Ends every Markdown block of a file. It is not shown, and no text can hold it: where one
# does, it gets a backslash more before its last word.
BLOCK_END = "<!-- end of block -->\n\n"
_END_IN_TEXT = r"(<!-- end of )(\\*block -->)"


def _guarded(block: Column) -> Column:
    return F.regexp_replace(block, _END_IN_TEXT, r"$1\\$2")


def _unguarded(block: Column) -> Column:
    return F.regexp_replace(block, r"(<!-- end of )\\(\\*block -->)", "$1$2")


def read_groups(spark: SparkSession, path: str, format: str) -> DataFrame:
    """What the files of :func:`export_groups` hold, with the ``group_key`` of each record.

    CSV gives its columns as text, Markdown a ``value`` per block, JSON a ``value`` per line.
    """
    if format == "csv":
        fields = ", ".join(f"{name} string" for name in [*csv_columns(), "group_key"])
        reader = spark.read.schema(fields).option("header", True).option("escape", '"')
        return reader.option("multiLine", True).csv(path)
    reader = spark.read.schema("value string, group_key string")
    if format == "json":
        return reader.text(path)
    return reader.option("lineSep", BLOCK_END).text(path).withColumn("value", _unguarded(F.col("value")))


def manifest(spark: SparkSession, path: str, format: str) -> DataFrame:
    """The records that the files of each group hold, and number and size of the files."""
    # The group is a column of the path; given as text it is not guessed to be a date.
    listing = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary, group_key string"
    )
    files = (
        listing.load(path)
        .groupBy("group_key")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )
    counts = group_counts(read_groups(spark, path, format))
    return counts.join(files, "group_key", "left").orderBy("group_key")
