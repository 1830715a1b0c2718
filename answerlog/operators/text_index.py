"""Text search in a stored log that reads only files which can hold the term.

Beside the log lies an index of trigrams: which file holds, in any of its searchable texts,
a run of three characters, in lower case and in one of ``BUCKETS`` classes. A file that
lacks a class of the term cannot hold the term and is not read. The index is a table sorted
by class, so a search reads the few row groups with the classes of its term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlog import schema
from answerlog.functions import predicates as P
from answerlog.operators import lookups
from answerlog.sources import results
from answerlog.sources.commits import CommitLog

BUCKETS = 1 << 18
GRAMS = "bucket int, file string, batch long"
WIDTH = 3


def _grams(text: Column) -> Column:
    """Classes of all runs of three characters, each once."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=(...))"), F.lit(1))
    return F.array_distinct(F.transform(runs, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))


def _numbers(names: dict[str, int], ending: str) -> set[int]:
    return {int(name[:19]) for name, size in names.items() if name.endswith(ending) and size}


def index_texts(spark: SparkSession, path: str) -> int:
    """Index the committed batches that are not indexed yet; their number.

    A batch counts as indexed once its file ``<number>.grams`` is there, so an index that
    was left half written is written again, and doubled rows do no harm.
    """
    log = CommitLog(spark, path)
    names = log.names()
    missing = sorted(_numbers(names, ".done") - _numbers(names, ".grams"))
    if missing:
        rows = results.stored(spark, path).filter(F.col("batch").isin(missing)).select(
            F.col("_metadata.file_path").alias("file"), "batch", *P.SEARCH_COLUMNS.values()
        )
        every = F.concat(*[_grams(F.col(name)) for name in P.SEARCH_COLUMNS.values()])
        found = rows.select("file", "batch", F.explode(F.array_distinct(every)).alias("bucket")).distinct()
        spread = found.repartitionByRange("bucket", "file").sortWithinPartitions("bucket", "file")
        spread.select("bucket", "file", "batch").write.mode("append").parquet(f"{log.root}/grams")
        for number in missing:
            log.create(f"{number:019d}.grams", "indexed")
    return len(missing)


def files_with(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """The indexed files that can hold a term; None if the index does not tell."""
    log = CommitLog(spark, path)
    if len(term.lower()) < WIDTH or not _numbers(log.names(), ".grams"):
        return None
    wanted = spark.range(1).select(_grams(F.lit(term)).alias("x")).first()["x"]
    rows = spark.read.schema(GRAMS).parquet(f"{log.root}/grams").filter(F.col("bucket").isin(wanted) & log.visible())
    held = rows.groupBy("file").agg(F.count_distinct("bucket").alias("n")).filter(F.col("n") == len(wanted))
    return sorted(r["file"] for r in held.select("file").collect())


def search_stored(
    spark: SparkSession,
    path: str,
    term: str,
    search_in: str = "answers",
    case_sensitive: bool = False,
    model: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """:func:`answerlog.operators.lookups.search` over a stored log, from the files that can
    hold the term and from batches that are not indexed. Terms of less than three characters
    are looked for everywhere."""
    files = files_with(spark, path, term)
    if files is None:
        found = results.scan_results(spark, path)
    else:
        log = CommitLog(spark, path)
        indexed = sorted(_numbers(log.names(), ".grams"))
        names = schema.RESULTS.names
        found = results.scan_results(spark, path, batches=~F.col("batch").isin(indexed))
        if files:
            some = spark.read.schema(schema.RESULTS).parquet(*files)
            found = found.unionByName(some.select(*names))
    return lookups.search(found, term, search_in, case_sensitive, model, limit)
