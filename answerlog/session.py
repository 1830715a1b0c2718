"""Session helpers: shared folder, lineage cuts and a scalable dense row index."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
_LOCK = threading.Lock()
_OPEN: WeakKeyDictionary[SparkSession, tuple[str, list[int]]] = WeakKeyDictionary()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers this package, whatever folder the driver was started in.

    The package goes as one archive with the application's files, once per application.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="answerlog-"), "answerlog")
        root = os.path.dirname(package)
        archive = shutil.make_archive(target, "zip", root, os.path.basename(package))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of about 4 MB, as texts may be long. Spark's 64 MB
    are held several times over, in the executor and in each worker. A setting of the application stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(setting):
        spark.conf.set(setting, "4m")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an
    unset folder is an error, because a machine-local path is lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="answerlog-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet below the shared folder."""
    return f"{shared_dir(spark)}/answerlog/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def open_files(spark: SparkSession, count: int) -> Iterator[None]:
    """Let a task write ``count`` partitions of a table side by side, so it need not sort its rows
    by them. Of writers in several threads the largest count holds until the last has ended."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    with _LOCK:
        before, counts = _OPEN.setdefault(spark, (spark.conf.get(setting), []))
        counts.append(count)
        spark.conf.set(setting, max(counts))
    try:
        yield
    finally:
        with _LOCK:
            counts.remove(count)
            spark.conf.set(setting, max(counts) if counts else before)
            if not counts:
                del _OPEN[spark]


def with_dense_index(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order`` without a global window.

    A range shuffle sorts the rows over many tasks; each row gets its place in its
    partition, and the partition offsets (one small row per partition) are broadcast.
    The rows are pinned first, since range bounds may differ between two evaluations.
    """
    placed = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_place", 33)
    rows = placed.withColumn("_part", part)
    return _counted_on(rows, rows.groupBy("_part").count(), name, start)


def _counted_on(rows: DataFrame, sizes: DataFrame, name: str, start: int) -> DataFrame:
    """Turn the place of a row in its partition into one among all: the counts of the ``_part``
    before its own are added."""
    offsets, total = [], start
    for row in sizes.orderBy("_part").collect():
        offsets.append((row["_part"], total))
        total += row["count"]
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_offset", "_place")
    )


def with_number(
    df: DataFrame, by: list[str], name: str, start: int = 0, descending: bool = False
) -> DataFrame:
    """Number wide rows in the order of some columns, without moving them.

    See :func:`numbered`. Equal keys get their numbers in any order, which may differ between
    two readings. NULL is smaller than any value.
    """
    return numbered(df, by, name, start, descending)[0]


def numbered(
    df: DataFrame, by: list[str], name: str, start: int = 0, descending: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows with their numbers, and the keys alone: ``*by, name``, pinned.

    The plan of ``df`` is fixed, and its rows are sorted in the partitions they are in. The
    columns ``by`` and the partition of each row are shuffled and numbered; each partition gets
    its numbers back, which in ascending order are those of its sorted rows. ``df`` has to give
    the same rows each time it is read, else an error is raised; if it does not, use
    :func:`with_dense_index`, which pins the rows.
    """
    order = [F.desc(column) if descending else F.asc(column) for column in by]
    spark, ordered = df.sparkSession, df.sortWithinPartitions(*order)
    rows, schema = ordered._jdf.toJavaRDD(), ordered._jdf.schema()
    encoders = spark._jvm.org.apache.spark.sql.Encoders
    fixed = DataFrame(spark._jsparkSession.createDataset(rows.rdd(), encoders.row(schema)), spark)
    keys = fixed.select(*by, F.spark_partition_id().alias("_at"))
    keys = with_dense_index(keys, [*order, F.asc("_at")], name, start)
    if keys.isEmpty():
        return fixed.withColumn(name, F.lit(None).cast("long")), keys.drop("_at")
    numbers = (
        keys.select("_at", name, F.xxhash64(*by).alias("_key"))
        .repartitionById(rows.getNumPartitions(), F.col("_at"))
        .sortWithinPartitions(name)
        .drop("_at")
    )
    both = encoders.tuple(encoders.row(schema), encoders.row(numbers._jdf.schema()))
    pairs = rows.zip(numbers._jdf.toJavaRDD()).rdd()
    pairs = DataFrame(spark._jsparkSession.createDataset(pairs, both).toDF(), spark)
    same = F.xxhash64(*[F.col("_1")[column] for column in by]) == F.col("_2._key")
    changed = F.raise_error(F.lit("rows to be numbered changed between two readings"))
    number = F.when(same, F.col("_2")[name]).otherwise(changed)
    return pairs.select("_1.*", number.alias(name)), keys.drop("_at")


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "count", parts: int = 1000
) -> DataFrame:
    """Join many rows to one row per group without a hot spot.

    ``groups`` has one row per key and, in ``size``, how many of ``rows`` have that key.
    Keys with more than 1/``parts`` of all rows can be at most ``parts`` keys, so they are
    broadcast; their rows stay where they are. The other keys are joined by a shuffle in
    which none is large. NULL keys match each other, as in a GROUP BY.
    """
    share = groups.agg(F.sum(size)).scalar() / parts
    heavy = groups.filter(F.col(size) > share)
    light = groups.filter(F.col(size) <= share)

    def match(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({key: f"_{key}" for key in keys})
        condition = F.lit(True)
        for key in keys:
            condition = condition & left[key].eqNullSafe(right[f"_{key}"])
        return left.join(right, condition, how).drop(*[f"_{key}" for key in keys])

    few = match(rows, F.broadcast(heavy), "inner")
    rest = match(rows, F.broadcast(heavy.select(*keys)), "left_anti")
    return few.unionByName(match(rest, light, "inner"))
