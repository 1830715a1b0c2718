"""When does a growing text stop changing?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.session import pin

# Unchanged checks in a row, and the least length of a real answer.
STABLE_CHECKS = 3
MIN_CHARS = 50

CHECK = "struct<seq:bigint,size:bigint,digest:string>"
# What is known of a part of an entity's checks: their number, the first check that is stable
# by the checks of the part alone, and the first and the last checks.
PARTS = (
    "entity_id long, part long, checks long, stable_seq long, stable_length long, "
    f"head array<{CHECK}>, tail array<{CHECK}>"
)


def check_limits(threshold: int, min_chars: int) -> None:
    if threshold < 1 or min_chars < 0:
        raise ValueError("threshold must be positive, min_chars not negative")


def digests(snapshots: DataFrame) -> DataFrame:
    """Checks without their texts: ``entity_id, seq, size, digest``."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    digest = F.when(size > 0, F.md5("text")).otherwise(F.lit(""))
    return snapshots.select("entity_id", F.col("seq").cast("long").alias("seq"), size.alias("size"), digest.alias("digest"))


def content_stability(
    snapshots: DataFrame, threshold: int = STABLE_CHECKS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """First check at which a text had been unchanged ``threshold`` times in a row.

    ``snapshots`` has ``entity_id, seq, text``; numbers may have any gaps. Whether a check is
    the stable one depends on the ``threshold`` checks before it only. So the checks are
    range-partitioned by entity and number, and each partition gets the last checks that
    partitions before it hold of its first entity; an entity with most of the rows is spread
    over many tasks whatever its numbers. Only hash and length of a text are shuffled.
    """
    check_limits(threshold, min_chars)
    checks = digests(snapshots).withColumn("own", F.lit(True))
    return _summed(
        _marked(checks, threshold, min_chars).groupBy("entity_id").agg(
            F.count(F.lit(1)).alias("checks"), *_firsts(F.col("seq"), F.col("size"), F.col("stable"))
        )
    )


def stability_of_parts(
    parts: DataFrame, threshold: int = STABLE_CHECKS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """:func:`content_stability` from what is known of the parts (see ``PARTS``).

    Of several reports on a part that with most checks counts. What spans parts is decided
    on their first and last checks, as a check of a part that is not among its first
    ``threshold`` depends on the part alone.
    """
    check_limits(threshold, min_chars)
    known = [name for name in ("checks", "stable_seq", "stable_length", "head", "tail")]
    last = parts.groupBy("entity_id", "part").agg(F.max_by(F.struct(*known), "checks").alias("known"))
    last = pin(last.select("entity_id", "known.*"))
    beyond = F.filter("tail", lambda x: x["seq"] > F.coalesce(F.try_element_at("head", F.lit(-1))["seq"], x["seq"] - 1))
    edges = [
        last.select("entity_id", F.explode(rows).alias("x")).select("entity_id", "x.*", F.lit(own).alias("own"))
        for rows, own in ((F.col("head"), True), (beyond, False))
    ]
    spanning = _marked(edges[0].unionByName(edges[1]), threshold, min_chars).filter("stable")
    found = last.select("entity_id", "checks", "stable_seq", F.col("stable_length").alias("size")).unionByName(
        spanning.select("entity_id", F.lit(0).cast("long").alias("checks"), F.col("seq").alias("stable_seq"), "size")
    )
    return _summed(
        found.groupBy("entity_id").agg(
            F.sum("checks").alias("checks"),
            *_firsts(F.col("stable_seq"), F.col("size"), F.col("stable_seq").isNotNull()),
        )
    )


def _firsts(seq: Column, size: Column, stable: Column) -> list[Column]:
    found = F.when(stable, seq)
    return [F.min(found).alias("stable_seq"), F.min_by(size, found).alias("stable_length")]


def _summed(found: DataFrame) -> DataFrame:
    stable = F.col("stable_seq").isNotNull().alias("stable")
    return found.select("entity_id", "checks", stable, "stable_seq", "stable_length")


def _marked(checks: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """The ``own`` checks with ``stable``: unchanged ``threshold`` times in a row up to here."""
    order = ["entity_id", "seq"]
    sorted_ = checks.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pin(sorted_.withColumn("chunk", F.spark_partition_id()))
    spread = placed.unionByName(_before_chunks(placed, threshold).withColumn("own", F.lit(False)))
    along = Window.partitionBy("entity_id", "chunk").orderBy("seq")
    unchanged = (
        (F.col("size") >= min_chars)
        & (F.lag("digest", 1, "").over(along) == F.col("digest"))
        & (F.lag("size", 1, 0).over(along) == F.col("size"))
    )
    run = F.sum(F.col("unchanged").cast("int")).over(along.rowsBetween(-(threshold - 1), 0))
    return spread.withColumn("unchanged", unchanged).withColumn("stable", run == threshold).filter("own")


def _before_chunks(placed: DataFrame, count: int) -> DataFrame:
    """The last ``count`` checks before each chunk, as rows of that chunk.

    Only entities in several chunks need them, fewer than there are chunks, and of each
    chunk only the last checks can be among them: a few rows per partition in all.
    """
    spans = placed.groupBy(F.col("entity_id").alias("entity")).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    spans = F.broadcast(spans.filter("a < b").select("entity"))
    crossing = placed.join(spans, F.col("entity_id").eqNullSafe(F.col("entity")), "left_semi")
    latest = Window.partitionBy("entity_id", "chunk").orderBy(F.desc("seq"))
    tails = crossing.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= count)
    along = Window.partitionBy("entity_id").orderBy("seq")
    before = F.collect_list(F.struct("seq", "size", "digest")).over(along.rowsBetween(-count, -1))
    first = F.lag("chunk").over(along) != F.col("chunk")
    firsts = tails.select("entity_id", "chunk", first.alias("first"), before.alias("before")).filter("first")
    return firsts.select("entity_id", "chunk", F.explode("before").alias("x")).select("entity_id", "x.*", "chunk")
