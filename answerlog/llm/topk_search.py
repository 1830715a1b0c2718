"""Exact top-k search by inner product: norm-bucketed retrieval.

Candidates are grouped by vector length into buckets, longest first. For a query and a
bucket, the k-th best score so far gives a local cosine threshold t = score / (length of
the query x longest length of the bucket). With t > 1 the bucket is skipped. A high t
makes single coordinates decisive, so they prune: on the query's ``focus`` largest
coordinates the partial product plus the Cauchy-Schwarz bound of the rest must reach the
score. A low t leaves only the length test. What survives is verified by the product.

Queries are taken in blocks of ``block`` vectors, each small enough to be broadcast (its
size is the parameter), against all rows; every task keeps the k best per query, so what
is shuffled are k rows per query and task. The k best rows of a block are written to the
shared folder before the next block is collected, so the driver holds one block at a time.

Defined results: vectors that are null, empty, hold a null or non-finite component, or a
scaled component that no 64-bit integer holds, take no part, and neither do rows without
an id. Scores are exact; one that no 64-bit integer holds is the nearest one that does.
Only vectors of equal length are compared. Rows that repeat an id count once, with the
smallest vector. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from answerlog.llm.steps import Steps
from answerlog.session import pin

BEST = "query_id long, vec_id long, score long"
FOUND = "query_id long, rank int, vec_id long, score long"


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component; null if a vector takes no part."""
    values = F.transform(vector, lambda x: F.floor(factor * x.cast("double")))
    limit = float(1 << 62)
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(factor * x.cast("double")) < limit),
    )
    return F.when((F.size(vector) > 0) & fine, values)


def _keep_best(k: int, ids: np.ndarray, scores: np.ndarray, top_ids: np.ndarray, top_scores: np.ndarray):
    """The k best of both lists per row: higher scores first, then smaller ids."""
    ids = np.concatenate([top_ids, np.broadcast_to(ids, scores.shape)], axis=1)
    scores = np.concatenate([top_scores, scores], axis=1)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


class _Search:
    """Best candidates so far for one block of queries of one vector length."""

    NONE = np.iinfo(np.int64).min + 1

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, focus: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
        width = min(focus, vectors.shape[1])
        self.focus = np.argsort(-np.abs(vectors), axis=1)[:, :width]
        self.rest = np.sqrt(
            np.maximum(self.lengths**2 - (np.take_along_axis(vectors, self.focus, 1).astype(float) ** 2).sum(1), 0)
        )
        self.top_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.top_scores = np.full((len(ids), k), self.NONE)

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
        reach = self.lengths * lengths.max() * (1 + 1e-9) + 1e-6
        worst = self.top_scores[:, -1]
        alive = np.flatnonzero(worst <= reach)
        if not len(alive):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.nan_to_num(worst[alive] / self.lengths[alive] / max(lengths.max(), 1e-300))
        exact = self.lengths.max() * lengths.max() < 2**52
        by_coordinate = alive[local > 0.6]
        plain = alive[local <= 0.6]
        for part in np.array_split(plain, max(1, len(plain) * len(ids) // 2_000_000)):
            if len(part):
                self.verify(part, ids, vectors, exact)
        for q in by_coordinate:
            at = self.focus[q]
            partial = vectors[:, at].astype(float) @ self.vectors[q, at].astype(float)
            tail = np.sqrt(np.maximum(lengths**2 - (vectors[:, at].astype(float) ** 2).sum(1), 0))
            able = np.flatnonzero(partial + tail * self.rest[q] >= worst[q] - 1e-6 * reach[q])
            if len(able):
                self.verify(np.array([q]), ids[able], vectors[able], exact)

    def verify(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, exact: bool) -> None:
        own = self.vectors[queries]
        if exact:  # by Cauchy-Schwarz every partial sum is below 2**52, so doubles are exact
            scores = np.rint(own.astype(float) @ vectors.T.astype(float)).astype(np.int64)
        else:
            wide = own.astype(object) @ vectors.T.astype(object)
            scores = np.clip(wide, self.NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
        scores[ids[None, :] == self.ids[queries][:, None]] = self.NONE
        keep = min(self.k, scores.shape[1])
        if keep < scores.shape[1]:
            edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
            some = np.flatnonzero((scores >= edge).any(axis=0) & (scores >= self.top_scores[queries, -1][:, None]).any(axis=0))
            scores, ids = scores[:, some], ids[some]
        if scores.shape[1]:
            self.top_ids[queries], self.top_scores[queries] = _keep_best(
                self.k, ids[None, :], scores, self.top_ids[queries], self.top_scores[queries]
            )

    def rows(self) -> pa.RecordBatch:
        some = self.top_scores > self.NONE
        owner = np.repeat(self.ids, some.sum(1))
        return pa.RecordBatch.from_arrays(
            [pa.array(owner), pa.array(self.top_ids[some]), pa.array(self.top_scores[some])],
            ["query_id", "vec_id", "score"],
        )


def _scan(block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, focus: int, bucket: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {size: _Search(*part, k, focus) for size, part in block.items()}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            starts = vectors.offsets.to_numpy()
            values = vectors.values.to_numpy()
            sizes = np.diff(starts)
            for size in np.unique(sizes):
                if size not in searches:
                    continue
                rows = np.flatnonzero(sizes == size)
                table = values[starts[rows][:, None] + np.arange(size)]
                order = np.argsort(-(table.astype(float) ** 2).sum(1), kind="stable")
                for low in range(0, len(rows), bucket):
                    some = order[low : low + bucket]
                    searches[size].bucket(ids[rows[some]], table[some])
        for search in searches.values():
            yield search.rows()

    return scan


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, factor: int = 256, vec_id: str = "vec_id",
    vector: str = "embedding", block: int = 20_000, bucket: int = 2_000, focus: int = 8,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows of every query, the
    query's own id left out. ``is_query`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    vectors = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), factor).alias("vector")
    ).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    vectors = vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    vectors = vectors.withColumn("length", length)
    # Buckets: ranges of length, longest first inside each; equal lengths are told apart by id.
    candidates = pin(
        vectors.repartitionByRange(F.desc("length"), F.xxhash64("vec_id"))
        .sortWithinPartitions(F.desc("length"), "vec_id").select("vec_id", "vector")
    )
    queries = candidates.filter(is_query)
    count = queries.count()
    blocks = -(-count // block)
    steps = Steps(spark, "topk")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for number in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == number).collect()
        sizes: dict[int, list] = {}
        for row in mine:
            sizes.setdefault(len(row["vector"]), []).append(row)
        held = {
            size: (np.array([r["vec_id"] for r in own], np.int64), np.array([r["vector"] for r in own], np.int64))
            for size, own in sizes.items()
        }
        best = candidates.mapInArrow(_scan(held, k, focus, bucket), BEST)
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        steps.saved(best.select("query_id", "rank", "vec_id", "score"), f"best/block={number}")
        del mine, sizes, held, best
    if not blocks:
        return spark.createDataFrame([], FOUND)
    return spark.read.schema(FOUND).parquet(f"{steps.folder}/best").select("query_id", "rank", "vec_id", "score")
