"""A corpus pipeline out of the operators for training data; each stage's decisions take effect."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from answerlog.llm import jaccard_join  # noqa: E402
from answerlog.llm.packing import packing  # noqa: E402
from answerlog.llm.quality_rules import quality_rules  # noqa: E402
from answerlog.llm.queries import byte_bpe  # noqa: E402
from answerlog.llm.registry import table  # noqa: E402
from answerlog.llm.secret_scans import mask_secrets as without_secrets  # noqa: E402
from answerlog.llm.substring_dedup import substring_dedup  # noqa: E402
from answerlog.session import new_folder, ship_package  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text counts as empty, which they reject;
    equal texts share their fate, so ties and repeated rows stay or go together."""
    judged = quality_rules(docs, into="__llm_quality")
    return judged.filter("__llm_quality.kept").drop("__llm_quality")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by the Jaccard join. Of
    repeated rows one stays; a document without words is linked with nothing and stays."""
    return jaccard_join.keep_one(docs)


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents after a change of the text; the length follows the text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated sentence spans; one of which nothing is left goes. Null and
    empty texts hold no span and stay; of repeated rows only the first keeps its sentences."""
    cut = substring_dedup(docs, into="__llm_cut")
    cut = cut.withColumn("text", F.col("__llm_cut.text"))
    kept = cut.filter((F.col("__llm_cut.n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return with_text(kept, docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null, empty and clean texts as they are."""
    return with_text(without_secrets(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids; a null or empty text has
    the end id alone, repeated rows are packed each on its own."""
    return packing(docs, **byte_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = table(ship_package(spark), sf_dir, "documents")
    for _, stage in STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
