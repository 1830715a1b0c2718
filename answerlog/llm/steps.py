"""Steps of a job whose results are written to the shared folder and read again."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from answerlog.session import new_folder


class Steps:
    """Tables of one run of an operator, below one new folder.

    A written table cuts the lineage and survives lost executors. Spark deletes the shuffle
    files of a finished step only when the driver's collector has seen that nothing refers
    to them; that is asked for after every step, so the disk holds one step's files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        schema = df.schema
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
