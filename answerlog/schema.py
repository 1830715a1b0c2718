"""Record types of the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("citation_number", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()),
    ]
)

# Timestamps are wall-clock times without a zone.
RESULTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("sources", T.StringType()),
        T.StructField("screenshot_path", T.StringType()),
        T.StructField("execution_time_seconds", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def utc_now() -> Column:
    """Current UTC time as a zone-less timestamp."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def conform(df: DataFrame) -> DataFrame:
    """Bring any frame to the results schema: missing columns become NULL, then defaults apply.

    A missing time becomes the current UTC time and a missing outcome becomes success.
    """
    columns = []
    for field in RESULTS.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name == "sources" and isinstance(_type_of(df, "sources"), T.ArrayType):
            value = F.to_json(value)
        value = value.cast(field.dataType)
        if field.name == "timestamp":
            value = F.coalesce(value, utc_now())
        if field.name == "success":
            value = F.coalesce(value, F.lit(True))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _type_of(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None
