"""Relations made without input: ranges, repeated batches, one row, none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PlanError, Schema

RANGE_TYPES = {"INT_TYPE": "int", "LONG_TYPE": "bigint", "FLOAT_TYPE": "float", "DOUBLE_TYPE": "double", "STRING_TYPE": "string"}


def tuple_range(spark: SparkSession, n: int, kind: str = "LONG_TYPE", name: str = "col0") -> DataFrame:
    """0 to n - 1 as values of a type."""
    if kind not in RANGE_TYPES:
        raise PlanError(f"no range of {kind}")
    return spark.range(n).select(F.col("id").cast(RANGE_TYPES[kind]).alias(name))


def batch(spark: SparkSession, rows: list[tuple], schema: Schema) -> DataFrame:
    """Rows held in memory."""
    return spark.createDataFrame(rows, schema.spark)


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Each row as often as asked for, made where the row is."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__n")).drop("__n") if times > 0 else df.limit(0)


def singleton(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("privateSingletonColumn"))


def empty(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame([], schema.spark)
