"""Event-time windows, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], late: str | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by window and keys.  A stream drops rows later than ``late``."""
    df = df.withWatermark(time, late) if df.isStreaming and late else df
    out = df.groupBy(F.window(time, width, slide or width).alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by session: rows of the same keys no further apart than ``gap``."""
    df = df.withWatermark(time, late) if df.isStreaming and late else df
    out = df.groupBy(F.session_window(time, gap).alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *aggregates)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a memory table."""
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def run_to(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet below ``folder``, where its progress is kept too.

    A batch that is repeated after a failure replaces what it wrote before.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/rows/__batch=-1")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/__batch={0 if mode == 'complete' else n}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").select(*df.columns)
