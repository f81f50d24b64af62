"""Structured Streaming use of fitted recipes, fitted models and windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.functions.columns import as_number, ref
from factsieve.operators.charts import SIMPLE
from factsieve.plans.store import new_path


def read_files(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Stream over the parquet files of a folder that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_available(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Processes everything available now in append mode and returns what was written."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Processes a bounded input to its end and returns the table of all windows, the open ones at the end included.

    The input is known to end, so nothing is late: the windows stay in the state and each batch writes their whole table, of
    which the last is the result.
    """
    spark = stream.sparkSession
    out, state, last = new_path(spark, label), new_path(spark, f"{label}-state"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last[:] = [number]

    query = (stream.writeStream.option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True)
             .foreachBatch(keep).start())
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[0]}")


def windowed(stream: DataFrame, time: str, value: str, agg: str = "mean", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, y, n per tumbling window; a window is emitted once the watermark has passed its end."""
    x = as_number(stream, value)
    timed = stream.select(ref(time).cast("timestamp").alias("_t"), x.alias("_y")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width)).agg(
        SIMPLE[agg]("_y").cast("double").alias("y"), F.count(F.lit(1)).alias("n")).select(
            F.col("window.start").cast("timestamp_ntz").alias("start"), "y", "n")


def quality_counters(stream: DataFrame, time: str, columns: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, rows and missing values per column and window."""
    timed = stream.withColumn("_t", ref(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(ref(c).isNull()).alias(f"missing_{c}") for c in columns]).select(
            F.col("window.start").cast("timestamp_ntz").alias("start"), "rows", *[F.col(f"missing_{c}") for c in columns])
