"""Windowed aggregates over streams, and running a finite stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import shared_dir


def tumbling(stream: DataFrame, time: str, length: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by window and keys. With `late`, rows older than the newest less that much are dropped and state is bounded."""
    rows = stream.withWatermark(time, late) if late else stream
    return rows.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("items")).select(F.unix_seconds("w.start").alias("bucket"), *keys, "items")


def sliding(stream: DataFrame, time: str, length: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = stream.withWatermark(time, late) if late else stream
    return rows.groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("items")).select(F.unix_seconds("w.start").alias("bucket"), *keys, "items")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files. The path is given as a pattern, which may also name a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what its source has and returns its result as a table in the shared folder.

    Each batch is written whole; in complete mode the last one stands, in append mode all of them.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    result = spark.read.parquet(f"{folder}/out")
    return result.drop("batch") if mode != "complete" else result
