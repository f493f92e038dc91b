"""Tables written in the folder that driver and executors share, as cuts of lineage and as results of loops."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import shared_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session has ended; the shared folder's owner removes what is left
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet and read back: nothing of its plan runs again, not even when executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows, written in the given total order and numbered from 0: a range-partitioned sort, and an offset by partition.

    The driver sees one count a partition; no window gathers rows.
    """
    placed = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy(F.shiftright("_m", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), F.shiftright("_m", 33) == F.col("_part")).withColumn(name, F.col("_start") + within).drop("_m", "_part", "_start")
