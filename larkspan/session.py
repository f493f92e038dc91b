"""Session and table helpers shared by the queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "larkspan", shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    fallback = tempfile.mkdtemp(prefix="larkspan-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


#: Tables whose rows hold whole texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read lazily by Spark's own reader.

    A row group can't be split; where a table of texts comes in so few that they leave three quarters of the cores
    without work, its rows are dealt out. Tables of many files are read as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and cores >= 4 * rows.rdd.getNumPartitions():
        return rows.repartition(cores)
    return rows
