"""Parts that several corpus operators share: columns, lineage cuts, checked broadcasts, salted joins, threshold search."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.session import shared_dir

#: A word of the contracts: a run of characters that are neither a blank nor one of the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Largest table that is broadcast, in rows of a few narrow columns. Beyond it the join is salted and shuffled.
BROADCAST_ROWS = 50_000

#: Salts that a hot key is spread over.
SALTS = 64


def _give_back() -> None:
    """Freed memory back to the system: workers stay for the next stage, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a partition's batches, which gives its memory back when the partition ends."""

    def batches_of(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return batches_of


def lean_group(run: Callable) -> Callable:
    """The function of a group, which gives its memory back after each."""

    def group_of(part):
        try:
            return run(part)
        finally:
            _give_back()

    return group_of


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session has ended; the shared folder's owner removes what is left
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once as Parquet under the shared folder and read it back.

    What reads the result recomputes nothing of df, not even when executors are lost. The files go when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch within small_batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within passes Python in batches of few rows: one of 10 000 whole texts is held in both processes at once.

    The session's own settings are put back at the end, so an action has to lie within.
    """
    own = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def as_rows(df: DataFrame, name: str = "_r") -> DataFrame:
    """All columns as one struct, so that an operator's own columns can't clash with them; `unpacked` brings them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, name: str = "_r") -> DataFrame:
    return df.select(f"{name}.*")


def salt(*columns: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(salts)).cast("int")


def join_checked(large: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Join a table with one row a key. Up to BROADCAST_ROWS rows, counted first, are broadcast; more are salted.

    `small` should be materialised, as it is counted. Keys may be null and then match null.
    """
    held = small.select([F.col(c).alias(f"_k{i}") if (i := keys.index(c) if c in keys else -1) >= 0 else F.col(c) for c in small.columns])
    on = [large[k].eqNullSafe(held[f"_k{i}"]) for i, k in enumerate(keys)]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = large.join(F.broadcast(held), on, how)
        return out.drop(*[f"_k{i}" for i in range(len(keys))])
    salted = large.withColumn("_salt", (F.rand(11) * salts).cast("int"))
    held = held.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [salted[k].eqNullSafe(held[f"_k{i}"]) for i, k in enumerate(keys)] + [salted["_salt"] == held["_s"]]
    return salted.join(held, on, how).drop("_salt", "_s", *[f"_k{i}" for i in range(len(keys))])


def sifted(rows: DataFrame, hashed: Column, keys: DataFrame, key: str, most_bits: int = 1 << 29) -> tuple[DataFrame, DataFrame]:
    """rows whose hash is surely none of the keys, and rows whose hash may be one.

    `keys` holds hashes (long), materialised, as they are counted. They become a table of bits, 64 a key and `most_bits`
    (64 MB) at most, which is broadcast. Beyond that more rows count as doubtful, all of them at last; what the caller
    does with these must be right for any row. So rows that a few keys don't concern need no shuffle.
    """
    bits = min(most_bits, max(1 << 15, 1 << (64 * keys.count()).bit_length()))
    page = lambda h: F.shiftright(F.pmod(h, F.lit(bits)), 15)
    place = lambda h: F.pmod(h, F.lit(1 << 15))
    pages = keys.groupBy(page(F.col(key)).alias("_page")).agg(F.bitmap_construct_agg(place(F.col(key))).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place(F.col("_hash")), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_hash", hashed).join(F.broadcast(pages), page(F.col("_hash")) == F.col("_page"), "left")
    met = met.withColumn("_in", F.coalesce(F.getbit(byte, F.pmod(F.col("_hash"), F.lit(8)).cast("int")), F.lit(0)) == 1).drop("_bits", "_page", "_hash")
    return met.filter(~F.col("_in")).drop("_in"), met.filter("_in").drop("_in")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their position from 0 in the given total order: a range-partitioned sort, and offsets by partition."""
    spark = rows.sparkSession
    placed = materialise(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_m", 33).alias("part")).count().collect()  # a row for each partition
    offsets, total = [], 0
    for part, n in sorted((r["part"], r["count"]) for r in sizes):
        offsets.append((part, total))
        total += n
    # From Arrow, as rows of a list pass Python workers of their own, which stay with the executors for a while.
    parts, begins = zip(*offsets, strict=True) if offsets else ((0,), (0,))
    starts = spark.createDataFrame(pa.table({"_part": pa.array(parts, pa.int64()), "_start": pa.array(begins, pa.int64())}))
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), F.shiftright("_m", 33) == F.col("_part")).withColumn(name, F.col("_start") + local).drop("_m", "_part", "_start")


def thresholds(rows: DataFrame, group: str, key: str, weight: str, budgets: DataFrame, bits: int = 60, step: int = 10) -> DataFrame:
    """For each group, the key below which the weights come nearest to the group's budget, without sorting rows.

    rows: (group, key long of `bits` bits, weight long), materialised by the caller; budgets: (group, budget).
    Weights are summed by group and the key's leading bits; the bucket in which the running sum reaches the budget is
    the only one that is refined by its next bits, until the bucket holds one key. Returns (group, threshold long):
    rows with key < threshold are inside. One narrow aggregation a level, whatever the number of rows.
    """
    low = budgets.select(F.col(group).alias("_g"), F.lit(0).cast("long").alias("_low"), F.col("budget").cast("double").alias("_left"))
    ended = []
    for shift in range(bits - step, -1, -step):
        inside = rows
        if ended:
            inside = join_checked(rows, low.select(F.col("_g").alias(group), "_low"), [group], "inner")
            inside = inside.filter((F.col(key) >= F.col("_low")) & (F.col(key) < F.col("_low") + F.lit(1 << (shift + step))))
        sums = inside.groupBy(group, F.shiftright(F.col(key), shift).alias("_b")).agg(F.sum(weight).alias("_w"), F.min(key).alias("_first"), F.max(key).alias("_last"))
        sums = sums.join(low, F.col(group).eqNullSafe(F.col("_g")))
        running = sums.withColumn("_up", F.sum("_w").over(Window.partitionBy("_g").orderBy("_b")))
        reached = running.filter(F.col("_up") >= F.col("_left")).groupBy("_g").agg(F.min(F.struct("_b", "_up", "_w", "_first", "_last", "_left")).alias("_c")).select("_g", "_c.*")
        left = F.col("_left") - (F.col("_up") - F.col("_w"))
        one = (F.col("_first") == F.col("_last")) | F.lit(shift == 0)
        nearest = F.when(F.col("_up") - F.col("_left") <= left, F.col("_last") + 1).otherwise(F.col("_first"))
        state = materialise(reached.select("_g", one.alias("_one"), F.when(one, nearest).otherwise(F.shiftleft(F.col("_b"), shift)).alias("_low"), left.alias("_left")))
        ended.append(state.filter("_one").select("_g", F.col("_low").alias("threshold")))
        low = state.filter(~F.col("_one")).select("_g", "_low", "_left")
        if low.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ended)
    out = budgets.select(F.col(group)).join(found, F.col(group).eqNullSafe(F.col("_g")), "left")
    return materialise(out.select(group, F.coalesce("threshold", F.lit(1 << bits)).cast("long").alias("threshold")))
