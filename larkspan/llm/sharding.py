"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import SALTS, join_checked, materialise, salt, thresholds

#: A position along a dimension: the coordinate, one bit that puts heavy groups first, and the group's hash.
COORD_BITS, TIE_BITS = 12, 47


def _coordinate(column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << COORD_BITS))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One narrow row a document: id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot from 0 in its shard.

    The tree's leaves are the shards. A node is split across its widest dimension (the logarithm of the size, and the
    given columns through a hash) at the weighted median of the bytes, found by histograms that refine the boundary
    bucket only. Give the number of leaves, or the bytes that a leaf should reach. Sizes of the leaves are near equal.

    Equal texts form a group and stay in one shard, placed by the group's smallest coordinates, unless the group
    outweighs half a shard: then its rows are dealt to pieces of a 64th of a shard, as sizes come before groups.
    Within equal coordinates heavy groups come first, so that cuts fall between light ones. Null text has size 1 and
    crc32 0; null metadata is a coordinate like others. Repeated rows have slots of their own. An empty table gives no
    rows. Slots are counted by hash bucket within the shard; no shard meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        F.unhex(F.md5(text)).alias("_text"),
        F.array(F.least(F.lit((1 << COORD_BITS) - 1), F.floor(F.log2((F.octet_length(text) + 1).cast("double")) * 128)), *[_coordinate(c) for c in dimensions]).alias("_at"),
    )
    rows = materialise(rows.withColumn("_salt", salt("_row", salts=salts)))
    total = rows.agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    leaves = shards or max(1, round((total["bytes"] or 0) / target_bytes))
    goal = (total["bytes"] or 0) / leaves

    groups = rows.groupBy("_text").agg(F.sum("_size").alias("_group"), F.min("_at").alias("_point"), F.collect_set("_salt").alias("_salts"))
    groups = groups.withColumn("_pieces", F.when(F.col("_group") > goal / 2, F.ceil(F.col("_group") * 64 / F.lit(max(goal, 1.0)))).otherwise(1)).withColumn("_salt", F.explode("_salts")).drop("_salts")
    piece = F.pmod(F.xxhash64("_row"), F.col("_pieces"))
    light = (F.col("_group") <= goal / 1000).cast("long")
    placed = rows.join(groups, ["_text", "_salt"]).select(
        "_id", "_row", "_size", "_crc", "_point",
        F.shiftleft(light, TIE_BITS).bitwiseOR(F.pmod(F.xxhash64("_text", piece), F.lit(1 << TIE_BITS))).alias("_tie"),
        F.lit(0).alias("_leaf"), F.lit(leaves).alias("_leaves"),
    )
    placed = materialise(placed)
    axes = range(1 + len(dimensions))
    while placed.filter("_leaves > 1").limit(1).count():
        spans = placed.filter("_leaves > 1").groupBy("_leaf").agg(F.sum("_size").alias("_bytes"), F.first("_leaves").alias("_of"), *[(F.max(F.col("_point")[i]) - F.min(F.col("_point")[i])).alias(f"_span{i}") for i in axes])
        widest = F.array_max(F.array(*[F.struct(F.col(f"_span{i}").alias("span"), F.lit(-i).alias("axis")) for i in axes]))["axis"]
        nodes = materialise(spans.select("_leaf", (-widest).alias("_axis"), F.floor(F.col("_of") / 2).cast("int").alias("_half"), (F.col("_bytes") * F.floor(F.col("_of") / 2) / F.col("_of")).alias("budget")))
        keyed = join_checked(placed, nodes.select("_leaf", "_axis", "_half"), ["_leaf"]).withColumn("_key", F.shiftleft(F.element_at("_point", F.coalesce("_axis", F.lit(0)) + 1).cast("long"), TIE_BITS + 1).bitwiseOR(F.col("_tie")))
        keyed = materialise(keyed)
        cuts = thresholds(keyed.filter("_leaves > 1"), "_leaf", "_key", "_size", nodes.select("_leaf", "budget"), COORD_BITS + 1 + TIE_BITS)
        right = F.col("_key") >= F.col("threshold")
        split = F.col("_leaves") > 1
        placed = materialise(join_checked(keyed, cuts, ["_leaf"]).select(
            "_id", "_row", "_size", "_crc", "_point", "_tie",
            F.when(split & right, F.col("_leaf") + F.col("_half")).otherwise(F.col("_leaf")).alias("_leaf"),
            F.when(~split, 1).when(right, F.col("_leaves") - F.col("_half")).otherwise(F.col("_half")).alias("_leaves"),
        ))

    buckets = max(16, total["n"] // (20_000 * leaves))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("_leaf", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = materialise(counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("_leaf").orderBy("_bucket")) - F.col("_n")).drop("_n"))
    within = F.row_number().over(Window.partitionBy("_leaf", "_bucket").orderBy("_row")) - 1
    return join_checked(placed.withColumn("_in", within), before, ["_leaf", "_bucket"]).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_leaf").cast("int").alias("shard"), (F.col("_start") + F.col("_in")).cast("long").alias("slot"))
