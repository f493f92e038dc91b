"""Similarity join on word n-grams: MinHash candidates, pruned by the posterior of their similarity, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import sequences as S
from larkspan.llm.common import SALTS, as_rows, lean, lean_group, materialise, salt, sifted, unpacked
from larkspan.llm.graphs import components, spanning
from larkspan.llm.substring_dedup import words

#: MinHash values of a text; four make a band. At similarity 0.8 all 32 bands miss a pair once in 20 million.
HASHES, ROWS = 128, 4
#: Hashes that are compared before the posterior is looked at again.
STEPS = (16, 32, 64, 128)
#: Members of a bucket that meet; larger ones are dealt to pairs of blocks. Members of buckets in a task, about.
BLOCK, MEMBERS = 128, 20_000
#: Texts that are hashed at once, and pairs that are compared at once.
TEXTS, PAIRS = 64, 50_000

_A = S.mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = S.mixed(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 20))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text and the texts' offsets; a shorter text is one run."""
    h, _, bounds = words(data, offsets)
    count = np.diff(bounds)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    edges = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(runs)), runs)
    start = bounds[:-1][text] + np.arange(edges[-1]) - edges[:-1][text]
    roll = S.rolling(7)
    width = np.minimum(size, count)[text]
    return S.mixed(roll.between(roll.prefix(h), start, start + width) + width.astype(np.uint64)), edges


def min_hashes(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """HASHES least values of each text that has a shingle; texts without have zeros."""
    out = np.zeros((len(edges) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((hashes * _A[k] + _B[k]) >> np.uint64(32), edges[:-1][some])
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(HASHES // ROWS, dtype=np.uint64)
        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                data, offsets = S.utf8(part.column(2))
                hashes, edges = shingles(data, offsets, size)
                least = min_hashes(hashes, edges)
                keys = np.broadcast_to(band, (len(least), len(band))).copy()
                for r in range(ROWS):
                    keys = S.mixed(keys * np.uint64(0xD1342543DE82EF95) + least[:, r :: ROWS])
                has = np.diff(edges) > 0
                keys = [k.view(np.int64) if ok else np.zeros(0, np.int64) for k, ok in zip(keys, has, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.diff(offsets))], ["name", "id", "signature", "bands", "bytes"])

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each step n, the fewest equal hashes with which a pair's similarity may still be the threshold.

    With a uniform prior, m of n equal make the posterior Beta(m + 1, n - m + 1), whose mass above t is the chance
    that a binomial of n + 1 trials at t is at most m. The tables are made before any pair is seen.
    """
    out = {}
    for n in STEPS:
        mass = np.cumsum([comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m) for m in range(n + 1)])
        out[n] = int(np.searchsorted(mass, tolerance))
    return out


def surviving(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs keep a posterior above the tolerance at every step; a pair that falls below isn't compared further."""
    alive, equal, at = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n in STEPS:
        equal = equal + (signatures[left[alive], at:n] == signatures[right[alive], at:n]).sum(axis=1)
        keep = equal >= least[n]
        alive, equal, at = alive[keep], equal[keep], n
    return alive


def _members(table: pa.Table, *columns: str) -> Iterator[np.ndarray]:
    """Rows of each group in a task, by the given columns."""
    keys = [np.asarray(table.column(c)) for c in columns]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(new)[1:]) if len(order) else ()


def _block_pairs(mine: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members within a block, or between two, in portions. mine: each member's block."""
    if low == high:
        n = len(mine)
        for begin in range(0, n, max(1, PAIRS // max(n, 1))):
            i = np.arange(begin, min(n, begin + max(1, PAIRS // max(n, 1))))
            a, b = np.repeat(i, n), np.tile(np.arange(n), len(i))
            yield a[a < b], b[a < b]
    else:
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        for begin in range(0, len(left), max(1, PAIRS // max(len(right), 1))):
            part = left[begin : begin + max(1, PAIRS // max(len(right), 1))]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def _first_shared(bands: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the bucket is the least of those that both of a pair are in: each pair belongs to one of its buckets."""
    both = np.where((bands[a] == bands[b]) & (bands[a] != 0), bands[a], np.iinfo(np.int64).max)
    return both.min(axis=1) == bucket


def _candidate_pairs(table: pa.Table, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a bucket and the pairs among them that belong to it and survive pruning; all buckets of two come as one."""
    mine, key = np.asarray(table.column("block")), np.asarray(table.column("key"))
    low, high = np.asarray(table.column("low")), np.asarray(table.column("high"))
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
    bands = np.asarray(pc.list_flatten(table.column("buckets").combine_chunks())).reshape(-1, HASHES // ROWS)

    def chosen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kept = surviving(signatures, a, b, least)
        return kept[_first_shared(bands, a[kept], b[kept], key[a[kept]])]

    groups = list(_members(table, "high", "low", "key"))
    twos = np.array([g for g in groups if len(g) == 2]).reshape(-1, 2)
    for begin in range(0, len(twos), PAIRS):
        a, b = twos[begin : begin + PAIRS].T
        fit = np.flatnonzero((low[a] == high[a]) | (mine[a] != mine[b]))
        fit = fit[chosen(a[fit], b[fit])]
        yield np.concatenate((a[fit], b[fit])), np.arange(len(fit)), np.arange(len(fit)) + len(fit)
    for g in groups:
        if len(g) > 2:
            found = [(np.zeros(0, int),) * 2]
            for a, b in _block_pairs(mine[g], low[g[0]], high[g[0]]):
                kept = chosen(g[a], g[b])
                found.append((a[kept], b[kept]))
            yield g, *(np.concatenate(x) for x in zip(*found, strict=True))


def _meeting(table: pa.Table, least: dict[int, int]) -> pa.Table:
    """The members of buckets that have a candidate there."""
    some = [np.zeros(0, int), *(g[np.unique(np.concatenate((a, b)))] for g, a, b in _candidate_pairs(table, least))]
    return table.drop_columns("task").take(pa.array(np.concatenate(some)))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of hashes, by products of 0/1 matrices over shared hashes."""
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (begin, begin + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1.0
        out += part @ part.T
    return out.astype(np.int64)


def _verified(table: pa.Table, size: int, threshold: Fraction, least: dict[int, int]) -> pa.Table:
    """Links among candidates: for each text how many documents and texts it links to in a bucket, and edges that connect them."""
    nodes, copies = np.asarray(table.column("cid")), np.asarray(table.column("copies"))
    text_column = table.column("text").combine_chunks()
    rows: list[tuple[np.ndarray, ...]] = []
    for g, a, b in _candidate_pairs(table, least):
        if not len(a):
            continue
        hashes, edges = shingles(*S.utf8(text_column.take(pa.array(g))), size)
        sets = [np.unique(hashes[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        n = np.array([len(s) for s in sets])
        if len(a) > 4 * len(g):
            both = _overlaps(sets)[a, b]
        else:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
        linked = (threshold.denominator * both >= threshold.numerator * (n[a] + n[b] - both)) & (n[a] > 0)
        a, b = a[linked], b[linked]
        texts = np.bincount(np.concatenate((a, b)), minlength=len(g))
        documents = np.bincount(np.concatenate((a, b)), weights=np.concatenate((copies[g[b]], copies[g[a]])), minlength=len(g))
        some = np.flatnonzero(texts)
        rows.append((nodes[g[some]], np.full(len(some), -1), documents[some], texts[some]))
        root, leaf = spanning(len(g), a, b)
        rows.append((nodes[g[root]], nodes[g[leaf]], np.zeros(len(root)), np.zeros(len(root))))
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("cid", "other", "documents", "texts"), columns, strict=True)))


def _in_blocks(rows: DataFrame, group: str, count: str) -> DataFrame:
    """Deals the members of groups of more than BLOCK to blocks; a member goes to each pair of blocks that has its own."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(3)), blocks).cast("int")
    dealt = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other").withColumn("task_key", F.xxhash64(group, "low", "high"))


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row a document: id, class_id, text_id, n_links, n_texts.

    Two texts are linked if the Jaccard similarity of their sets of `size` consecutive words is `threshold` or more;
    words are runs of characters other than blanks and controls 9 to 13, unchanged. A text of fewer words is one
    shingle; a text without words has no links. text_id is the least id with the same text, class_id the least id that
    links lead to, n_texts the number of other texts that the document's is linked to and n_links the number of other
    documents, its copies included. Null ids count as the largest; null text is a text of its own without links.

    Copies meet once, as one text. Texts that share a band of MinHash values are candidates; buckets with the same
    members in several bands are looked at once. Each pair belongs to the least of the buckets that it shares; there its
    hashes are compared some at a time, and it is dropped when the posterior probability of reaching the threshold falls
    below `tolerance`. Members with a candidate then meet again with their texts, and the candidate pairs alone are
    verified on their shingle sets: work follows the buckets, however long a chain of links becomes. A bucket reports
    each text's number of links and edges that connect it: rows grow with the texts, not with the pairs. Buckets of more
    than BLOCK texts are dealt to pairs of blocks; only texts that have a candidate leave the scan.

    Repeated rows are copies. An empty table gives no rows. Extra columns are ignored.
    """
    signed, known = _linked(docs, threshold, size, tolerance, id_col, text_col, salts)
    roots = known.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id").alias("id")))["id"].alias("class_id"))
    known = known.join(roots, "root").select(
        F.col("name").alias("own"), F.explode("salts").alias("own_salt"), "class_id", "text_id",
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    met = signed.select("name", "id", "salt").join(known, (F.col("name") == F.col("own")) & (F.col("salt") == F.col("own_salt")))
    return met.select(F.col("id").alias(id_col), "class_id", "text_id", "n_links", "n_texts")


def _name(text: Column) -> Column:
    """What identifies a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _linked(docs: DataFrame, threshold: float, size: int, tolerance: float, id_col: str, text_col: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """One row a document (name, id, salt), and one row a text: name, copies, text_id, salts, documents, texts, root of its class."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    source = docs.select(F.col(id_col).alias("id"), _name(F.col(text_col)).alias("name"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    signed = source.select("name", "id", "text").mapInArrow(lean(_signatures(size)), f"name binary, id {kind}, signature binary, bands array<long>, bytes long")
    signed = materialise(signed.withColumn("salt", salt(F.coalesce(F.col("id").cast("string"), F.lit("")), salts=salts)))
    least_id = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    repeated = materialise(signed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("name").alias("key")))
    alone, several = sifted(signed, F.xxhash64("name"), repeated, "key")
    several = several.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), least_id["id"].alias("text_id"), F.collect_set("salt").alias("salts"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    alone = alone.select("name", F.lit(1).cast("long").alias("copies"), F.col("id").alias("text_id"), F.array("salt").alias("salts"), "signature", "bands", "bytes")
    classes = materialise(several.unionByName(alone).withColumn("cid", F.monotonically_increasing_id()))

    bands = classes.select("cid", F.posexplode("bands").alias("band", "key"), salt("cid", salts=salts).alias("salt"))
    shared = materialise(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    _, bands = sifted(bands, F.col("key"), shared, "key")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("first"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"), F.collect_set("salt").alias("salts")).filter("n > 1")
    alike = Window.partitionBy("n", "first", "x", "y")  # a bucket in each band at most
    buckets = buckets.withColumn("bucket", F.min("key").over(alike)).select(F.col("key").alias("held"), "bucket", "n", F.explode("salts").alias("held_salt"))
    met = bands.join(buckets, (F.col("key") == F.col("held")) & (F.col("salt") == F.col("held_salt")))
    members = met.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("of"), F.collect_set(F.struct(F.col("bucket").alias("key"), "n")).alias("in"))
    members = members.select("cid", F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long"))).alias("buckets"), "in")
    members = materialise(members)
    _, near = sifted(classes.drop("bands", "salts"), F.xxhash64("cid"), members.select(F.xxhash64("cid").alias("key")), "key")
    members = materialise(members.join(near, "cid"))
    least = least_matches(threshold, tolerance)
    dealt = members.select("*", F.explode("in").alias("one")).select("*", "one.key", "one.n").drop("in", "one")
    rows = members.select(F.explode("in.n").alias("n")).agg(F.sum(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    dealt = _in_blocks(dealt, "key", "n").withColumn("task", F.pmod("task_key", F.lit(max(4 * tasks, rows // MEMBERS))).cast("int")).drop("task_key", "n")
    found = materialise(dealt.groupBy("task").applyInArrow(lean_group(lambda part: _meeting(part, least)), dealt.drop("task").schema))

    keys = materialise(found.select(F.xxhash64("name", "text_id").alias("key")).distinct())
    _, texts = sifted(source, F.xxhash64("name", "id"), keys, "key")
    one = F.row_number().over(Window.partitionBy("name", "id").orderBy("name"))  # of repeated rows
    texts = texts.withColumn("one", one).filter("one = 1").select(F.col("name").alias("own"), "id", "text")
    size_of = found.agg(F.sum("bytes")).first()[0] or 0
    met = found.join(texts, F.col("name").eqNullSafe(F.col("own")) & F.col("text_id").eqNullSafe(F.col("id"))).drop("name", "own", "id", "text_id", "bytes")
    met = met.withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(4 * tasks, size_of // S.GROUP_BYTES))).cast("int"))
    exact = Fraction(str(threshold))
    verified = materialise(met.groupBy("task").applyInArrow(lean_group(lambda part: _verified(part, size, exact, least)), "cid long, other long, documents long, texts long"))
    linked = components(verified.filter("other >= 0").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = verified.filter("other < 0").groupBy("cid").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))

    known = classes.select("cid", "name", "copies", "text_id", "salts").join(counts, "cid", "left").join(linked.select(F.col("node").alias("cid"), "root"), "cid", "left")
    return signed, materialise(known.withColumn("root", F.coalesce("root", "cid")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, salts: int = SALTS) -> DataFrame:
    """One row of each class, all columns unchanged: that with the least id, null ids last, and of texts that share it the least MD5.

    Different texts may share an id or have none; each class keeps one. Of rows with the same text and id, one stays.
    Rows that share text and id with no dropped one stay where they are; only the others meet the representatives.
    """
    signed, known = _linked(docs, threshold, size, tolerance, id_col, text_col, salts)
    least = F.min(F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id").alias("id"), F.col("name").alias("name")))
    first = materialise(known.groupBy("root").agg(least.alias("_f")).select("root", F.col("_f.id").alias("_first"), F.col("_f.name").alias("_text")))
    of_text = known.select("name", F.explode("salts").alias("_salt"), "root", "copies").join(first, "root").select(F.col("name").alias("_name"), "_salt", "_first", (F.col("name") == F.col("_text")).alias("_is_first"))
    rows = signed.select("name", "id", "salt").join(of_text, (F.col("name") == F.col("_name")) & (F.col("salt") == F.col("_salt")))
    gone = rows.filter(~(F.col("_is_first") & F.col("id").eqNullSafe(F.col("_first")))).select("name", "id")
    again = rows.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", "id")
    keys = materialise(gone.unionByName(again).select(F.xxhash64("name", "id").alias("_key")))

    keyed = as_rows(docs).withColumn("_own", _name(F.col("_r")[text_col]))
    clear, doubtful = sifted(keyed, F.xxhash64("_own", F.col("_r")[id_col]), keys, "_key")
    _, wanted = sifted(first.drop("root"), F.xxhash64("_text", "_first"), keys, "_key")
    content = F.xxhash64(*[F.col("_r")[c] for c, kind in docs.dtypes if "map<" not in kind])
    place = F.row_number().over(Window.partitionBy("_own", "_own_id").orderBy(content))
    once = doubtful.withColumn("_own_id", F.col("_r")[id_col]).withColumn("_place", place).filter("_place = 1")  # each task passes on one of its rows that repeat
    met = once.join(wanted, once["_own"].eqNullSafe(wanted["_text"]) & once["_own_id"].eqNullSafe(wanted["_first"]))
    return unpacked(clear.select("_r").unionByName(met.select("_r")))
