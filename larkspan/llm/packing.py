"""Packing token sequences by first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import wordpiece
from larkspan.llm.common import lean, lean_group, materialise, small_batches

#: Bytes of text that a worker turns into ids at once; a longer text is taken alone.
CHUNK_BYTES = 2_000_000


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the first bin with room.

    A tournament tree holds the bins' free capacity; each inner node has the larger of its children, so that the
    first bin with room is found by going down from the root, to the left wherever the left child has room.
    """
    order = np.argsort(-lengths, kind="stable")
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool, schema: pa.Schema):
    """Cuts each text's ids into pieces of at most the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tokens = wordpiece.load(path or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            texts = batch.column(2)
            for a, b in _chunks(texts):
                ids, bounds = tokens.texts(texts.slice(a, b - a))
                n = np.diff(bounds) + 1
                stream = np.insert(ids, bounds[1:], end_id).astype("<u4")
                first = np.concatenate(([0], np.cumsum(n)))[:-1]
                count = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw = memoryview(stream).cast("B")
                at = 4 * (first[doc] + start)
                crc = [zlib.crc32(raw[x : x + y]) for x, y in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                # The texts stay out of it: each would be copied for each of its pieces.
                took = [batch.column(c).slice(a, b - a).take(pa.array(doc)) for c in (0, 1)]
                columns = [*took, start, length, pa.array(crc, pa.int64()), n[doc]]
                if with_ids:
                    columns.append(pa.array([stream[x // 4 : x // 4 + y].astype(np.int32) for x, y in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    return run


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, docs_per_group: int = 2048, with_ids: bool = False, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked for.

    Each text becomes its ids and then `end_id`; pieces hold at most `capacity` ids, the last of a document the rest.
    Documents are dealt to groups at random (a seeded hash of id and row), of about `docs_per_group` each, and each
    group is packed alone by first-fit decreasing: no group grows with the input, and copies are dealt like others.
    Only the pieces' measures are written and shuffled, not the ids, unless `with_ids` asks for them. They are written
    before the groups are formed, as only then the texts pass Python in small batches whatever the session's settings.

    Null and blank texts give one piece with the end id alone. Long texts give many pieces. Repeated rows are packed as
    often as they occur. An empty table gives no rows. Extra columns are ignored. sequence_id is the group's number
    times 2^32 plus the bin's.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).alias("group"),
        F.col(text_col).cast("string").alias("text"),
    )
    names = ["doc_id", "group", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(c, pa.int64()) for c in names] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    ddl = ", ".join(f"{c} long" for c in names) + (", ids array<int>" if with_ids else "")
    with small_batches(docs.sparkSession):
        pieces = materialise(dealt.mapInArrow(lean(_pieces(tokenizer_path, capacity, end_id, with_ids, schema)), ddl))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that a task that runs again packs alike.
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["group"].astype("int64") * 2**32 + bins, offset=offsets).drop(columns="group")

    out = ddl.replace("group long, ", "") + ", sequence_id long, offset long"
    return pieces.groupBy("group").applyInPandas(lean_group(fill), out).withColumnRenamed("doc_id", id_col)
