"""Substring deduplication over words: difference-cover anchors, extended to windows that occur more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sequences as S

#: A perfect difference set modulo 21. Each residue is the difference of two of its members.
COVER, PERIOD = (3, 6, 7, 12, 14), 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word of all texts, and the offsets of the texts in them."""
    solid = ~_SPACE[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    at_start = offsets[:-1][offsets[:-1] < len(data)]
    head[at_start] = solid[at_start]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    length = (end - start).astype(np.uint64)
    hashes = []
    for seed in (1, 2):
        roll = S.rolling(seed)
        hashes.append(S.mixed(roll.spans_of_bytes(data, start, end) + length))
    return *hashes, np.searchsorted(start, offsets)


def _sequences(values: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    return S.mixed(S.rolling(seed).spans(values, starts, starts + width))


def _anchors(window: int, parts: int):
    """Hashes of window - PERIOD + 1 words at cover positions of each text that has a window."""
    width, residues = window - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, docs = [], [], 0, 0

        def send():
            h1, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            return S.scatter(np.concatenate(names), h1, None, doc, pos, None, np.zeros(len(h1), np.uint8), parts)

        for batch in batches:
            for begin, stop in S.portions(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                data, offsets = S.utf8(part.column(1))
                h, _, bounds = words(data, offsets)
                count = np.diff(bounds)
                doc = np.repeat(np.arange(len(count)), count)
                pos = np.arange(len(h)) - bounds[:-1][doc]
                at = np.flatnonzero(residues[pos % PERIOD] & (pos + width <= count[doc]) & (count[doc] >= window))
                held.append((_sequences(h, at, width, 3), (doc[at] + docs).astype(np.uint32), pos[at].astype(np.uint32)))
                names.append(S.name_array(part.column(0)))
                size, docs = size + len(data), docs + len(part)
                if size > S.CHUNK_BYTES:
                    yield from send()
                    held, names, size, docs = [], [], 0, 0
        if held:
            yield from send()

    return run


def _windows(texts: pa.Table, found: pa.Table, window: int, parts: int) -> pa.Table:
    """Hashes of all windows that hold a repeated anchor."""
    names = S.name_array(texts.column("uid"))
    text, pos, _, _ = S.references(found, names)
    some, at = np.unique(text, return_inverse=True)
    if not len(some):
        return S.ENTRIES.empty_table()
    chosen = texts.column("text").combine_chunks().take(pa.array(some))
    held = []
    for begin, stop in S.portions(chosen):
        h1, h2, bounds = words(*S.utf8(chosen.slice(begin, stop - begin)))
        count = np.diff(bounds)
        a, b = np.searchsorted(at, (begin, stop))
        doc, anchor = at[a:b] - begin, pos[a:b]
        # A window that holds an anchor begins from window - width before it to the anchor itself.
        change = np.zeros(len(h1) + 1, np.int32)
        np.add.at(change, bounds[:-1][doc] + np.maximum(anchor - PERIOD + 1, 0), 1)
        np.add.at(change, bounds[:-1][doc] + np.minimum(anchor, count[doc] - window) + 1, -1)
        start = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        of = np.searchsorted(bounds, start, "right") - 1
        held.append((_sequences(h1, start, window, 3), _sequences(h2, start, window, 4), (of + begin).astype(np.uint32), (start - bounds[:-1][of]).astype(np.uint32)))
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.Table.from_batches(S.scatter(names[some], h1, h2, doc, start, None, np.zeros(len(start), np.uint8), parts), schema=S.ENTRIES)


def _removal(texts: pa.Table, found: pa.Table, window: int, with_text: bool) -> pa.Table:
    names = S.name_array(texts.column("uid"))
    text, pos, n, _ = S.references(found, names)
    edges = np.searchsorted(text, np.arange(len(names) + 1))
    rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    for i, value in enumerate(texts.column("text").to_pylist()):
        own = (value or "").encode().split()
        kept = own
        if edges[i] < edges[i + 1]:
            gone = S.covered(pos[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]], len(own), window)
            kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
        line = b" ".join(kept)
        for c, v in zip(rows, (len(own), len(own) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None), strict=True):
            rows[c].append(v)
    columns = [texts.column("uid"), texts.column("id"), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string())]
    return pa.Table.from_arrays(columns + [pa.array(rows["kept"], pa.string())] * with_text, ["uid", "id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256, and the kept words joined by spaces where asked for.

    A word goes if a window of `window` words that covers it has a word sequence that also begins anywhere else, in
    the same document or another. Anchors are hashed at positions whose remainder modulo 21 is in a difference cover:
    two equal windows have, within their first 21 words, an offset that is a cover position in both, and so share the
    anchor of window - 20 words there. Anchors that occur once end; around the others all windows are hashed to 128
    bits and counted over the whole corpus. Counts, not pairs, decide, so a passage in many documents costs one entry
    for each of its windows at most.

    Null, empty and short texts lose nothing. Copies lose all their words if they have a window. Repeated rows are
    copies too. Extra columns are ignored. An empty table gives no rows. Shorter windows than 24 are refused.
    """
    if window - PERIOD + 1 < 4:
        raise ValueError("the window is too short for the cover")
    parts, groups = S.plan_sizes(docs, text_col)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("uid", S.uid("id", "text"))
    named, repeated = S.once(named)
    texts = named.select(S.text_groups(F.col("uid"), groups).alias("texts"), "uid", "id", "text")
    seen = named.select("uid", "text").mapInArrow(_anchors(window, parts), S.ENTRIES_DDL)
    anchors = seen.groupBy("part").applyInArrow(lambda part: S.count_part(part, groups), S.FOUND_DDL)
    spread = texts.groupBy("texts").cogroup(anchors.groupBy("texts")).applyInArrow(lambda group, found: _windows(group, found, window, parts), S.ENTRIES_DDL)
    repeats = spread.groupBy("part").applyInArrow(lambda part: S.count_part(part, groups), S.FOUND_DDL)
    kind = texts.schema["id"].dataType.simpleString()
    out = f"uid binary, id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    results = texts.groupBy("texts").cogroup(repeats.groupBy("texts")).applyInArrow(lambda group, found: _removal(group, found, window, with_text), out)
    return S.again(results, repeated).withColumnRenamed("id", id_col)
