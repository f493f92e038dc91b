"""Suffix-array deduplication over bytes by bucket-pointer refinement.

Suffixes are bucketed by their first q bytes, and buckets are refined by the bucket identifiers of later offsets: a
suffix's bucket at depth 2q is the pair of its bucket and that of the suffix q further on. An identifier is a hash of
the q bytes, equal wherever they are, so refining needs no renumbering between tasks, and buckets of one suffix are
final and dropped at once. With q half the window (the two halves of an odd one share a byte), one refinement reaches
the window's depth, so it stands for the whole recursion.

All suffixes of all texts can't be sorted within a few times the input's size; so the first buckets hold only the
suffixes that each window chooses for itself, the one with the least identifier among its own. Equal windows choose
alike, so each repeated window lies on a chosen suffix whose bucket has another member, and only windows around those
are refined one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sequences as S

#: Window starts that are handled at once; a longer text comes in slices that overlap by a window.
SLICE = 250_000
_PLACE_BITS = np.uint64(21)


def _slices(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts, or slices of a long one: bytes, each segment's text, its place in the text and its edges."""
    held: list[tuple[int, int, int]] = []
    size = 0

    def out():
        ends = np.cumsum([b - a for _, a, b in held])
        bytes_ = np.concatenate([data[offsets[t] + a : offsets[t] + b] for t, a, b in held])
        return bytes_, np.array([t for t, _, _ in held]), np.array([a for _, a, _ in held]), np.concatenate(([0], ends))

    for t in np.flatnonzero(np.diff(offsets) >= window).tolist():
        length = int(offsets[t + 1] - offsets[t])
        for a in range(0, length - window + 1, SLICE):
            b = min(length, a + SLICE + window - 1)
            if held and size + b - a > SLICE + window:
                yield out()
                held, size = [], 0
            held.append((t, a, b))
            size += b - a
    if held:
        yield out()


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys: running minima from both ends of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Buckets:
    """Bucket identifiers of a slice's q-byte prefixes, and the runs of windows that choose the same suffix."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, window: int, families: tuple[int, ...] = (5, 6)):
        self.window, self.q = window, -(-window // 2)
        self.rolls = [S.rolling(f) for f in families]
        self.prefixes = [r.prefix(r.of_byte[data]) for r in self.rolls]
        self.edges, self.n = edges, len(data)

    def at(self, starts: np.ndarray, family: int) -> np.ndarray:
        return S.mixed(self.rolls[family].between(self.prefixes[family], starts, starts + self.q))

    def refined(self, family: int, *starts: np.ndarray) -> np.ndarray:
        """The identifier that stands for the buckets at several offsets, in turn."""
        out = np.zeros(len(starts[0]), np.uint64)
        for s in starts:
            out = S.mixed(out * np.uint64(0xD1342543DE82EF95) + self.at(s, family))
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window start and chosen suffix of each run of windows with the same choice."""
        all_starts = np.arange(self.n - self.q + 1)
        key = (self.at(all_starts, 0) >> _PLACE_BITS << _PLACE_BITS) | all_starts.astype(np.uint64)
        chosen = _least(key, self.window - self.q + 1) & np.uint64((1 << 21) - 1)
        segment_end = np.repeat(self.edges[1:], np.diff(self.edges))
        start = np.flatnonzero(np.arange(len(chosen)) + self.window <= segment_end[: len(chosen)])
        choice = chosen[start].astype(np.int64)
        new = np.concatenate(([True], (choice[1:] != choice[:-1]) | (start[1:] != start[:-1] + 1)))
        first = np.flatnonzero(new)
        return start[first], start[np.append(first[1:], len(start)) - 1], choice[first]


def _chosen(window: int, parts: int):
    """For each run of windows: the chosen suffix's bucket, refined by the buckets that together span the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size, docs = [], [], 0, 0

        def send():
            h1, h2, doc, pos, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return S.scatter(np.concatenate(names), h1, h2, doc, pos, n, np.zeros(len(h1), np.uint8), parts)

        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                data, offsets = S.utf8(part.column(1))
                for piece, text, place, edges in _slices(data, offsets, window):
                    buckets = Buckets(piece, edges, window)
                    first, last, choice = buckets.runs()
                    segment = np.searchsorted(edges, first, "right") - 1
                    q = buckets.q
                    span = S.mixed(buckets.refined(1, first, first + window - q, last + window - q) + (last - first).astype(np.uint64))
                    held.append((buckets.at(choice, 0), span, (text[segment] + docs).astype(np.uint32), (place[segment] + first - edges[segment]).astype(np.uint32), (last - first + 1).astype(np.uint32)))
                names.append(S.name_array(part.column(0)))
                size, docs = size + len(data), docs + len(part)
                if size > S.CHUNK_BYTES and held:
                    yield from send()
                    held, names, size, docs = [], [], 0, 0
        if held:
            yield from send()

    return run


def _refined(texts: pa.Table, found: pa.Table, window: int, parts: int) -> pa.Table:
    """Each window of the runs that are still alive, at the window's depth; runs known to repeat pass through."""
    names = S.name_array(texts.column("uid"))
    text, pos, n, kind = S.references(found, names)
    some, at = np.unique(text, return_inverse=True)
    if not len(some):
        return S.ENTRIES.empty_table()
    done = (kind == S.REPEATED) | (kind == S.WITNESS)
    known = (at[done].astype(np.uint32), pos[done].astype(np.uint32), n[done].astype(np.uint32))
    open_ = kind != S.REPEATED
    held = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.uint32),) * 2 + (np.zeros(0, np.uint8),)]
    if open_.any():
        wanted, which = np.unique(at[open_], return_inverse=True)
        data, offsets = S.utf8(texts.column("text").combine_chunks().take(pa.array(some[wanted])))
        run_pos, run_n, run_kind = pos[open_], n[open_], kind[open_]
        q = -(-window // 2)
        for piece, of, place, edges in _slices(data, offsets, window):
            buckets = Buckets(piece, edges, window)
            starts, docs, flags = [], [], []
            for s in range(len(of)):
                a, b = np.searchsorted(which, of[s], "left"), np.searchsorted(which, of[s], "right")
                mine = np.arange(a, b)
                mine = mine[(run_pos[a:b] >= place[s]) & (run_pos[a:b] < place[s] + SLICE)]
                each = np.repeat(mine, run_n[mine])
                step = np.arange(len(each)) - np.repeat(np.cumsum(run_n[mine]) - run_n[mine], run_n[mine])
                starts.append(edges[s] + run_pos[each] + step - place[s])
                docs.append(each)
                flags.append(np.full(len(each), place[s] - edges[s]))
            start, each, shift = np.concatenate(starts), np.concatenate(docs), np.concatenate(flags)
            witness = run_kind[each] == S.WITNESS
            doc = np.where(witness, S.NO_DOC, wanted[which[each]].astype(np.uint32))
            held.append((buckets.refined(0, start, start + window - q), buckets.refined(1, start, start + window - q), doc.astype(np.uint32), (start + shift).astype(np.uint32), witness.astype(np.uint8)))
    h1, h2, doc, pos_, multi = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.Table.from_batches(S.scatter(names[some], h1, h2, doc, pos_, None, multi, parts, known), schema=S.ENTRIES)


def _removal(texts: pa.Table, found: pa.Table, window: int, with_text: bool) -> pa.Table:
    names = S.name_array(texts.column("uid"))
    text, pos, n, _ = S.references(found, names)
    edges = np.searchsorted(text, np.arange(len(names) + 1))
    data, offsets = S.utf8(texts.column("text").combine_chunks())
    rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for i in range(len(names)):
        own = data[offsets[i] : offsets[i + 1]]
        kept, spans = own, 0
        if edges[i] < edges[i + 1]:
            gone = S.covered(pos[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]], len(own), window)
            kept, spans = own[~gone], int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        raw = kept.tobytes()
        for c, v in zip(rows, (len(own), len(own) - len(kept), spans, hashlib.sha256(raw).hexdigest(), raw if with_text else None), strict=True):
            rows[c].append(v)
    columns = [texts.column("uid"), texts.column("id"), *[pa.array(rows[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(rows["kept_sha256"], pa.string())]
    return pa.Table.from_arrays(columns + [pa.array(rows["kept"], pa.binary())] * with_text, ["uid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes where asked for.

    A byte goes if a string of `window` bytes that covers it also begins anywhere else, in the same document or
    another. Windows that choose the same suffix form a run, whose bytes are spanned by three buckets: runs whose
    spans repeat are found whole. In buckets with other members, the windows of the runs that are left are refined to
    128-bit identifiers of the window and counted; a run that repeats whole lends its windows once.

    Null, empty and short texts lose nothing. Copies of a window or more lose all. Cuts may fall within a character;
    the kept bytes are those of the contract, not always a text. Repeated rows are copies. Extra columns are ignored.
    An empty table gives no rows.
    """
    parts, groups = S.plan_sizes(docs, text_col)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("uid", S.uid("id", "text"))
    named, repeated = S.once(named)
    texts = named.select(S.text_groups(F.col("uid"), groups).alias("texts"), "uid", "id", "text")
    seen = named.select("uid", "text").mapInArrow(_chosen(window, parts), S.ENTRIES_DDL)
    runs = seen.groupBy("part").applyInArrow(lambda part: S.count_part(part, groups, refine=True), S.FOUND_DDL)
    alive = texts.groupBy("texts").cogroup(runs.groupBy("texts")).applyInArrow(lambda group, found: _refined(group, found, window, parts), S.ENTRIES_DDL)
    repeats = alive.groupBy("part").applyInArrow(lambda part: S.count_part(part, groups), S.FOUND_DDL)
    kind = texts.schema["id"].dataType.simpleString()
    out = f"uid binary, id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    results = texts.groupBy("texts").cogroup(repeats.groupBy("texts")).applyInArrow(lambda group, found: _removal(group, found, window, with_text), out)
    return S.again(results, repeated).withColumnRenamed("id", id_col)
