"""Finding sequences that occur more than once: rolling hashes in numpy, and sheets of references that Spark shuffles.

Two rounds share the parts here. A round scatters hashed sequences of many documents into parts by hash; each part
counts its hashes and sends back, to the group of texts that holds the document, where sequences are that occur more
than once. Within what one task reads, repeats are found before the shuffle: of these only the first reference takes
part in the count, marked as repeated, so that a sequence in a third of all documents sends one entry for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import materialise, sifted

NO_DOC = np.uint32(0xFFFFFFFF)
#: Text that a task reads before it sends its entries on.
CHUNK_BYTES = 32_000_000
#: Text in a group that meets in a task.
GROUP_BYTES = 8_000_000
#: Values that are hashed at once.
BLOCK = 1 << 18

ENTRY = ["h1", "h2", "doc", "pos", "n", "multi", "uids", "known_doc", "known_pos", "known_n"]
ENTRIES = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ENTRY]])
ENTRIES_DDL = "part int, " + ", ".join(f"{c} binary" for c in ENTRY)
FOUND = ["uids", "doc", "pos", "n", "kind"]
FOUND_SCHEMA = pa.schema([("texts", pa.int32()), *[(c, pa.binary()) for c in FOUND]])
FOUND_DDL = "texts int, " + ", ".join(f"{c} binary" for c in FOUND)

REPEATED, ALIVE, WITNESS = 1, 2, 3


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of substrings: sums of value times multiplier to the position, modulo 2^64, moved to position 0."""

    def __init__(self, seed: int):
        self.multiplier = int(mixed(np.array([seed], np.uint64))[0]) | 1
        self.of_byte = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1))
        self._up = self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("_up", self.multiplier), ("_down", pow(self.multiplier, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[: len(values)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self._down[start]

    def spans_of_bytes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.spans(data, start, end, self.of_byte)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of values[start:end] for sorted starts and ends, in blocks of about BLOCK values: memory stays flat."""
        out = np.zeros(len(start), np.uint64)
        begin = 0
        while begin < len(start):
            base = int(start[begin])
            stop = max(begin + 1, int(np.searchsorted(end, base + BLOCK)))
            part = values[base : int(end[stop - 1])]
            prefix = self.prefix(part if codes is None else codes[part])
            out[begin:stop] = self.between(prefix, start[begin:stop] - base, end[begin:stop] - base)
            begin = stop
        return out


@lru_cache(maxsize=8)
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and their offsets (one more than there are texts); null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8), offsets - offsets[0]


def portions(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    begin = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, stop
        begin = stop


def uid(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text; rows that agree in both share it and get the same answer."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


def once(named: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (uid, ...) with one of those that share a uid, and how often the shared ones occur (uid, n); None without any.

    So rows that repeat without end don't meet in one group of texts; `again` gives each of them its result.
    """
    repeated = materialise(named.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if repeated.isEmpty():
        return named, None
    clear, doubtful = sifted(named, F.xxhash64("uid"), repeated.select(F.xxhash64("uid").alias("key")), "key")
    place = F.row_number().over(Window.partitionBy("uid").orderBy("uid"))
    return clear.unionByName(doubtful.withColumn("_place", place).filter("_place = 1").drop("_place")), repeated


def again(results: DataFrame, repeated: DataFrame | None, portion: int = 10_000) -> DataFrame:
    """Results by uid, as often as their rows occur, without the uid.

    A row that occurs more than `portion` times is multiplied in portions, which are dealt out before they unfold, so
    that rows repeated without end don't come out of one task.
    """
    if repeated is not None:
        columns, n = results.columns, F.coalesce("n", F.lit(1))
        results = results.join(repeated, "uid", "left")
        if repeated.filter(F.col("n") > portion).isEmpty():
            results = results.select(*columns, n.alias("_n"))
        else:
            sizes = F.transform(F.sequence(F.lit(0), F.expr(f"cast((coalesce(n, 1) - 1) div {portion} as int)")), lambda i: F.least(F.lit(portion), n - i * portion))
            results = results.select(*columns, F.explode(sizes).alias("_n")).repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        results = results.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_time")).drop("_time")
    return results.drop("uid")


def text_groups(name: Column, groups: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(name), 1, 8), 16, 10).cast("long"), F.lit(groups)).cast("int")


def groups_of(names: np.ndarray, groups: int) -> np.ndarray:
    """The same of an array of 16-byte names."""
    return (names.view(">u4").reshape(-1, 4)[:, 0] % groups).astype(np.int32) if len(names) else np.zeros(0, np.int32)


def name_array(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), "S16") if len(column) else np.zeros(0, "S16")


def _pack(x: np.ndarray | None, kind: str) -> bytes:
    return b"" if x is None else np.ascontiguousarray(x, kind).tobytes()


def scatter(names: np.ndarray, h1: np.ndarray, h2: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, n: np.ndarray | None, multi: np.ndarray, parts: int, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Entries of one task by part. Repeats among them leave one entry, marked; their other references are known."""
    order = np.lexsort((multi == 0, h1)) if h2 is None else np.lexsort((multi == 0, h2, h1))
    same = h1[order][1:] == h1[order][:-1]
    if h2 is not None:
        same &= h2[order][1:] == h2[order][:-1]
    again = np.concatenate(([False], same)) if len(order) else np.zeros(0, bool)
    before_same = np.concatenate((same, [False])) if len(order) else again
    later = np.zeros(len(h1), bool)
    later[order] = again
    multi = multi.copy()
    multi[order[before_same]] = 1
    first, rest = np.flatnonzero(~later), np.flatnonzero(later & (doc != NO_DOC))
    known_doc, known_pos, known_n = known or (np.zeros(0, np.uint32),) * 3
    known_doc = np.concatenate((known_doc, doc[rest]))
    known_pos = np.concatenate((known_pos, pos[rest]))
    known_n = np.concatenate((known_n, n[rest] if n is not None else np.ones(len(rest), np.uint32)))
    to, known_to = (h1[first] % np.uint64(parts)).astype(np.int64), groups_of(names, parts)[known_doc].astype(np.int64)
    by, known_by = np.argsort(to, kind="stable"), np.argsort(known_to, kind="stable")
    edges, known_edges = np.searchsorted(to[by], np.arange(parts + 1)), np.searchsorted(known_to[known_by], np.arange(parts + 1))
    rows: dict[str, list] = {c: [] for c in ENTRIES.names}
    for part in range(parts):
        i, k = first[by[edges[part] : edges[part + 1]]], known_by[known_edges[part] : known_edges[part + 1]]
        if not len(i) and not len(k):
            continue
        real = doc[i] != NO_DOC
        used, at = np.unique(np.concatenate((doc[i][real], known_doc[k])), return_inverse=True)
        local = np.full(len(i), NO_DOC, np.uint32)
        local[real] = at[: real.sum()]
        values = (part, _pack(h1[i], "<u8"), _pack(h2[i] if h2 is not None else None, "<u8"), _pack(local, "<u4"), _pack(pos[i], "<u4"), _pack(n[i] if n is not None else None, "<u2"), _pack(multi[i], "u1"), names[used].astype("S16").tobytes(), _pack(at[real.sum() :], "<u4"), _pack(known_pos[k], "<u4"), _pack(known_n[k], "<u2"))
        for c, v in zip(rows, values, strict=True):
            rows[c].append(v)
    yield pa.RecordBatch.from_pydict(rows, schema=ENTRIES)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def gather(table: pa.Table, doc: str = "doc") -> tuple[np.ndarray, np.ndarray]:
    """All names of a part or group, and of each reference in column `doc` its place among them."""
    names, docs, base = [], [], 0
    for uids, refs in zip(table.column("uids").to_pylist(), table.column(doc).to_pylist(), strict=True):
        held, at = np.frombuffer(uids, "S16"), np.frombuffer(refs, "<u4").astype(np.int64)
        docs.append(np.where(at == NO_DOC, -1, at + base))
        names.append(held)
        base += len(held)
    return np.concatenate(names) if names else np.zeros(0, "S16"), np.concatenate(docs) if docs else np.zeros(0, np.int64)


def found_rows(names: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, kind: np.ndarray, groups: int) -> pa.Table:
    """References by the group of texts that holds their document."""
    rows: dict[str, list] = {c: [] for c in FOUND_SCHEMA.names}
    to = groups_of(names, groups)[doc] if len(doc) else np.zeros(0, np.int32)
    by = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(np.concatenate(([-1], to[by], [-1])))) if len(to) else np.zeros(0, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        i = by[a:b]
        used, at = np.unique(doc[i], return_inverse=True)
        for c, v in zip(rows, (int(to[i[0]]), names[used].tobytes(), _pack(at, "<u4"), _pack(pos[i], "<u4"), _pack(n[i], "<u2"), _pack(kind[i], "u1")), strict=True):
            rows[c].append(v)
    return pa.Table.from_pydict(rows, schema=FOUND_SCHEMA)


def count_part(table: pa.Table, groups: int, refine: bool = False) -> pa.Table:
    """References of a part's sequences that occur more than once.

    With `refine`, h1 is a bucket and h2 what refines it: references whose h2 repeats are REPEATED; others whose bucket
    repeats stay ALIVE; of a repeated h2 in a bucket with such, one reference is its WITNESS.
    """
    names, doc = gather(table)
    h1, h2 = _column(table, "h1", "<u8"), _column(table, "h2", "<u8")
    pos, n, multi = _column(table, "pos", "<u4"), _column(table, "n", "<u2"), _column(table, "multi", "u1").astype(bool)
    n = n if len(n) else np.ones(len(pos), np.uint16)
    order = np.lexsort((h2, h1)) if len(h2) else np.argsort(h1, kind="stable")
    kind = np.zeros(len(h1), np.uint8)
    if len(order):
        new_bucket = np.concatenate(([True], h1[order][1:] != h1[order][:-1]))
        new = new_bucket | np.concatenate(([True], h2[order][1:] != h2[order][:-1])) if len(h2) else new_bucket
        run = np.cumsum(new) - 1
        repeated = (np.bincount(run) > 1) | (np.bincount(run, weights=multi[order]) > 0)
        kind[order] = repeated[run] * REPEATED
        if refine:
            bucket = np.cumsum(new_bucket) - 1
            full = (np.bincount(bucket) > 1)[bucket] & ~repeated[run]
            kind[order[full]] = ALIVE
            witness = new & repeated[run] & (np.bincount(bucket, weights=full) > 0)[bucket]
            kind[order[witness]] = WITNESS
    told = (kind > 0) & (doc >= 0)
    known_doc = gather(table, "known_doc")[1]
    known = [_column(table, "known_pos", "<u4"), _column(table, "known_n", "<u2"), np.full(len(known_doc), REPEATED, np.uint8)]
    doc, pos, n, kind = (np.concatenate((x[told], y)) for x, y in zip((doc, pos, n, kind), (known_doc, *known), strict=True))
    return found_rows(names, doc, pos, n, kind, groups)


def references(found: pa.Table, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, pos, n, kind) of a group's references, sorted by text and pos; a name that several texts share counts for each."""
    refs_names, doc = gather(found)
    pos, n, kind = _column(found, "pos", "<u4").astype(np.int64), _column(found, "n", "<u2").astype(np.int64), _column(found, "kind", "u1")
    by = np.argsort(names, kind="stable")
    low, high = np.searchsorted(names[by], refs_names, "left"), np.searchsorted(names[by], refs_names, "right")
    times = (high - low)[doc]
    each = np.repeat(np.arange(len(doc)), times)
    step = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    text = by[low[doc[each]] + step]
    order = np.lexsort((pos[each], text))
    return text[order], pos[each][order], n[each][order], kind[each][order]


def covered(starts: np.ndarray, lengths: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of `total` places lie in a window of `width` that begins in one of the runs of window starts."""
    change = np.zeros(total + width + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths + width - 1, -1)
    return np.cumsum(change)[:total] > 0


def plan_sizes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Numbers of parts and of groups of texts, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, total // (4 * GROUP_BYTES)), max(least, total // GROUP_BYTES)
