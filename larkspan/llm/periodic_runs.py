"""Periodic runs of words: repeated k-grams mask each text, Main and Lorentz's division finds the runs in what is left."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sequences as S
from larkspan.llm.common import lean

#: Text that is cut to words at once; a longer text comes in slices.
SLICE_BYTES = 4_000_000
RUNS_DDL = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_overlap(least_length: int, exponent: int) -> int:
    """k, the least number of words by which a run and itself, one period on, overlap.

    A run of period q has max(least_length, exponent * q) words or more, and all but q of them occur again q words on.
    The two places cover the run, so each of its words lies in a k-gram that its document repeats.
    """
    return min(max(least_length, exponent * q) - q for q in range(1, least_length + 1))


def _prefix_squares(w: list[int], mid: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """(q, z) for each q up to `most` for which w[mid:mid + q] is no power and stands twice; z words at mid and mid + q agree."""
    if most < 1:
        return
    try:
        w.index(w[mid], mid + 1, mid + most + 1)
    except ValueError:
        return
    size, z, left, right, found = hi - mid, [0] * (most + 1), 0, 0, []
    for q in range(1, most + 1):
        n = min(right - q, z[q - left]) if q < right else 0
        while q + n < size and w[mid + n] == w[mid + q + n]:
            n += 1
        if q + n > right:
            left, right = q, q + n
        z[q] = n
        if n >= q and not any(q % p == 0 and z[p] + p >= 2 * q for p in found):
            found.append(q)
            yield q, n


def _beside(w: list[int], lo: int, mid: int, hi: int, least_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """Runs of w[lo:hi] with two periods or more at mid and after it, as (start, end, period)."""
    for q, agree in _prefix_squares(w, mid, hi, min((hi - lo) // exponent, (hi - mid) // 2)):
        start, end = mid, mid + q + agree
        while start > lo and w[start - 1] == w[start - 1 + q]:
            start -= 1
        if end - start >= max(least_length, exponent * q):
            yield start, end, q


def runs_in(words: list[int], least_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start: maximal stretches of their least period, of at least `exponent` periods.

    Main and Lorentz's division: a run lies in a half or crosses the middle. One that crosses has two of its four
    periods on one side, so it shows as a square at the middle, in the text or in the reversed text, and one Z array for
    each side finds the squares in linear time. A stretch that the enclosing part extends was found there.
    """
    if exponent < 4:
        raise ValueError("a run of fewer than four periods needs no square beside the middle")
    n, back, found = len(words), words[::-1], {}
    parts = [(0, n)]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least_length:
            continue
        mid = (lo + hi) // 2
        parts += [(lo, mid), (mid, hi)]
        after = _beside(words, lo, mid, hi, least_length, exponent)
        before = ((n - e, n - s, q) for s, e, q in _beside(back, n - hi, n - mid, n - lo, least_length, exponent))
        for side in (after, before):
            for start, end, q in side:
                wider = start == lo and lo and words[lo - 1] == words[lo - 1 + q] or end == hi and hi < n and words[hi] == words[hi - q]
                if not wider:
                    found[start, end] = min(q, found.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _slices(text: memoryview) -> Iterator[bytes]:
    """The text in slices that no word crosses."""
    begin = 0
    while len(text) - begin > SLICE_BYTES:
        rest = np.frombuffer(text, np.uint8)[begin + SLICE_BYTES :]
        blank = np.flatnonzero((rest == 0x20) | ((rest >= 0x09) & (rest <= 0x0D)))[:1]
        if not len(blank):
            break
        stop = begin + SLICE_BYTES + int(blank[0])
        yield bytes(text[begin:stop])
        begin = stop
    yield bytes(text[begin:])


def repeated_grams(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document repeats. Hashes that meet by chance leave more words, never fewer."""
    m = len(ids) - k + 1
    if m < 2:
        return np.zeros(len(ids), bool)
    gram = S.mixed(doc[:m].astype(np.uint64) + np.uint64(1))
    for j in range(k):
        gram = (gram ^ ids[j : m + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    whole = doc[:m] == doc[k - 1 :]
    held = np.sort(gram[whole])
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(twice):
        return np.zeros(len(ids), bool)
    begins = whole & (twice[np.minimum(np.searchsorted(twice, gram), len(twice) - 1)] == gram)
    up = np.concatenate(([0], np.cumsum(begins), np.full(k - 1, begins.sum())))
    return up[1:] > up[np.maximum(np.arange(len(ids)) - k + 1, 0)]


def _search(least_length: int, exponent: int, with_text: bool):
    k = least_overlap(least_length, exponent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in S.portions(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                data, offsets = S.utf8(part.column(1))
                code, coded, sizes = defaultdict(count().__next__), [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = [np.fromiter(map(code.__getitem__, words), np.int32, len(words)) for words in map(bytes.split, _slices(memoryview(data)[a:b]))]
                    coded += own
                    sizes.append(sum(map(len, own)))
                ids, sizes = np.concatenate(coded), np.array(sizes)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                alive = repeated_grams(ids, doc, k)
                edge = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
                first = np.flatnonzero(alive & (edge | ~np.roll(alive, 1)))
                last = np.flatnonzero(alive & np.roll(edge | ~alive, -1)) + 1
                runs: list[list[dict]] = [[] for _ in sizes]
                gone = np.zeros(len(ids), bool)
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    if b - a >= least_length:
                        for start, length, q in runs_in(ids[a:b].tolist(), least_length, exponent):
                            runs[doc[a]].append({"start": a + start - int(bounds[doc[a]]), "length": length, "period": q})
                            gone[a + start + q : a + start + length] = True
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN))]
                if with_text:
                    name = list(code).__getitem__
                    kept = [b" ".join(map(name, ids[a:b][~gone[a:b]].tolist())).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    columns.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", *["collapsed"] * with_text])

    return lean(run)


def find_runs(docs: DataFrame, least_length: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row a document: id, n_words, runs (start, length, period; by start), and the collapsed text where asked for.

    Words are runs of bytes other than blanks and the controls 9 to 13. A run is a stretch of words with least period
    q, of max(least_length, exponent * q) words or more, which no neighbouring word extends. The collapsed text has no
    word that lies in a run after the run's first period; the others are joined by one space.

    A map over the documents: no shuffle, so a hot source or copies cost nothing extra. A task holds about a megabyte of
    text at a time, or one longer document as word numbers. In random text almost every word is masked. Null and
    empty texts have no words and an empty collapsed text. Repeated rows give repeated results; an empty table gives
    none. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_words long, runs {RUNS_DDL}" + ", collapsed string" * with_text
    return rows.mapInArrow(_search(least_length, exponent, with_text), out).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """Of runs sorted by start, the one with the greatest length over period, compared exactly; the first of equals."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def digest(runs: Column) -> Column:
    """SHA-256 of all runs as lines `start,length,period`."""
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""), 256)


def with_planted_tail(id_: Column, text: Column, word: str) -> Column:
    """The text as it is, or for a tenth of the ids, chosen by CRC-32, with a tail that repeats its own words periodically."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    planted = F.element_at(F.transform(F.array(words), tail), 1)
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(word)), planted).otherwise(text)
