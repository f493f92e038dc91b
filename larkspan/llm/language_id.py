"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties; scores are calibrated by temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import lean

#: Hashed n-gram space and the lengths of the n-grams.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters that are turned into n-grams at once, and rows whose texts are Python strings at once.
CHUNK_CHARS, CHUNK_ROWS = 250_000, 500
NO_LANGUAGE = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Of each code point of the basic plane: itself if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


def _letters(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Lower-case code points of runs of texts, other characters than letters as single blanks, and their text's number.

    Yields (first text, text after the last, code points, text numbers from the first, begins): n-grams that begin at
    `begins` or later belong to the next slice. A text longer than a chunk comes in slices, each of which begins with a
    letter and has the two code points that follow it, so that slices together have exactly the n-grams of the text.
    """
    held: list[str] = []
    first, size = 0, 0

    def coded(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        number = np.cumsum(points == 0)
        known = _letter_table()[np.minimum(points, 0xFFFF)]
        for far in np.unique(points[points > 0xFFFF]):
            known[points == far] = far if chr(far).isalpha() else 32
        same = np.zeros(len(known), bool)
        same[1:] = (number[1:] == number[:-1]) & (known[1:] == 32) & (known[:-1] == 32)
        return known[~same], number[~same]

    def whole(parts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        points, number = coded(parts)
        return points, number, len(points)

    for i, text in enumerate(texts):
        text = (text or "").replace("\0", " ").lower()
        if held and size + len(text) > CHUNK_CHARS:
            yield first, i, *whole(held)
            held, first, size = [], i, 0
        begin = 0
        while len(text) - begin > CHUNK_CHARS:
            end = begin + CHUNK_CHARS
            follows = next((j for j in range(end, len(text)) if text[j].isalpha()), len(text))
            own = text[begin:end] + " " * (follows > end)
            points, number = coded([own + text[follows : follows + max(ORDERS) - 1]])
            yield i, i + 1, points, number, len(coded([own])[0]) if follows < len(text) else len(points)
            begin = follows
        held.append(text[begin:])
        size += len(text) - begin
    if held:
        yield first, len(texts), *whole(held)


def _grams(points: np.ndarray, number: np.ndarray, begins: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams that begin before `begins`, for each order; n-grams don't span texts and have a letter in them."""
    letter = points != 32
    for order in ORDERS:
        n = min(len(points) - order + 1, begins)
        if n <= 0:
            continue
        hashed, any_letter = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(order):
            hashed = (hashed + points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            any_letter |= letter[k : k + n]
        inside = any_letter & (number[:n] == number[order - 1 : order - 1 + n])
        yield number[:n][inside], (hashed[inside] >> np.uint64(49)).astype(np.int32)


def text_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for _, _, *slice_ in _letters([text]):
        for _, bucket in _grams(*slice_):
            total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), CHUNK_ROWS):
            yield batch.slice(begin, CHUNK_ROWS)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents that have it) of a partition."""
    found = np.zeros(BUCKETS, np.int64)
    for batch in _parts(batches):
        texts = batch.column(0).to_pylist()
        for begin in range(0, len(texts), 64):
            part = texts[begin : begin + 64]
            seen = np.zeros((len(part), BUCKETS), bool)
            for first, _, *slice_ in _letters(part):
                for text, bucket in _grams(*slice_):
                    seen[text + first, bucket] = True
            found += seen.sum(axis=0)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        pairs = [text_counts(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([b.tobytes() for _, b in pairs], pa.binary()), batch.column(2)], ["lang", "buckets", "counts", "share"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, the inverse document frequency included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all texts, and which of them have a letter."""
        sums, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, _, *slice_ in _letters(texts):
            for text, bucket in _grams(*slice_):
                if not len(text):
                    continue
                begins = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
                which = text[begins] + first
                sums[which] += np.add.reduceat(self.weights[bucket], begins, axis=0, dtype=np.float64)
                grams[which] += np.diff(np.append(begins, len(text)))
        return SCALE * sums / np.maximum(grams, 1)[:, None] + self.bias, grams > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        logits, letters = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else NO_LANGUAGE for b, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(len(best)), best], 0.0)


#: Features are n-gram frequencies times their inverse document frequency; the factor brings them near 1.
SCALE = 20.0


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes, sparse through l1) and bias of a multinomial logistic regression, by FTRL-proximal.

    Each coordinate keeps its sum z of adjusted gradients and its sum n of their squares; its weight is 0 while |z| is
    within l1, and else the elastic net's minimiser. The bias is a feature of value 1 without l1.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights_of(at):
        slack = np.abs(z[at]) - np.where(at == BUCKETS, 0.0, l1)[:, None]
        return np.where(slack > 0, -np.sign(z[at]) * slack / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    ready = [(np.append(i, BUCKETS), np.append(x, 1.0), y) for i, x, y in examples]
    for _ in range(epochs):
        for k in order.permutation(len(ready)):
            at, x, y = ready[k]
            w = weights_of(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights_of(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log likelihood: a grid over its logarithm, refined around the best.

    The truth counts as 1 - 1 / (rows + 1) and the rest is spread over the classes, so that a sample without an error
    doesn't ask for boundless certainty.
    """
    doubt = 1.0 / (len(truth) + 1)
    low, high = np.log(0.05), np.log(20.0)
    for _ in range(4):
        grid = np.linspace(low, high, 25)
        loss = []
        for t in grid:
            surprise = -np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-12))
            loss.append(((1 - doubt) * surprise[np.arange(len(truth)), truth] + doubt * surprise.mean(axis=1)).mean())
        best, step = grid[int(np.argmin(loss))], grid[1] - grid[0]
        low, high = best - step, best + step
    return float(np.exp(best))


def fit(docs: DataFrame, learnable: Column, max_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows that `learnable` admits and whose language is known; None where there are none.

    Document frequencies cover all of those rows. The weights and the temperature are fitted on a bounded sample of
    about `max_docs` rows, the same number for each language as far as it has them, chosen by a hash of the id; a
    fifth of the sample is for the temperature. The driver gets at most BUCKETS counts for a sampled document.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.coalesce(learnable, F.lit(False)) & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    counts = rows.select("text").mapInArrow(lean(_presence), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS)
    for row in counts.collect():  # at most BUCKETS rows
        frequency[row["bucket"]] = row["n"]
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + frequency)) + 1.0

    quota = max(1, max_docs // len(languages))
    share = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1_000_000))
    limit = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1_000_000, -(-1_000_000 * quota // sizes[lang])))]), F.col("lang"))
    sample = rows.withColumn("share", share).filter(F.col("share") < limit).select("lang", "text", "share").mapInArrow(lean(_features), "lang string, buckets binary, counts binary, share long")
    training, held = [], []
    # In an order of their own, so that reruns learn alike; the limit holds where one id repeats without end.
    for row in sample.orderBy("share", "lang", "buckets", "counts").limit(2 * max_docs).collect():
        at, n = np.frombuffer(row["buckets"], np.int32), np.frombuffer(row["counts"], np.float32)
        if len(at):
            (held if row["share"] % 5 == 0 else training).append((at, SCALE * n / n.sum() * idf[at], languages.index(row["lang"])))
    weights, bias = train_ftrl(training, len(languages)) if training else (np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held])
    temperature = fit_temperature(logits, np.array([y for _, _, y in held])) if held else 1.0
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, temperature)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = model.predict(texts) if model else ([NO_LANGUAGE] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row a document: id, held_out, lang_pred, score.

    The model learns from documents with a language whose crc32(id as text) mod 5 is not 0; the others are held out.
    Predictions use the whole text and nothing else. Texts without a letter, and null ones, get `und` with score 0.
    A null id is neither held out nor learned from. Repeated rows get equal predictions. Without any row to learn
    from, all get `und`. Languages are any values of the column. Extra columns are ignored.
    """
    model = fit(docs, fold(id_col) != 0, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_predict(model)), f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def _accept(model: Model | None, least: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(text_at).to_pylist()
            lang, score = model.predict(texts) if model else ([NO_LANGUAGE] * len(texts), np.zeros(len(texts)))
            yield batch.filter(pa.array([x != NO_LANGUAGE for x in lang]) if least <= 0 else pa.array(np.array([x != NO_LANGUAGE for x in lang], bool) & (score >= least)))

    return run


def accepted(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs whose text has a language with a score of `least_score` or more; all columns unchanged."""
    model = fit(docs, fold(id_col) != 0, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return docs.mapInArrow(lean(_accept(model, least_score, docs.columns.index(text_col))), docs.schema)
