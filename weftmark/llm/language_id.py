"""Language identification with string kernels.

The kernel of two texts is the mean, over n-gram lengths, of the cosine of their n-gram
presence sets (a blended spectrum).  Nyström landmarks turn it into features; ridge
regression on those, one language against the rest, gives the classifier.  A batch of
texts is scored by matrix products: its presence matrix times the landmarks', for each
length, and the kernel times the learned coefficients.

The fit reads a bounded sample of labelled rows, written once; only landmarks and sums
(a matrix of landmarks by landmarks) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmark.llm.texts import bounded_batches, slices
from weftmark.plans.shared import discard, materialize

#: n-gram lengths in bytes of UTF-8.
LENGTHS = (2, 3, 4)
#: Bounds of the fit: labelled rows and landmarks over all languages, bytes of a labelled text, n-grams of a landmark and length.
FIT_ROWS, LANDMARKS, FIT_BYTES, FIT_GRAMS = 2400, 96, 1 << 16, 1 << 15
RIDGE = 1e-4
UNKNOWN = "und"
#: Texts in one matrix product, and n-grams that are sorted at a time.
PRODUCT_ROWS, SORTED_GRAMS = 128, 1 << 21

_LETTERS = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_EVEN = np.uint64(0x9E3779B97F4A7C15)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values, a bounded number of values at a time."""
    if len(keys) <= SORTED_GRAMS:
        return np.unique(keys)
    parts = [np.unique(keys[i : i + SORTED_GRAMS]) for i in range(0, len(keys), SORTED_GRAMS)]
    return np.unique(np.concatenate(parts))


@dataclass
class Presence:
    """n-gram presence of a batch of texts: per length the pairs (text, n-gram), sorted, and whether a text has a letter."""

    texts: int
    lettered: np.ndarray
    owner: list[np.ndarray]
    gram: list[np.ndarray]


def presence(texts: pa.Array) -> Presence:
    """Presence sets of a batch of texts; a null has none.

    Letters are lower-cased; ASCII characters that are no letters count as spaces, and a
    space stands before and after each text.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    lower = pc.utf8_lower(texts).cast(pa.large_binary())
    n = len(lower)
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + n + 1]
    sizes = np.diff(offsets)
    raw = lower.buffers()[2]
    body = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    data = np.full(len(body) + 2 * n, 32, dtype=np.uint8)
    data[np.arange(len(body)) + np.repeat(2 * np.arange(n) + 1, sizes)] = _LETTERS[body]
    owner = np.repeat(np.arange(n), sizes + 2)
    owners, grams = [], []
    for length in LENGTHS:
        count = max(0, len(data) - length + 1)
        gram = np.zeros(count, dtype=np.int64)
        for j in range(length):
            gram = gram << 8 | data[j : j + count]
        inside = owner[:count] == owner[length - 1 : length - 1 + count]
        keys = _distinct((owner[:count] << 32 | gram)[inside])
        owners.append(keys >> 32)
        grams.append(keys & 0xFFFFFFFF)
    return Presence(n, lettered, owners, grams)


class Landmarks:
    """n-gram sets of the landmark texts, as one 0/1 matrix a length."""

    def __init__(self, sets: list[list[np.ndarray]]):
        self.vocabulary, self.marks, self.norms = [], [], []
        for place in range(len(LENGTHS)):
            vocabulary = np.unique(np.concatenate([s[place] for s in sets]))
            marks = np.zeros((len(vocabulary), len(sets)), dtype=np.float32)
            for column, s in enumerate(sets):
                marks[np.searchsorted(vocabulary, s[place]), column] = 1.0
            self.vocabulary.append(vocabulary)
            self.marks.append(marks)
            self.norms.append(np.sqrt(np.maximum(marks.sum(0), 1.0)))

    def kernel(self, batch: Presence) -> np.ndarray:
        """Kernel of the batch's texts (rows) and the landmarks (columns)."""
        total = np.zeros((batch.texts, len(self.norms[0])))
        for vocabulary, marks, norms, owner, gram in zip(
            self.vocabulary, self.marks, self.norms, batch.owner, batch.gram, strict=True
        ):
            sizes = np.sqrt(np.maximum(np.bincount(owner, minlength=batch.texts), 1))
            place = np.minimum(np.searchsorted(vocabulary, gram), len(vocabulary) - 1)
            known = vocabulary[place] == gram
            owner, place = owner[known], place[known]
            for low in range(0, batch.texts, PRODUCT_ROWS):
                high = min(batch.texts, low + PRODUCT_ROWS)
                first, last = np.searchsorted(owner, (low, high))
                held = np.zeros((high - low, len(vocabulary)), dtype=np.float32)
                held[owner[first:last] - low, place[first:last]] = 1.0
                total[low:high] += (held @ marks) / (sizes[low:high, None] * norms)
        return total / len(LENGTHS)


@dataclass
class Model:
    langs: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages

    def predict(self, batch: Presence) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its score in 0..1 for each text."""
        raw = self.landmarks.kernel(batch) @ self.weights
        best = raw.argmax(1)
        return best, np.clip((raw[np.arange(batch.texts), best] + 1) / 2, 0, 1).astype(np.float64)


def whitening(landmarks: Landmarks, batch: Presence) -> np.ndarray:
    """Landmark kernel to Nyström features: the inverse square root on the kernel's range."""
    among = landmarks.kernel(batch)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-8
    return vectors[:, keep] / np.sqrt(values[keep])


def _sample(df: DataFrame, text: str, lang: str, key: str) -> DataFrame | None:
    """(lang, at, t): a hash sample of labelled rows, as many for each language, as a written table.

    Texts of up to FIT_BYTES bytes are taken; a language that only has longer ones gives
    as many rows as it may have landmarks.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("string").alias("t"),
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 30)).alias("at"),
    )
    labelled = labelled.withColumn("short", F.octet_length("t") <= FIT_BYTES)
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("short")).collect()
    if not counts:
        return None
    limit = F.lit(-1)
    for row in sorted(counts, key=lambda r: r["lang"]):
        n, rows = (row["short"], FIT_ROWS) if row["short"] else (row["n"], LANDMARKS)
        share = int(min(1.0, max(1, rows // len(counts)) / n) * (1 << 30))
        of = (F.col("lang") == row["lang"]) & (F.col("short") == bool(row["short"]))
        limit = F.when(of, F.lit(share)).otherwise(limit)
    return materialize(labelled.where(F.col("at") < limit).select("lang", "at", "t").repartition(8, "at"), "language-sample")


def _grams(texts: list[str]) -> list[list[np.ndarray]]:
    """n-gram sets of texts, up to FIT_GRAMS a length: those with the least hashes."""
    found = presence(pa.array(texts, pa.string()))
    out = []
    for i in range(len(texts)):
        sets = [gram[owner == i] for owner, gram in zip(found.owner, found.gram, strict=True)]
        out.append([s if len(s) <= FIT_GRAMS else np.sort(s[np.argsort(s.astype(np.uint64) * _EVEN)[:FIT_GRAMS]]) for s in sets])
    return out


def train(sample: DataFrame) -> Model | None:
    """Fit on a table (lang, at, t); landmarks are the rows with the least hash of every language."""
    spark = sample.sparkSession
    usable = sample.where(F.col("t").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = max(1, LANDMARKS // len(langs))
    rank = F.struct("at", F.xxhash64("t"), "t")
    # at most LANDMARKS texts (or one a language) of bounded size
    chosen = usable.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(rank)), 1, each).alias("r")).collect()
    texts = [r["t"] for row in sorted(chosen, key=lambda c: c["lang"]) for r in row["r"]]
    landmarks = Landmarks(_grams(texts))
    whiten = whitening(landmarks, presence(pa.array(texts, pa.string())))
    sent = spark.sparkContext.broadcast((landmarks, whiten))
    width, names = whiten.shape[1], {name: i for i, name in enumerate(langs)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of the features' Gram matrix and of their products with the targets, summed over the partition."""
        fitted, whiten = sent.value
        total, any_row = np.zeros((width, width + len(names))), False
        for whole in batches:
            for batch in slices(whole, "t"):
                features = fitted.kernel(presence(batch.column("t"))) @ whiten
                target = np.full((batch.num_rows, len(names)), -1.0)
                target[np.arange(batch.num_rows), [names[x] for x in batch.column("lang").to_pylist()]] = 1.0
                total += features.T @ np.hstack([features, target])
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "x"])

    cells = usable.select("lang", "t").mapInArrow(sums, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    total = np.zeros(width * (width + len(langs)))
    for row in cells.collect():
        total[row["cell"]] = row["x"]
    total = total.reshape(width, width + len(langs))
    gram = total[:, :width] + RIDGE * sum(counts.values()) * np.eye(width)
    return Model(langs, landmarks, whiten @ np.linalg.solve(gram, total[:, width:]))


def identify(
    df: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> DataFrame:
    """One row per document: ``key``, held_out, lang_pred, score.

    The model is fitted on a hash sample of the rows that are not held out and have a
    label, about FIT_ROWS of them with equal shares for the languages and texts of up to
    FIT_BYTES (the documented bounds of the fit); every whole text is then scored, however
    long.  A text that is null or has no letter gets ``und`` with score 0, as does
    everything if no row is labelled.  A held out flag that is null counts as held out.
    Rows are judged on their own; null or repeated keys pass through; other columns are
    ignored whatever their names; empty in, empty out.
    """
    bounded_batches(df.sparkSession)
    flag = F.coalesce(held_out, F.lit(True))
    sample = _sample(df.where(~flag), text, lang, key)
    model = train(sample) if sample is not None else None
    if sample is not None:
        discard(sample)
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("k"), flag.alias("held_out"), F.col(text).cast("string").alias("t"))
    schema = T.StructType(
        [*rows.drop("t").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for whole in batches:
            for batch in slices(whole, "t"):
                names: list[str] = [UNKNOWN] * batch.num_rows
                scores = np.zeros(batch.num_rows)
                if fitted is not None:
                    found = presence(batch.column("t"))
                    best, worth = fitted.predict(found)
                    for i in np.flatnonzero(found.lettered).tolist():
                        names[i] = fitted.langs[best[i]]
                    scores = np.where(found.lettered, worth, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), batch.column("held_out"), pa.array(names), pa.array(scores)],
                    names=["k", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(score, schema).withColumnRenamed("k", key)
