"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a document of label 1 over one of label 0) give logistic loss
on differences of features; the fitted weights score single documents.  Features
are shares of a text's words and of its byte trigrams, each hashed to buckets
whose weights are learnt from the pairs alone, and measures of its form.  The cut
is a quantile of the training scores, and scores are mapped to 0..1 so that the
cut lies at CUT.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import partitions, text_key
from .labelled import fold, training_rows

FOLDS, HELD_OUT = 5, 0
#: Score at and above which a document is kept.
CUT = 0.3
#: Rows that the classifier is fitted on, and pairs drawn from them, at most.
TRAINING_ROWS = 20_000
PAIRS = 200_000
#: Training rows whose shares are multiplied out at once.
ROWS_AT_ONCE = 1000
#: Bytes whose trigrams are counted at once.
PIECE = 1 << 20
#: Buckets of words and of trigrams, and what their shares are multiplied by beside the measures.
WORD_BUCKETS, GRAM_BUCKETS = 4096, 512
SHARES = 2.0
#: Measures of form.
NAMES = (
    "symbols", "bars", "shouts", "digits", "word_length", "distinct", "top_word", "follows_itself",
    "repeated_sentences", "repeated_lines", "plain_words", "log_words", "squeezed", "marked_words",
)


def features(text: str | None) -> list[float]:
    """What the model sees of a text; an empty one has zeros throughout."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), len(text)
    bare = [w.strip(".,;:!?") for w in words]
    letters = sum(map(str.isalpha, bare))
    upper = sum(1 for w in bare if len(w) > 1 and w.isupper())
    counts = Counter(w.lower() for w in bare)
    same = sum(1 for a, b in zip(bare, bare[1:], strict=False) if a == b)
    sentences = [s for s in text.replace("\n", ". ").split(". ") if s]
    lines = [x for x in text.split("\n") if x]
    raw = text.encode("utf-8", "replace")
    marks = sum(text.count(c) for c in "#$%&*@^~<>{}[]|\\=_+")
    return [
        math.sqrt(marks / chars),
        math.sqrt(sum(1 for w in words if w == "|") / n),
        upper / n,
        math.sqrt(sum(1 for w in bare if w.isdigit()) / n),
        min(20.0, sum(map(len, bare)) / n) / 10,
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        1 - len(set(sentences)) / max(1, len(sentences)),
        1 - len(set(lines)) / max(1, len(lines)),
        letters / n,
        math.log1p(n) / 10,
        len(zlib.compress(raw, 1)) / (len(raw) + 40),
        math.sqrt(sum(1 for w in words if w.endswith("!!")) / n),
    ]


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of the text's words and byte trigrams, trigrams after words."""
    raw = (text or "").lower().encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.float16)
    found = Counter(words)
    at = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % WORD_BUCKETS
    by_word = np.bincount(at, weights=np.fromiter(found.values(), float, len(found)), minlength=WORD_BUCKETS) / len(words)
    b = np.frombuffer(raw, np.uint8)
    by_gram = np.zeros(GRAM_BUCKETS)
    for k in range(0, len(b) - 2, PIECE):  # a very long text goes piece by piece
        x = b[k : k + PIECE + 2].astype(np.uint32)
        mixed = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
        by_gram += np.bincount(mixed >> np.uint32(23), minlength=GRAM_BUCKETS)
    both = np.sqrt(np.concatenate([by_word, by_gram / max(1, len(b) - 2)]))
    used = np.flatnonzero(both)
    return used.astype(np.uint16), both[used].astype(np.float16)


@dataclass(frozen=True)
class Ranker:
    """weights over standardised measures and over shares; score = sigmoid(slope * (strength - cut) + logit(CUT))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    learnt: np.ndarray
    cut: float
    slope: float

    def strength(self, measures: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        """From rows of measures, and what the shares of each row add up to."""
        return np.clip((measures - self.mean) / self.scale, -8, 8) @ self.weights + learnt

    def of_shares(self, text: str | None) -> float:
        buckets, values = shares(text)
        return float(self.learnt[buckets] @ values.astype(float))

    def score(self, texts: list[str | None]) -> np.ndarray:
        measures = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(NAMES))
        learnt = np.array([self.of_shares(t) for t in texts], dtype=float)
        t = self.slope * (self.strength(measures, learnt) - self.cut) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


@dataclass(frozen=True)
class Rows:
    """Training rows: measures as a dense table, shares as flat lists with their bounds.

    Shares stay as small as they came, four bytes each, and are multiplied out
    some rows at a time, as they are what takes the driver's memory.
    """

    measures: np.ndarray
    bounds: np.ndarray
    buckets: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.measures)

    def _pieces(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their bounds from 0, buckets, values), some rows at a time."""
        for at in range(0, len(self), ROWS_AT_ONCE):
            own = slice(at, min(len(self), at + ROWS_AT_ONCE))
            bounds = self.bounds[own.start : own.stop + 1]
            flat = slice(bounds[0], bounds[-1])
            yield own, bounds - bounds[0], self.buckets[flat], self.values[flat].astype(float) * SHARES

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = self.measures.shape[1]
        out = self.measures @ w[:k]
        for own, bounds, buckets, values in self._pieces():
            sums = np.add.reduceat(np.append(w[k:][buckets] * values, 0.0), bounds[:-1])
            out[own] += np.where(bounds[1:] > bounds[:-1], sums, 0.0)
        return out

    def weighted(self, g: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows, each times its number."""
        total = np.zeros(width)
        for own, bounds, buckets, values in self._pieces():
            total += np.bincount(buckets, weights=np.repeat(g[own], np.diff(bounds)) * values, minlength=width)
        return np.concatenate([g @ self.measures, total])


def fit_pairs(rows: Rows, better: np.ndarray, worse: np.ndarray, width: int = WORD_BUCKETS + GRAM_BUCKETS, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Bradley-Terry weights: mean logistic loss of score differences plus a ridge, by limited-memory quasi-Newton steps."""
    n = len(rows)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = rows.dot(w)
        apart = s[better] - s[worse]
        p = 1 / (1 + np.exp(np.clip(apart, -30, 30)))
        g = (np.bincount(worse, weights=p, minlength=n) - np.bincount(better, weights=p, minlength=n)) / len(better)
        return float(np.logaddexp(0, -apart).mean() + ridge / 2 * w @ w), rows.weighted(g, width) + ridge * w

    w = np.zeros(rows.measures.shape[1] + width)
    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, taken = -gradient, []
        for moved, changed in reversed(past):
            share = moved @ step / (moved @ changed)
            step = step - share * changed
            taken.append(share)
        if past:
            step = step * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (moved, changed), share in zip(past, reversed(taken), strict=True):
            step = step + moved * (share - changed @ step / (moved @ changed))
        size, slope = 1.0, gradient @ step
        while True:
            there, new = loss(w + size * step)
            if there <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        moved, changed = size * step, new - gradient
        w, value, gradient = w + moved, there, new
        if moved @ changed > 1e-12:
            past = [*past[-8:], (moved, changed)]
        if np.abs(gradient).max() < 1e-5:
            break
    return w


def fit(rows: Rows, labels: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """A ranker from training rows and 0/1 labels; neutral (every score above CUT) where a class is missing."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    k, width = len(NAMES), WORD_BUCKETS + GRAM_BUCKETS
    if not len(good) or not len(bad):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), np.zeros(width), -1.0, 1.0)
    mean, scale = rows.measures.mean(axis=0), rows.measures.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    standard = Rows(np.clip((rows.measures - mean) / scale, -8, 8), rows.bounds, rows.buckets, rows.values)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    w = fit_pairs(standard, rng.choice(good, n), rng.choice(bad, n))
    strength = standard.dot(w)
    # the quantile of all training scores that parts the classes best, classes weighed alike
    order = np.argsort(strength, kind="stable")
    worse = np.cumsum(labels[order] == 0) / len(bad)
    lost = np.cumsum(labels[order] == 1) / len(good)
    gain = worse - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = int(best[len(best) // 2])
    cut = float(strength[order[at : at + 2]].mean())
    spread = float(np.median(np.abs(strength - cut))) or 1.0
    return Ranker(mean, scale, w[:k], w[k:] * SHARES, cut, 3.0 / spread)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [shares(t) for t in texts]
        measures = [np.array(features(t)).tobytes() for t in texts]
        packed = [pa.array(x, pa.binary()) for x in (measures, *([f[i].tobytes() for f in found] for i in (0, 1)))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("k1"), batch.column("k2"), *packed], ["label", "k1", "k2", "measures", "buckets", "shares"])


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a binary array, one row after the other."""
    _, ends, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, kind)
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fits on at most TRAINING_ROWS labelled rows outside the held-out fold, some 2 kB each."""
    sample = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, TRAINING_ROWS).select("text", "label", *text_key())
    sample = sample.repartition(partitions(docs.sparkSession))
    table = sample.mapInArrow(_training, "label int, k1 long, k2 long, measures binary, buckets binary, shares binary").toArrow().combine_chunks()
    # rows arrive in any order: sort them, so that equal inputs give equal models
    y, k1, k2 = (table.column(c).to_numpy() for c in ("label", "k1", "k2"))
    order = np.lexsort((y, k2, k1))
    columns = [table.column(c).combine_chunks().take(pa.array(order)) for c in ("measures", "buckets", "shares")]
    del table
    sizes = [len(x) // 2 for x in columns[1].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    measures, buckets, values = (_bytes(c, kind) for c, kind in zip(columns, (np.float64, np.uint16, np.float16), strict=True))
    return fit(Rows(measures.reshape(-1, len(NAMES)), bounds, buckets, values), y[order])


def _scores(ranker: Ranker):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ranker.score(batch.column("text").to_pylist()))], [*keep, "score"])

    return rows


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null text counts as empty; very long texts are read whole; rows keep their
    count whatever their ids; an empty table gives no rows; lang, source, labels,
    ids and other columns, whatever their names, are never looked at.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(_scores(ranker), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score at least CUT.

    Null text scores as empty and stays null; very long texts are scored whole;
    repeated rows and ids stay or go each by its text; an empty table gives no
    rows; other columns stay as they are, whatever their names.  Without labels
    of both classes nothing is rejected.
    """
    ranker = train(docs, labels)

    @pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(texts.to_list()))

    return docs.withColumn("__score", of(F.col("text").cast("string"))).filter(F.col("__score") >= CUT).select(*docs.columns)
