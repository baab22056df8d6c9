"""Toxic passages by maximum-scoring segment search.

Each token carries the log-odds of toxic against clean text under informative
Dirichlet priors.  All maximal scoring segments of a text are found in linear
time.  The extreme-value law of segment scores standardises each, and the law of
sums of the r best, taken at the r where chance explains them least, joins them
to one evidence, which is calibrated to 0..1.

A token's evidence is its word or one of the word's leading letter groups,
whichever stands out most: word families are marked by their stem.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, partitions
from .labelled import fold, training_rows

FOLDS, HELD_OUT = 3, 1
#: Score at and above which a document is predicted toxic.
CUT = 0.7
TRAINING_ROWS = 40_000
#: Standardised evidence beyond which more is no surer: chance gives it in exp(-12) of clean texts.
SATURATED = 24.0
#: Leading letters that stand for a family of words.
STEMS = range(4, 9)
#: Weight of the prior, in pseudo-tokens: spread by overall frequency, and the same for every unit.
PRIOR = 1000.0
EVEN = 0.5
#: Units that chance alone may let pass as toxic, in all.
BY_CHANCE = 0.05
#: Log-odds (less their error) that a unit shows at least; weaker ones add up to noise in long and repeating texts.
EVIDENCE = 3.0
#: A passage is significant if chance gives it less often than this in a text.
CHANCE = 0.01
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial token counts and document counts of each unit by label."""
    for batch in batches:
        tokens: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        totals, texts = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            if label not in tokens:
                continue
            found = Counter(_WORD.findall(text.lower()))
            totals[label] += sum(found.values())
            texts[label] += 1
            seen: Counter = Counter()
            for w, n in found.items():
                for u in units(w):
                    seen[u] += n
            tokens[label].update(seen)
            docs[label].update(dict.fromkeys(seen, 1))
        names, y, n, d = [], [], [], []
        for label in (0, 1):
            names += ["", *tokens[label]]
            y += [label] * (1 + len(tokens[label]))
            n += [totals[label], *tokens[label].values()]
            d += [texts[label], *docs[label].values()]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["unit", "label", "n", "d"])


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each unit under the informative Dirichlet prior, and their standard errors."""
    prior = EVEN + PRIOR * (toxic + clean) / max(1.0, n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / np.maximum(n_toxic + PRIOR - a, 1e-9)) - np.log(b / np.maximum(n_clean + PRIOR - b, 1e-9))
    return odds, np.sqrt(1 / a + 1 / b)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in linear time.

    Ruzzo and Tompa's scan: candidates stand on a stack with the sums before
    and after them; a new one joins back to the last candidate that starts lower
    while that one ends lower too.
    """
    out: list[list] = []  # start, end, sum before, sum after, index of the last candidate with a lower start
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([start, i + 1, left, right, j])
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r, _ in out]


def karlin(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chance * exp(root * value)) = 1, for a law with negative mean."""
    if not (values > 0).any() or (values * chances).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (chances * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        if (chances * np.exp(mid * values)).sum() < 1:
            low = mid
        else:
            high = mid
    return high


def joint_evidence(lone: np.ndarray, log_length: float) -> float:
    """Minus the log of the chance of a text's segments, within +-SATURATED.

    ``lone`` has each segment's standardised score, minus the log of the chance
    of one as good.  The sum t of the r best is exceeded by chance with about
    exp(-t) t**(r-1) / (r! (r-1)!); having chosen r costs a factor of two for
    each segment beyond the first.  Segments below zero add nothing.
    """
    if not len(lone):
        return max(-SATURATED, -log_length)
    best = float(lone.max())
    good = np.sort(lone[lone > 0])[::-1]
    if len(good) > 1:
        r = np.arange(1, len(good) + 1)
        t = np.cumsum(good)
        factorials = np.concatenate([[0.0], np.cumsum(np.log(r))])  # ln r!
        joint = t - (r - 1) * np.log(t) + factorials[1:] + factorials[:-1] - (r - 1) * math.log(2)
        joint = joint[t >= r]  # the law of sums holds in its tail
        best = max(best, float(joint.max(initial=best)))
    return max(-SATURATED, min(SATURATED, best))


@dataclass(frozen=True)
class Detector:
    """Evidence of units, the drift of a token without any, and the calibration."""

    evidence: dict[str, float]
    drift: float
    root: float
    slope: float
    shift: float

    def token_scores(self, text: str | None, known: dict[str, float]) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        get, out = known.get, []
        for w in words:
            s = get(w)
            if s is None:
                found = [self.evidence[u] for u in units(w) if u in self.evidence]
                s = (max(found, key=abs) if found else 0.0) - self.drift
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = s
            out.append(s)
        return np.array(out, dtype=float)

    def weigh(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's evidence, and its significant segments (first word, end word, score)."""
        found = segments(scores)
        lone = self.root * np.array([x[2] for x in found]) - math.log1p(len(scores))
        return joint_evidence(lone, math.log1p(len(scores))), [x for x, e in zip(found, lone.tolist(), strict=True) if e >= -math.log(CHANCE)]

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Segments (first word, end word, score) that chance gives less often than CHANCE in a text."""
        return self.weigh(self.token_scores(text, {}))[1]

    def score(self, standard: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * standard + self.shift, -30, 30)))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with a weak ridge on the slope."""
    m, s = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - m) / s, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(x) + np.array([1e-4, 0]) * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(x) + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / s), float(w[1] - w[0] * m / s)


def train(docs: DataFrame, labels: DataFrame) -> Detector:
    """Fits on at most TRAINING_ROWS labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, TRAINING_ROWS).select("text", "label")
    sample = Stored(rows.repartition(partitions(docs.sparkSession)), "toxic-sample")
    counts = sample.df.mapInArrow(_unit_counts, "unit string, label int, n long, d long")
    both = counts.groupBy("unit").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("label") == 1, F.col("d")).otherwise(0)).alias("td"),
        F.sum(F.when(F.col("label") == 0, F.col("d")).otherwise(0)).alias("cd"),
    )
    both = Stored(both, "toxic-units").df
    total = both.filter("unit = ''").first()
    if total is None or not total["t"] or not total["c"]:
        return Detector({}, 1.0, 1.0, 1.0, -5.0)
    n_t, n_c = float(total["t"]), float(total["c"])
    share = total["td"] / (total["td"] + total["cd"])
    m = F.col("td") + F.col("cd")
    ratio = 2 * (F.col("td") * F.log(F.col("td") / (m * share)) + F.when(F.col("cd") > 0, F.col("cd") * F.log(F.col("cd") / (m * (1 - share)))).otherwise(0.0))
    known = both.filter("unit <> ''").filter(m >= 3)
    # a log-likelihood ratio of documents that chance, over all units tried, hardly reaches
    least = 2 * math.log(max(1, known.count()) / BY_CHANCE)
    found = known.filter(F.col("td") > m * share).withColumn("ratio", ratio).filter(F.col("ratio") >= least)
    table = found.select("unit", "t", "c").toArrow()  # bounded by the sample, as a unit needs three of its documents
    table = table.sort_by("unit")
    names = table.column("unit").to_pylist()
    t, c = (table.column(k).to_numpy().astype(float) for k in ("t", "c"))
    odds, error = log_odds(t, c, n_t, n_c)
    evidence = {u: float(o - e) for u, o, e in zip(names, odds, error, strict=True) if o - e >= EVIDENCE}
    # tokens without evidence cost a little, so that a segment must earn its length
    drift = 0.05
    plain = Detector(evidence, drift, 1.0, 1.0, 0.0)
    root = _root(sample.df, plain)
    rough = Detector(evidence, drift, root, 1.0, 0.0)
    x = sample.df.mapInArrow(_standards(rough, "label"), "label int, x double").toArrow()
    xs, ys = x.column("x").to_numpy(), x.column("label").to_numpy().astype(float)
    order = np.lexsort((ys, xs))
    slope, shift = _platt(xs[order], ys[order])
    return Detector(evidence, drift, root, slope, shift)


def _root(sample: DataFrame, detector: Detector) -> float:
    """The law of token scores in clean text, as a histogram, and its root."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(np.round(detector.token_scores(text, known), 2).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    # scores are rounded to hundredths, so the table is short
    law = sample.filter("label = 0").mapInArrow(rows, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toArrow()
    s, n = law.column("s").to_numpy(), law.column("n").to_numpy().astype(float)
    return karlin(s, n / n.sum())


def _standards(detector: Detector, key: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            x = [detector.weigh(detector.token_scores(t, known))[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(x, pa.float64())], [key, "x"])

    return rows


_PASSAGES = "array<struct<first: int, end: int, score: double>>"


def _scores(detector: Detector):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            found = [detector.weigh(detector.token_scores(t, known)) for t in batch.column("text").to_pylist()]
            passages = [[dict(zip(("first", "end", "score"), p, strict=True)) for p in ps] for _, ps in found]
            score_ = detector.score(np.array([x for x, _ in found], dtype=float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return rows


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages (first word, end word, score) of every row.

    Null text counts as empty; a very long one is scanned in linear time; rows
    keep their count whatever their ids; an empty table gives no rows; lang,
    source, labels, ids and other columns, whatever their names, are never looked at.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(_scores(detector), f"doc_id {kind}, score double, passages {_PASSAGES}")
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"), "passages",
    )
