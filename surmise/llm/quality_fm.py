"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is the logistic function of ``bias + w.x + (|V'x|^2 - sum_i |v_i|^2 x_i^2) / 2``: the
sum-of-squares identity gives all pairwise interactions in time linear in the features that are not zero.
Features: the words' hash buckets (square roots of their shares), statistics of characters, words and lines,
and the metadata column n_chars.  Labels, language, source and id are never features.

Training: stochastic gradient descent (AdaGrad) in numpy on the driver, on a bounded sample of labelled rows
(``TRAIN_ROWS``), whose features are computed by the executors from whole texts.

Defined results: null and empty texts have features of 0 and get the score of those; very long texts count
whole; repeated rows and equal or null ids are scored row by row; without a labelled row, or with one class
only, every score is the smoothed share of label 1 (0.5 without any); an empty table gives an empty result;
extra columns stay, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import passed_on, ship_code, sliced

BUCKETS, FACTORS = 4096, 8
TRAIN_ROWS, EPOCHS, BATCH, RATE, RIDGE = 6_000, 8, 32, 0.05, 1e-5
TABLE_ENTRIES = 100_000

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=+_\\/{}[]")] = True
STATS = ("words", "word_length", "upper", "digits", "symbols", "marks", "bars", "not_ascii", "lines", "distinct_lines", "distinct_words", "same_as_last", "n_chars", "no_n_chars")


@dataclass(frozen=True)
class FmModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def score(self, used: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        at = np.concatenate([used, np.arange(BUCKETS, BUCKETS + len(STATS))])
        x = np.concatenate([values, (stats - self.mean) / self.spread])
        v = self.factors[at] * x[:, None]
        z = self.bias + self.weights[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _buckets() -> _Buckets:
    return _Buckets()


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their values, statistics) of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words, size = raw.split(), max(1, len(raw))
    hashes = np.fromiter(map(_buckets().__getitem__, words), np.uint64, len(words))
    counts = np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines, n = [x for x in raw.split(b"\n") if x.strip()], max(1, len(words))
    letters = max(1, byte[_UPPER].sum() + byte[_LOWER].sum())
    stats = [np.log1p(len(words)), size / n, byte[_UPPER].sum() / letters, byte[_DIGIT].sum() / size, byte[_SYMBOL].sum() / n, byte[33] / n, byte[124] / n, byte[128:].sum() / size,
             np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(np.unique(hashes)) / n, float((hashes[1:] == hashes[:-1]).sum()) / n, np.log1p(max(0, n_chars or 0)), float(n_chars is None)]
    return used, np.sqrt(counts[used] / n), np.array(stats if raw else [0.0] * 12 + stats[12:])


def sample_features(docs: DataFrame, labels: DataFrame, text: str, n_chars: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, word values, statistics) of about TRAIN_ROWS labelled rows, drawn by a hash over all of them.

    The drawn labels are at most 2 * TRAIN_ROWS rows, so they may be broadcast to the documents.
    """
    total = labels.count()
    share = min(1.0, TRAIN_ROWS / max(1, total))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    drawn = labels.where(draw).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).limit(2 * TRAIN_ROWS)
    own = docs.select("doc_id", F.col(text).alias("text"), F.col(n_chars).cast("long").alias("n"))
    picked = own.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "n", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [features(t, c) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["y", "used", "v", "stats"])

    rows = picked.mapInArrow(run, "y int, used array<int>, v array<float>, stats array<double>").limit(4 * TRAIN_ROWS).collect()
    rows.sort(key=lambda r: (r["y"], r["stats"], r["used"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["used"]] = r["v"]
    return np.array([r["y"] for r in rows], float), x, np.array([r["stats"] for r in rows]).reshape(len(rows), len(STATS))


def fit(y: np.ndarray, words: np.ndarray, stats: np.ndarray, seed: int = 3) -> FmModel:
    size = BUCKETS + len(STATS)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return FmModel(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), np.zeros(len(STATS)), np.ones(len(STATS)))
    mean, spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    x = np.hstack([words, (stats - mean) / spread]).astype(np.float64)
    rng = np.random.default_rng(seed)
    bias, w, v = np.zeros(1), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    sums = [np.full_like(p, 1e-8) for p in (bias, w, v)]
    order = np.arange(len(y))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            xb, xv = x[part], x[part] @ v
            z = bias + xb @ w + 0.5 * ((xv**2).sum(axis=1) - (xb**2) @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            grads = (np.array([g.sum()]), xb.T @ g + RIDGE * w, xb.T @ (g[:, None] * xv) - v * ((xb**2).T @ g)[:, None] + RIDGE * v)
            for value, grad, total in zip((bias, w, v), grads, sums, strict=True):
                total += grad**2
                value -= RATE * grad / np.sqrt(total)
    return FmModel(float(bias[0]), w, v, mean, spread)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text: str = "text", n_chars: str = "n_chars") -> FmModel:
    """A model of the labels of rows where ``usable`` (a condition on doc_id) holds."""
    ship_code(docs.sparkSession)
    return fit(*sample_features(docs, labels.where(usable & F.col(label).isNotNull()), text, n_chars, label))


def score(docs: DataFrame, model: FmModel, text: str = "text", n_chars: str = "n_chars", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score, the probability of label 1."""
    ship_code(docs.sparkSession)
    kept, kinds = passed_on(docs, keep, ("score",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [model.score(*features(t, c)) for t, c in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.float64())], names=[*b.schema.names[:-2], "score"])

    return docs.select(*(docs[f"`{c}`"] for c in kept.columns), F.col(text).cast("string").alias("__text"), F.col(n_chars).cast("long").alias("__n")).mapInArrow(run, f"{kinds}, score double")
