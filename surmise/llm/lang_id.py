"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's letters, lower-cased, are cut into subwords of two and three characters (a word's ends count as
characters); each hashes to an embedding, the mean of a text's embeddings goes through a linear softmax.
Embeddings and softmax are trained together by stochastic gradient descent in numpy on the driver, on a
bounded sample of labelled rows (``TRAIN_ROWS``); executors turn the sampled texts, whole, into bucket
counts, so the driver never holds a text.

A fifth of the sample calibrates: a temperature is fitted to it, and the rejection threshold is the score
that all but ``REJECT_SHARE`` of its rightly named texts exceed, but never more than ``MAX_THRESHOLD`` (which
decides where the languages are easily told apart).  Texts in none of the languages can score high; they are
known by the share of their subwords that training hasn't seen (the first ``SPARE`` of a text are free).  The
limit is the share that all but ``REJECT_SHARE`` of the rightly named texts keep to; beyond it the score is
lowered below the threshold.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and rejected; very long
texts count whole; repeated rows and equal or null ids are judged row by row; without any labelled row
nothing is learned and every text is ``und``; an empty table gives an empty result; extra columns stay, and
those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import passed_on, ship_code, sliced

BUCKETS, WIDTH = 4096, 16
TRAIN_ROWS, EPOCHS, BATCH, RATE = 3_000, 12, 32, 0.3
REJECT_SHARE, MAX_THRESHOLD, SPARE = 0.001, 0.5, 5
UNKNOWN = "und"
CHUNK = 1 << 20


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray
    limit: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = ((counts / counts.sum()) @ self.embeddings @ self.weights + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        p, strange = e / e.sum(), max(0, counts[~self.seen].sum() - SPARE) / counts.sum()
        return p * (self.threshold * self.limit / strange) if strange > self.limit else p


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def bucket_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in the whole text; None without a letter."""
    if not text:
        return None
    counts, any_letter = np.zeros(BUCKETS, np.int64), False
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        # neighbouring chunks share two characters, so that no subword is lost between them
        code = np.frombuffer(f" {text[at : at + CHUNK + 2]} ".encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[code]
        any_letter |= bool(letter.any())
        code = np.where(letter, code, np.uint32(0))
        pair = code[:-1] * np.uint32(2654435761) + code[1:]
        counts += np.bincount(((pair * np.uint32(2246822519)) >> np.uint32(20))[letter[:-1] | letter[1:]], minlength=BUCKETS)
        triple = (pair[:-1] ^ (pair[:-1] >> np.uint32(15))) * np.uint32(2654435761) + code[2:]
        counts += np.bincount(((triple * np.uint32(3266489917)) >> np.uint32(20))[letter[1:-1]], minlength=BUCKETS)
    return counts if any_letter else None


def sample_features(labelled: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """(languages, bucket counts) of about TRAIN_ROWS rows drawn over all labelled rows by a hash."""
    total = labelled.count()
    share = min(1.0, TRAIN_ROWS / max(1, total))
    draw = F.pmod(F.xxhash64("doc_id", text), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    picked = labelled.where(draw).select(text, lang).limit(2 * TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [(x, c) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (c := bucket_counts(t)) is not None]
            used = [np.flatnonzero(c) for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array(used, pa.list_(pa.int32())), pa.array([c[u] for (_, c), u in zip(found, used, strict=True)], pa.list_(pa.int32()))], names=["lang", "used", "n"])

    rows = picked.mapInArrow(run, "lang string, used array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["lang"], r["used"], r["n"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["used"]] = r["n"]
    return [r["lang"] for r in rows], x / np.maximum(1, x.sum(axis=1, keepdims=True))


def fit(langs: list[str], x: np.ndarray, seed: int = 5) -> LangModel | None:
    """``x``: one row of mean bucket shares a text."""
    if not langs:
        return None
    names = tuple(sorted(set(langs)))
    y, rng = np.array([names.index(v) for v in langs]), np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    train, check = order[:cut], order[cut:]
    e, w, b = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), rng.normal(0, 1 / WIDTH, (WIDTH, len(names))), np.zeros(len(names))
    sums = [np.full_like(p, 1e-8) for p in (e, w, b)]
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            part = train[at : at + BATCH]
            hidden = x[part] @ e
            logits = hidden @ w + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            for value, grad, total in zip((e, w, b), (x[part].T @ (p @ w.T), hidden.T @ p, p.sum(axis=0)), sums, strict=True):
                total += grad**2
                value -= RATE * grad / np.sqrt(total)
    temperature, threshold, limit = 1.0, 0.0, 1.0
    seen = (x[train] > 0).any(axis=0)
    if len(check):
        logits, truth = x[check] @ e @ w + b, y[check]

        def probabilities(t: float) -> np.ndarray:
            q = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
            return q / q.sum(axis=1, keepdims=True)

        loss = {t: -np.log(np.maximum(1e-12, probabilities(t)[np.arange(len(truth)), truth])).mean() for t in np.geomspace(0.25, 8, 21)}
        temperature = float(min(loss, key=loss.get))
        q = probabilities(temperature)
        named = q.argmax(axis=1) == truth
        if named.any():
            threshold = min(MAX_THRESHOLD, float(np.quantile(q.max(axis=1)[named], REJECT_SHARE)))
            limit = float(np.quantile(x[check][named][:, ~seen].sum(axis=1), 1 - REJECT_SHARE, method="higher"))
    return LangModel(names, e, w, b, temperature, threshold, seen, limit)


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> LangModel | None:
    """A model of the rows where ``usable`` holds and the language is known."""
    ship_code(docs.sparkSession)
    return fit(*sample_features(docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang))


def predict(docs: DataFrame, model: LangModel | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and rejected."""
    ship_code(docs.sparkSession)
    kept, kinds = passed_on(docs, keep, ("lang_pred", "score", "rejected"))

    def judged(t: str | None) -> tuple[str, float, bool]:
        counts = bucket_counts(t) if model else None
        if counts is None:
            return UNKNOWN, 0.0, True
        p = model.probabilities(counts)
        best = int(p.argmax())
        return model.langs[best], float(p[best]), bool(p[best] < model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = list(map(judged, b.column(b.num_columns - 1).to_pylist()))
            pred, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return docs.select(*(docs[f"`{c}`"] for c in kept.columns), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
