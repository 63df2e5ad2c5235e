"""Toxicity: FTRL-proximal logistic regression over hashed words and stems, bigrams and
skip-bigrams.

Each coordinate has its own learning rate; the L1 term keeps coordinates at exactly zero until
their evidence outweighs it, so the model that goes to the executors is the short list of
non-zero weights. Scoring reads every whole text once and needs no shuffle.

Fitting uses at most ``FIT_ROWS`` labelled documents, a documented bound.

Defined results: null or empty text scores by the bias alone; without labelled rows the score
is 0.5 for every document; rows that repeat an id are scored each by its own text, and in the sample count as rows
of their own, of which those with the smallest hashes of text and id are taken (equal hashes are equal rows); an empty
table has no scores; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, labelled_sample

FIT_ROWS = 8_000
BITS, EPOCHS, SEED = 20, 6, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
STEM = 4
_EDGE = re.compile(r"[.,;:!?\"'()\[\]]")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_D = np.uint64(0x27D4EB2F165667C5)


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct slots of the words, their stems (first letters), the pairs of neighbours, and
    the pairs that skip one word."""
    words = _EDGE.sub(" ", (text or "").lower()).split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    stems = np.fromiter([hashes[w[:STEM]] for w in words], np.uint64, len(words))
    shift = np.uint64(64 - bits)
    grams = [h * _A, stems * _D, (h[:-1] * _A + h[1:]) * _B, (h[:-2] * _A + h[2:]) * _C]
    return np.unique(np.concatenate(grams) >> shift).astype(np.int64)


@dataclass
class SparseWeights:
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    def dense(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.slots] = self.weights
        return out


def train(rows: list[tuple[np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> SparseWeights:
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(SEED)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias():
        return -zb / ((BETA + np.sqrt(nb)) / ALPHA)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, y = rows[k]
            w, b = weight(z[index], n[index]), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - step * w
            n[index] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return SparseWeights(float(bias()), kept.astype(np.int32), w[kept].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text_col: str = "text", fit_rows: int = FIT_ROWS) -> SparseWeights:
    """Learn from at most ``fit_rows`` labelled rows outside the held-out quarter."""
    sample, many = labelled_sample(docs, labels, label, fit_rows, {"text": F.col(text_col)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = [features(t, hashes).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["i", "y", "k"])

    made = sample.mapInArrow(run, "i array<int>, y double, k bigint")
    # the rows of one id have no bound, those that reach the driver do
    got = (made.orderBy("k").limit(fit_rows) if many else made).toArrow()
    order = np.argsort(got["k"].to_numpy(), kind="stable")
    index, y = got["i"].combine_chunks(), got["y"].to_pylist()
    return train([(index[int(k)].values.to_numpy().astype(np.int64), y[k]) for k in order])


def toxicity_score(model: SparseWeights, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense, hashes = model.dense(), WordHashes()
        for texts in parts:
            margin = np.array([dense[features(t, hashes)].sum() for t in texts], dtype=np.float64) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    return score(text)
