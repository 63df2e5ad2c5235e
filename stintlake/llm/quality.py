"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature is an index with a value. Words are hashed into ``2**bits`` slots; structure
statistics (and the stored character count, as metadata) are cut into bins of fixed edges and
give one index each, so pairs of bins and words can interact. The pairwise term of a
document is taken in linear time from  sum_{i<j} <v_i,v_j> x_i x_j = ((sum v x)^2 - sum (v x)^2) / 2.

Fitting uses at most ``FIT_ROWS`` labelled documents (a bound on the driver's memory that does
not follow the corpus); features are made on the executors, stochastic AdaGrad runs on the bounded
sample. Scoring reads every whole text once and needs no shuffle.

Defined results: null or empty text scores like a document of zero length; a null or missing
metadata value has a bin of its own; without labelled rows the model returns exactly 0.5; rows that repeat an
id are scored each by its own text, and in the sample count as rows of their own, of which those with the smallest hashes
of text and id are taken (equal hashes are equal rows); an empty table has no scores; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, labelled_sample

FIT_ROWS = 8_000
BITS, RANK, EPOCHS, SEED = 16, 6, 3, 11
BINS = 12
# fixed values: lower edges of the bins of each statistic
EDGES = {
    "log_chars": [2, 3, 4, 4.5, 5, 6, 7, 8, 9, 10, 11],
    "log_words": [1, 2, 2.5, 3, 4, 5, 6, 7, 8, 9, 10],
    "chars_a_word": [2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15],
    "upper": [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95],
    "digits": [0.0005, 0.001, 0.003, 0.006, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6],
    "stops": [0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4],
    "symbols": [0.001, 0.003, 0.006, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.5],
    "spaces": [0.01, 0.05, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.25, 0.35, 0.5],
    "lines": [0.0005, 0.001, 0.002, 0.003, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3],
    "distinct": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99],
    "top_word": [0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.15, 0.25, 0.5, 0.9],
    "repeated_lines": [0.001, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 0.95],
}
_EDGES = np.array(list(EDGES.values()))
_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 sentence mark, 4 symbol, 5 space, 6 line end, 0 rest
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"-?", 3), (b"!#$%&()*+/<=>@[\\]^_`{|}~", 4), (b" \t\r", 5), (b"\n", 6)):
    _CLASS[list(_chars)] = _k
_HOT = np.eye(7)[_CLASS]


def size(bits: int = BITS) -> int:
    return (1 << bits) + BINS * (len(EDGES) + 1)


def features(text: str | None, n_chars: float | None, hashes: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature indices and their values."""
    text = text or ""
    words = text.lower().split()
    slots = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)) & ((1 << bits) - 1)
    index, count = np.unique(slots, return_counts=True)
    value = np.log1p(count)
    value /= np.sqrt((value * value).sum()) or 1.0
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _HOT / max(len(raw), 1)
    n, m, lines = len(text), len(words), text.split("\n")
    stats = np.array(
        [
            np.log1p(n), np.log1p(m), n / max(m, 1), shares[1], shares[2], shares[3], shares[4], shares[5], shares[6],
            len(index) / max(min(m, 1 << bits), 1), count.max() / m if m else 0.0, 1 - len(set(lines)) / len(lines),
        ]
    )
    bins = (_EDGES <= stats[:, None]).sum(1)
    known = n_chars is not None and n_chars == n_chars
    meta = min(BINS - 2, int(np.log1p(max(n_chars, 0)))) if known else BINS - 1
    at = (1 << bits) + BINS * np.arange(len(EDGES) + 1) + np.append(bins, meta)
    return np.concatenate([index, at]), np.concatenate([value, np.full(len(at), 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        total = vx.sum(0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], slots: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> FactorisationMachine:
    """AdaGrad on the logistic loss, one document at a time, in a seeded order."""
    rng = np.random.default_rng(SEED)
    share = np.clip(np.mean([y for *_, y in rows]), 1e-3, 1 - 1e-3) if rows else 0.5
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(slots), rng.normal(0, 0.02, (slots, rank)) * bool(rows))
    seen_w, seen_v = np.full(slots, 1e-2), np.full((slots, rank), 1e-2)
    for _ in range(epochs):
        for n in rng.permutation(len(rows)):
            index, x, y = rows[n]
            v = fm.factors[index]
            total = x @ v
            margin = fm.bias + fm.linear[index] @ x + 0.5 * (total @ total - ((v * x[:, None]) ** 2).sum())
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
            fm.bias -= 0.01 * err
            g = err * x + decay * fm.linear[index]
            seen_w[index] += g * g
            fm.linear[index] -= rate * g / np.sqrt(seen_w[index])
            g = err * x[:, None] * (total - v * x[:, None]) + decay * v
            seen_v[index] += g * g
            fm.factors[index] = v - rate * 0.5 * g / np.sqrt(seen_v[index])
    return fm


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", meta_col: str = "n_chars", fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Learn from at most ``fit_rows`` labelled rows outside the held-out quarter."""
    meta = F.col(meta_col).cast("double") if meta_col in docs.columns else F.lit(None).cast("double")
    sample, many = labelled_sample(docs, labels, label, fit_rows, {"text": F.col(text_col), "meta": meta})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = [features(t, c, hashes) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32())), batch.column(2), batch.column(3)],
                names=["i", "v", "y", "k"],
            )

    made = sample.mapInArrow(run, "i array<int>, v array<float>, y double, k bigint")
    # the rows of one id have no bound, those that reach the driver do
    got = (made.orderBy("k").limit(fit_rows) if many else made).toArrow()
    order = np.argsort(got["k"].to_numpy(), kind="stable")
    index, value, y = got["i"], got["v"], got["y"].to_pylist()
    # views of the table's numbers: as Python objects they would take several times the driver's memory
    rows = [(index[int(n)].values.to_numpy(), value[int(n)].values.to_numpy().astype(np.float64), y[n]) for n in order]
    return train(rows, size())


def quality_score(model: FactorisationMachine, text: Column, meta: Column) -> Column:
    """The score as a column, so that a filter needs no join."""
    bias, linear, factors = model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fm, hashes = FactorisationMachine(bias, linear, factors), WordHashes()
        for texts, counts in parts:
            yield pd.Series([fm.score(*features(t, c, hashes)) for t, c in zip(texts, counts, strict=True)], dtype="float64")

    return score(text, meta.cast("double"))


def with_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", meta_col: str = "n_chars", out: str = "score") -> DataFrame:
    meta = F.col(meta_col) if meta_col in docs.columns else F.lit(None)
    return docs.withColumn(out, quality_score(model, F.col(text_col), meta))
