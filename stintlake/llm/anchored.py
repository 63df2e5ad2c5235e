"""Anchors: a sparse, content-chosen set of positions by which equal windows find each other.

A window of ``length`` symbols (bytes or words) holds ``length - gram + 1`` grams; the gram with
the smallest hash, leftmost on ties, is the window's anchor. Equal windows have equal anchors at
equal offsets, so windows need comparing only within one anchor hash. Runs of window starts with
the same anchor are one row: hash, 128-bit digest of the context (the bytes of all its windows),
first and last start. There are about ``2 / (length - gram + 2)`` rows a symbol instead of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = 24
#: Longer documents are read in overlapping parts of this many symbols.
PART = 1 << 22
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Polynomial hashes modulo 2**64 of every stretch of a symbol array."""

    up, down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        while len(Roller.up) <= n:
            Roller.up, Roller.down = (np.concatenate([p, p * (p[-1:] * p[1])]) for p in (Roller.up, Roller.down))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * Roller.up[:n], out=self.total[1:])

    def stretch(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of symbols[start:start+size], wherever it stands."""
        return mixed((self.total[start + size] - self.total[start]) * Roller.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mixed((self.total[size:] - self.total[:n]) * Roller.down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks."""
    n = len(keys)
    whole = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = keys
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(symbols: np.ndarray, data: bytes, offsets: np.ndarray | None, length: int, gram: int, reach: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, two halves of the context digest, first start, last start) of each run of windows.

    The context runs from the first start to ``reach`` symbols after the last one, or to the end of
    the text. ``offsets`` tells where symbols start in ``data``, with one byte between symbols;
    without it symbols are bytes."""
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return (none,) * 5
    view, parts = memoryview(data), []
    for at in range(0, len(symbols) - length + 1, PART):
        part = symbols[at : at + PART + length - 1]
        grams = Roller(part).every(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(grams >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | place, length - gram + 1)
        where = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.append(first[1:], len(where)) - 1
        start, stop = first + at, np.minimum(last + at + reach, len(symbols))
        low, high = (start, stop) if offsets is None else (offsets[start], offsets[stop] - 1)
        digest = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(low.tolist(), high.tolist(), strict=True)])
        context = np.frombuffer(digest, np.int64).reshape(-1, 2)
        parts.append((grams[where[first]].view(np.int64), context[:, 0] + where[first] - first, context[:, 1], start, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def kind_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text): ``k``, a hash of the text, tells rows apart that share an id or have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


def with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Join on (id, k), where a null id equals a null id."""
    other = places.withColumnsRenamed({"id": "_id", "k": "_k"})
    return texts.join(other, (texts["k"] == other["_k"]) & texts["id"].eqNullSafe(other["_id"]), how).drop("_id", "_k")


def first_of_equal(f: np.ndarray, c1: np.ndarray, c2: np.ndarray, owner: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each row, how many rows share its anchor and context, at the earliest of them; 0 at the others."""
    copies = np.zeros(len(f), np.int64)
    if len(f):
        order = np.lexsort((lo, owner, c2, c1, f))
        key = np.stack([f, c1, c2])[:, order]
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        copies[order[new]] = np.diff(np.append(new, len(f)))
    return copies


def _ranks(ids: list, keys: list) -> np.ndarray:
    """The rank of each (id, k), null ids first, as Spark orders them."""
    pairs = [(i is not None, 0 if i is None else i, k) for i, k in zip(ids, keys, strict=True)]
    rank = {p: n for n, p in enumerate(sorted(set(pairs)))}
    return np.array([rank[p] for p in pairs], np.int64)


def anchor_rows(texts: DataFrame, reader: Callable[[], Callable[[str | None], tuple]], length: int, gram: int, reach: int, once: bool = False) -> DataFrame:
    """Rows (f, c1, c2, id, k, lo, hi, copies) of all texts (id, k, text). ``reader()`` makes, once a
    worker, the function from a text to its symbols, bytes and offsets.

    Equal contexts are combined before any shuffle: of those met together in a task the earliest
    carries their number, and the others, with 0, take a hash of their own place for ``f``, so a
    line that fills a third of the corpus does not meet in one task. With ``once``, a place (id, k, lo)
    that is met again in a task, in a row that repeats the document, is no copy and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                made = [anchor_runs(*symbols(t.as_py()), length, gram, reach) for t in piece.column(2)]
                rank = _ranks(piece.column(0).to_pylist(), piece.column(1).to_pylist())
                owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
                f, c1, c2, lo, hi = (np.concatenate(x) for x in zip(*made, strict=True))
                if once and len(np.unique(rank)) < len(made):
                    seen = np.sort(np.unique(rank, return_index=True)[1])
                    stay = np.isin(owner, seen)
                    f, c1, c2, lo, hi, owner = (x[stay] for x in (f, c1, c2, lo, hi, owner))
                copies = first_of_equal(f, c1, c2, rank[owner], lo)
                spread = mixed((f ^ rank[owner] * 1_000_003 + lo * 8_191).astype(np.uint64)).view(np.int64)
                f, at_ = np.where(copies > 0, f, spread), pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c1), pa.array(c2), piece.column(0).take(at_), piece.column(1).take(at_), pa.array(lo), pa.array(hi), pa.array(copies)], names=["f", "c1", "c2", "id", "k", "lo", "hi", "copies"])

    return texts.select("id", "k", "text").mapInArrow(run, f"f bigint, c1 bigint, c2 bigint, id {kind_of(texts, 'id')}, k bigint, lo bigint, hi bigint, copies bigint")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
