"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by ``budget(m)`` edits. It is cut into one
more piece than that, so any passage within the budget holds at least one piece unchanged.
One automaton finds all piece hits of all items in a single pass over a text; around the hits,
Myers' bit-parallel distance verifies the item. Texts and items are compared in lower case
with each run of white space as one space.

Items travel to the executors in slices of at most about ``SLICE_CHARS`` characters, however
large the benchmark is; each slice is one pass over the documents, whose result is written
before the next slice is fetched, so that the driver holds one slice at a time.

Defined results: null, empty or blank items and texts match nothing; items that repeat are
reported under each id; an item shorter than ``SHORT_CHARS`` has no edits and must stand between
characters that are no letters or digits, since inside words it would be found by chance; rows
that repeat a doc_id or have none are searched each for itself; extra columns are ignored by
``find_contamination`` and kept by ``drop_contaminated``; empty tables give no rows found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SLICE_CHARS, SHORT_CHARS, CHARS_AN_EDIT = 4_000_000, 20, 15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int) -> int:
    return m // CHARS_AN_EDIT if m >= SHORT_CHARS else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces that make up the item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best end of ``item`` in ``text``, if within ``most`` edits."""
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    masks: dict[str, int] = {}
    for n, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << n
    full, high = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best, end = full, 0, len(item), most + 1, -1
    for n, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        score += bool(up & high) - bool(down & high)
        if score < best:
            best, end = score, n + 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(xv | up)), up & xv
    return (best, end) if best <= most else None


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends inside a word."""
    return not (start and text[start].isalnum() and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Matcher:
    """All items of a slice; built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items = items
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item):
                where.setdefault(piece, []).append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, owners)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found, best match first seen."""
        text, spans, found = normal(text), {}, []
        for last, owners in self.automaton.iter(text):
            for n, offset in owners:
                start, size = last + 1 - offset, len(self.items[n][1])
                if size >= SHORT_CHARS or stands_alone(text, start, start + size):
                    spans.setdefault(n, []).append(start)
        for n, starts in spans.items():
            key, item = self.items[n]
            most, best, at, ends = budget(len(item)), None, 0, []
            for start in sorted(starts):  # overlapping windows are searched as one
                low, high = max(0, start - most), start + len(item) + most
                if ends and low <= ends[-1][1]:
                    ends[-1][1] = high
                else:
                    ends.append([low, high])
            for low, high in ends:
                hit = best_match(item, text[low:high], most)
                if hit and (best is None or hit[0] < best):
                    best, at = hit[0], low + hit[1]
            if best is not None:
                found.append((key, best, at))
        return sorted(found)


def slice_count(benchmark: DataFrame, text_col: str = "text", slice_chars: int = SLICE_CHARS) -> int:
    total = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / slice_chars))


def item_slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in slices whose size has a bound; a slice at a time is on the driver."""
    n = slice_count(benchmark, text_col, slice_chars)
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(n))
    for k in range(n):
        rows = benchmark.where(F.col(text_col).isNotNull() & (part == k)).select(id_col, text_col).collect()
        items = [(key, item) for key, text in rows if (item := normal(text))]
        if items:
            yield sorted(items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per (document, item) within the item's edit budget: id, item id, distance, end."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, distance int, end_at bigint"
    out, single = docs.sparkSession.createDataFrame([], schema), slice_count(benchmark, item_text, slice_chars) == 1
    for items in item_slices(benchmark, item_col, item_text, slice_chars):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                hits = [(row, *hit) for row, text in enumerate(batch.column(1)) for hit in matcher.find(text.as_py())]
                columns = list(zip(*hits, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], (None if hits else pa.int64(), pa.int32(), pa.int64()), strict=True))], names=["id", "item", "distance", "end"])

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = out.unionByName(found if single else stored(found, "found"))
    return out


def is_clean(items: list[tuple[int, str]], text_col: str) -> Column:
    """True where none of the items is found; a column, so that a filter needs no join."""

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items)
        for texts in parts:
            yield pd.Series([not matcher.find(t) for t in texts], dtype="bool")

    return clean(text_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    single = slice_count(benchmark, item_text, slice_chars) == 1
    for items in item_slices(benchmark, item_col, item_text, slice_chars):
        clean = docs.where(is_clean(items, text_col))
        docs = clean if single else stored(clean, "clean")
    return docs
