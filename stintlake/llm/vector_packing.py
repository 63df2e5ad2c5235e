"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

An example is a list of parts, each with a text and whether its tokens bear loss (the answers
of instruction data do, its prompts don't; of plain documents all do). It is a vector of three demands: tokens, one segment, loss-bearing tokens. One
bin is open at a time. The next example is the one that fits with the largest dot product of its
demand and the room left, both as shares of the limits and weighted by how much of a limit the
waiting examples ask for on average, so the scarcest limit steers the choice.

When nothing that waits fits whole and ``cut`` is on, the longest waiting example is cut to fill
the room. A bin that still can't be filled (its segments or loss are used up, or nothing waits) closes
at the largest power of two below its tokens, which needs no padding; what stands beyond goes back to
the waiting ones. Without ``cut`` examples are cut only where they exceed a limit alone, and bins close as they are.

Each task packs the rows of its own partition with at most ``WAITING`` examples (and ``WAITING_TOKENS``
tokens) in memory, so nothing is shuffled, no task depends on another, memory doesn't grow with the
partition, and only a partition's last bins are short. A sequence id is the partition's number and a
counter. A lost task packs its partition anew and replaces all of its rows; the input must therefore be a table or its
projection, not the output of a shuffle whose order may change: store such an input first.

Defined results: null or empty texts are the end token alone; an example without parts is too; rows that repeat an id are examples of
their own; an empty table gives no pieces; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import WordTokens, _words

END = 1
WAITING, WAITING_TOKENS, NONE = 512, 500_000, 1 << 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass(frozen=True)
class Piece:
    """Ids ``start`` to ``start + len(ids)`` of an example; ``marks`` says which of them bear loss (None: all)."""

    owner: int
    start: int
    ids: np.ndarray
    marks: np.ndarray | None
    total: int

    @property
    def loss(self) -> int:
        return len(self.ids) if self.marks is None else int(self.marks.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        head, tail = (None, None) if self.marks is None else (self.marks[:at], self.marks[at:])
        return Piece(self.owner, self.start, self.ids[:at], head, self.total), Piece(self.owner, self.start + at, self.ids[at:], tail, self.total)

    def fitting(self, tokens: int, loss: int) -> int:
        """The most ids from its start within both bounds."""
        if self.marks is None:
            return min(len(self.ids), tokens, loss)
        most = min(len(self.ids), tokens)
        return int(np.searchsorted(np.cumsum(self.marks[:most]), loss, side="right"))


def text_ids(words: WordTokens, text: str) -> bytes:
    return words.ids(text)


class Packer:
    """Examples go in by ``add``, closed bins come out: lists of pieces in order."""

    def __init__(self, limits: Limits, cut: bool, waiting: int = WAITING, waiting_tokens: int = WAITING_TOKENS) -> None:
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.cut, self.most, self.most_tokens = limits, cut, waiting, waiting_tokens
        self.pieces: list[Piece | None] = []
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)  # NONE where no piece is
        self.free: list[int] = []
        self.held = self.held_loss = 0

    def _wait(self, piece: Piece) -> None:
        if not self.free:
            grown = len(self.pieces)
            more = max(64, grown)
            self.tokens, self.loss = (np.append(x, np.full(more, NONE)) for x in (self.tokens, self.loss))
            self.pieces += [None] * more
            self.free = list(range(grown + more - 1, grown - 1, -1))
        k = self.free.pop()
        self.pieces[k] = piece
        self.tokens[k], self.loss[k] = n, loss = len(piece.ids), piece.loss
        self.held += n
        self.held_loss += loss

    def _take(self, k: int) -> Piece:
        piece = self.pieces[k]
        self.held -= int(self.tokens[k])
        self.held_loss -= int(self.loss[k])
        self.pieces[k], self.tokens[k], self.loss[k] = None, NONE, NONE
        self.free.append(k)
        return piece

    def _count(self) -> int:
        return len(self.pieces) - len(self.free)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Stretches that fill a bin alone leave at once; the rest waits."""
        while True:
            n = piece.fitting(self.limits.tokens, self.limits.loss)
            if n == len(piece.ids) < self.limits.tokens:
                break
            head, piece = piece.split(n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self._wait(head)
            if not len(piece.ids):
                break
        if len(piece.ids):
            self._wait(piece)
        while self._count() > self.most or self.held > self.most_tokens:
            yield from self._bin()

    def _bin(self) -> Iterator[list[Piece]]:
        """Fill and close one bin."""
        limits, chosen = self.limits, []
        waiting = self._count()
        # the weight of a limit, over its square twice: demand and room both as shares
        by_tokens, by_segments, by_loss = (mean / limit**3 for mean, limit in ((self.held / waiting, limits.tokens), (1, limits.segments), (self.held_loss / waiting, limits.loss)))
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        while tokens and segments and self._count():
            fits = (self.tokens <= tokens) & (self.loss <= loss)
            score = np.where(fits, self.tokens * (by_tokens * tokens) + by_segments * segments + self.loss * (by_loss * loss), -1.0)
            k = int(score.argmax())
            if fits[k]:
                piece = self._take(k)
            elif self.cut:
                k = int(np.where(self.tokens < NONE, self.tokens, -1).argmax())
                n = self.pieces[k].fitting(tokens, loss)
                if not n:
                    break
                piece, rest = self._take(k).split(n)
                self._wait(rest)
            else:
                break
            chosen.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - piece.loss
        total = limits.tokens - tokens
        if self.cut and total < self.limits.tokens:
            total = 1 << (total.bit_length() - 1)
            kept = []
            for piece in chosen:
                n = min(len(piece.ids), total)
                total -= n
                head, rest = piece.split(n)
                if n:
                    kept.append(head)
                if len(rest.ids):
                    self._wait(rest)
            chosen = kept
        yield chosen

    def finish(self) -> Iterator[list[Piece]]:
        while self._count():
            yield from self._bin()


def packed_examples(examples: DataFrame, tokenizer_path: str, limits: Limits = Limits(), cut: bool = True, id_col: str = "doc_id", parts_col: str = "parts", end: int = END) -> DataFrame:
    """``parts``: array<struct<text string, loss boolean>>. One row per piece: id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, loss_tokens. The end token bears loss where the last part does, and in an empty example."""
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _words(tokenizer_path), Packer(limits, cut)
        task = TaskContext.get()
        base, made, ids = (task.partitionId() if task else 0) << 40, 0, {}
        waiting: dict[int, int] = {}  # ids still waiting, by row
        row = 0

        def emit(bins: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal made
            for pieces in bins:
                offset = 0
                for p in pieces:
                    yield ids[p.owner], p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, base + made, offset, p.loss
                    offset += len(p.ids)
                    waiting[p.owner] -= len(p.ids)
                    if not waiting[p.owner]:
                        del waiting[p.owner], ids[p.owner]
                made += 1

        def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", "start", "length", "crc", "total", "sequence", "offset", "loss"])

        id_type = pa.int64()
        for batch in batches:
            id_type, out = batch.column(0).type, []
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = [(text_ids(words, p["text"] or ""), bool(p["loss"])) for p in parts or () if p]
                last = chunks[-1][1] if chunks else True
                tokens = np.frombuffer(b"".join([c for c, _ in chunks]) + np.array([end], "<u4").tobytes(), "<u4")
                marks = None
                if not (last and all(m for _, m in chunks)):
                    marks = np.concatenate([*(np.full(len(c) // 4, m) for c, m in chunks), [last]])
                ids[row], waiting[row] = key, len(tokens)
                out += emit(packer.add(Piece(row, 0, tokens, marks, len(tokens))))
                row += 1
            yield table(out, id_type)
        yield table(list(emit(packer.finish())), id_type)

    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"
    return examples.select(id_col, parts_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain documents: one part each, all of whose tokens bear loss."""
    part = F.struct(F.col(text_col).cast("string").alias("text"), F.lit(True).alias("loss"))
    return packed_examples(docs.select(id_col, F.array(part).alias("parts")), tokenizer_path, limits, True, id_col)
