"""Packing token sequences by minimum bin slack.

Documents become token pieces of at most ``capacity``; the packing then needs only how many
pieces there are of each length: at most ``capacity`` numbers, whatever the corpus. For a bin,
the longest length left is fixed and a bitset dynamic programme over the available lengths
finds the fullest feasible rest; that combination is used as often as the counts allow, then
removed. Since each round exhausts a length (or nearly), the plan has a bounded number of
patterns. Pieces take their places by rank within their length, counted per hash bucket; a
length has a bucket for each ``BUCKET_ROWS`` pieces, or for each ``FEW_ROWS`` up to ``LEAST_BUCKETS``, so that
one with a third of all rows is numbered in parallel, and the driver sees one number a bucket.

Defined results: null or empty text is the end token alone, one piece of length 1; rows that
repeat a doc_id are packed as pieces of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY, END = 4096, 1
BUCKET_ROWS, FEW_ROWS, LEAST_BUCKETS = 200_000, 500, 64
CACHED_WORDS, CACHED_FORMS = 600_000, 150_000
MARKS, AT_ONCE = string.punctuation, 500_000


class WordTokens(dict):
    """word -> its ids as little-endian uint32 bytes.

    Exact for a vocabulary whose pre-tokenizer never joins across white space and cuts letters
    from other characters: a word that is letters and closing marks is put together from its
    lower-case letters and its marks (a capital sigma aside, whose small form depends on its
    place); any other unseen word goes to the tokenizer as it is. Unseen words of letters go to the
    tokenizer as one text, whose ids are cut behind those that end a word."""

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.forms = Tokenizer.from_file(path), limit, 0
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        last = {i: len(x) - len(suffix) for x, i in vocab.items() if x.endswith(suffix)} if suffix else {}
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if sum(n == 1 for n in last.values()) == 256:  # any byte can end a word, so every word of letters has one end
            self.ends[list(last)] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        low = core.lower()
        if core.isalpha() and low.isalpha() and (len(core) < len(word) or low != word) and "\u03a3" not in core:
            value = self[low] + (self[word[len(core) :]] if len(core) < len(word) else b"")
            if self.forms < CACHED_FORMS:
                self.forms += 1
                self[word] = value
            return value
        value = self.encode(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words that are letters alone."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(words):
            return list(map(self.encode, words))
        whole = ids.tobytes()
        return [whole[at:to] for at, to in zip([0, *cuts], cuts, strict=False)]

    def learn(self, words: Iterable[str]) -> list[str]:
        """Encodes what ``words`` are put together from; returns the entries that are new."""
        letters, other = set(), set()
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha() and (low := core.lower()).isalpha() and "\u03a3" not in core:
                letters.add(low)
                if len(core) < len(word):
                    other.add(word[len(core) :])
            else:
                other.add(word)
        names, rest = [x for x in letters if x not in self], [x for x in other if x not in self]
        self.update(zip(names, self._letters(names), strict=True))
        self.update(zip(rest, (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return names + rest

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """``ids`` of each text, with the words that were not met before encoded together. Beyond the
        cache's limit they are forgotten afterwards."""
        found, fresh, out = [], set(), []
        for t in texts:
            words = None if "<|" in t or any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split()
            known = list(map(self.get, words or ()))
            if None in known:
                fresh.update(w for w, k in zip(words, known, strict=True) if k is None)
                found.append((words, known))
            else:
                found.append((words, b"".join(known)))
        added = self.learn(fresh) if fresh else []
        for t, (words, known) in zip(texts, found, strict=True):
            if words is None:
                out.append(self.encode(t))
            else:
                out.append(known if isinstance(known, bytes) else b"".join([self[w] if k is None else k for w, k in zip(words, known, strict=True)]))
        if len(self) - self.forms > self.limit:
            for name in added:
                del self[name]
        return out

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text (null: empty), about ``AT_ONCE`` characters at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text.as_py() or "")
            size += len(waiting[-1])
            if size >= AT_ONCE:
                yield from self.ids_of(waiting)
                waiting, size = [], 0
        yield from self.ids_of(waiting)


@lru_cache(maxsize=2)
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Only a document longer than
    ``capacity`` is cut."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, step = _words(tokenizer_path), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(words.ids_of_all(batch.column(1))):
                ids += last
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    owner.append(row), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "crc"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths whose sum is the largest that fits in ``room``, longest first among the
    available ones; bit s of a set says that sum s can be reached."""
    reach, steps = 1, []
    goal, mask = 1 << room, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((reach, length))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    left, out = reach.bit_length() - 1, []
    for before, length in reversed(steps):
        if not before >> left & 1:
            out.append(length)
            left -= length
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (times used, [(length, how many), ...]); they use up ``counts`` exactly."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        top = max(left)
        rest = {k: v - (k == top) for k, v in left.items() if v > (k == top)}
        chosen: dict[int, int] = {}
        for length in [top, *fullest(capacity - top, rest)]:
            chosen[length] = chosen.get(length, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, sorted(chosen.items(), reverse=True)))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each use of a length in a pattern: first rank served, how many a bin, first bin, offset."""
    served: dict[int, int] = {}
    rows, base = [], 0
    for times, lengths in patterns:
        offset = 0
        for length, n in lengths:
            rows.append((length, served.get(length, 0), n, base, offset))
            served[length] = served.get(length, 0) + times * n
            offset += n * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "n", "base", "offset"]).sort_values(["length", "first"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (stored: it is read three times) with sequence_id and offset."""
    known = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).collect()  # at most capacity rows
    buckets = pd.Series({int(r["length"]): max(-(-r["_n"] // bucket_rows), min(-(-r["_n"] // FEW_ROWS), LEAST_BUCKETS)) for r in known}, dtype="int64")

    @F.pandas_udf("bigint")
    def bucket(length: pd.Series, spread: pd.Series) -> pd.Series:
        return spread % length.map(buckets)

    pieces = pieces.withColumn("_bucket", bucket("length", F.xxhash64(id_col, "piece", "ids_crc32")))
    counted = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).toPandas()
    table = places(plan({int(k): int(v) for k, v in counted.groupby("length")["_n"].sum().items()}, capacity))
    first = counted.sort_values(["length", "_bucket"])
    first = dict(zip(zip(first["length"], first["_bucket"], strict=True), first.groupby("length")["_n"].cumsum() - first["_n"], strict=True))
    key = table["length"].to_numpy(np.int64) * (1 << 44) + table["first"].to_numpy(np.int64)
    n, base, offset, start = (table[c].to_numpy(np.int64) for c in ("n", "base", "offset", "first"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy(np.int64) + np.fromiter((first[k] for k in zip(length, bucket, strict=True)), np.int64, len(rank))
        at = np.searchsorted(key, length.to_numpy(np.int64) * (1 << 44) + r, side="right") - 1
        r = r - start[at]
        return pd.DataFrame({"sequence_id": base[at] + r // n[at], "offset": offset[at] + r % n[at] * length.to_numpy(np.int64)})

    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")) - 1
    return pieces.withColumn("_p", place("length", "_bucket", rank.cast("long"))).select(*[c for c in pieces.columns if c != "_bucket"], "_p.sequence_id", "_p.offset")


def tokenize_and_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer_path, id_col, text_col), "pieces"), id_col=id_col)
