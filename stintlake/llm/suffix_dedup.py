"""Substring removal on bytes with sharded suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed. The
same search tells how many bytes lie in shorter repeats, of ``SHORT`` bytes, about a passage of
fifty words; these are counted, not removed.

1. Anchors (see ``anchored``) of all texts, about one a 86 bytes; only those whose hash occurs
   twice can take part in a repeat.
2. Occurrences with equal context are repeats as they stand; counting them combines before the
   shuffle, so copies by the thousand cost one row a task.
3. Distinct contexts of one anchor share a shard. A shard's suffix array is built by induced
   sorting and its permuted common prefixes tell which strings start twice. Shards hold about
   ``SHARD`` bytes.
4. An anchor with more than ``MOST`` distinct contexts (some 2.5 MB, whose arrays take 300 MB)
   would make a shard too large. Such a group is split: a window reaches either so far to the left of the anchor, or so far to the right, so
   contexts that share a window share the stretch there, and each half goes on with its own
   stretch as part of the group's key. Each split halves the room a window has, so after eight a
   group shares the whole window.

Defined results: null or empty text has no bytes; matches never cross documents; every row is a
document of its own, also rows that repeat a doc_id or have none, so equal rows repeat each
other; an empty table gives no rows. Bytes that no longer form UTF-8 are kept in ``kept`` (binary)
as they are. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import Roller, anchor_rows, covered, keyed, kind_of, mixed, with_places
from .common import stored
from .suffixes import repeated_starts

LENGTH, SHORT, GRAM = 400, 300, 130
SHARD, MOST = 400_000, 5_000
_SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_reader():
    def symbols(text: str | None) -> tuple[np.ndarray, bytes, None]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return _SYMBOL[np.frombuffer(raw, np.uint8)], raw, None

    return symbols


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


def _contexts(unsure: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(g, id, k, lo, n, m, data, size) of contexts (f, id, k, lo, hi, n, size), read from the texts;
    windows start in the first m bytes of the data, since those after belong to other contexts."""
    wanted = unsure.groupBy("id", "k").agg(F.collect_list(F.struct("f", "lo", "hi", "n", "size")).alias("w"))
    # equal rows give equal contexts; these occur twice (n > 1) and only serve to compare with
    both = with_places(texts, wanted, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                owner, out = [], []
                for row in range(piece.num_rows):
                    raw = piece.column(2)[row].as_py().encode("utf-8", "surrogatepass")
                    for w in piece.column(3)[row].as_py():
                        owner.append(row)
                        out.append((w["f"], w["lo"], w["n"], w["hi"] - w["lo"] + 1, raw[w["lo"] : w["hi"] + length], w["size"]))
                if out:
                    f, lo, n, m, data, size = zip(*out, strict=True)
                    at_ = pa.array(owner)
                    numbers = [pa.array(x, pa.int64()) for x in (lo, n, m)]
                    columns = [pa.array(f, pa.int64()), piece.column(0).take(at_), piece.column(1).take(at_), *numbers, pa.array(data, pa.binary()), pa.array(size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "id", "k", "lo", "n", "m", "data", "size"])

    return both.select("id", "k", "text", "w").mapInArrow(run, f"g bigint, id {kind_of(texts, 'id')}, k bigint, lo bigint, n bigint, m bigint, data binary, size bigint")


def _by_shard(contexts: DataFrame, length: int, short: int, id_kind: str) -> DataFrame:
    """Runs of repeated starts (id, k, lo, hi, full) within each group g of contexts."""

    def scan(table: pa.Table) -> pa.Table:
        own, low, high, full = [], [], [], []
        found = repeated_starts([np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()], table.column("m").to_pylist(), (short, length))
        lo, n = table.column("lo").to_pylist(), table.column("n").to_pylist()
        for row, (some, whole) in enumerate(zip(*found, strict=True)):
            if n[row] == 1:  # contexts that occur twice are removed already
                for starts, is_full in ((np.setdiff1d(some, whole), False), (whole, True)):
                    for a, b in _runs(starts):
                        own.append(row), low.append(lo[row] + a), high.append(lo[row] + b), full.append(is_full)
        at = pa.array(own, pa.int64())
        return pa.table({"id": table.column("id").take(at), "k": table.column("k").take(at), "lo": pa.array(low, pa.int64()), "hi": pa.array(high, pa.int64()), "full": pa.array(full, pa.bool_())})

    size = contexts.agg(F.sum(F.length("data"))).first()[0] or 0
    sharded = contexts.select("id", "k", "lo", "n", "m", "data", F.pmod(F.xxhash64("g"), F.lit(max(1, math.ceil(size / SHARD)))).alias("shard"))
    return sharded.groupBy("shard").applyInArrow(scan, f"id {id_kind}, k bigint, lo bigint, hi bigint, full boolean")


_GROUPED = "g binary, id {}, k bigint, lo bigint, n bigint, m bigint, data binary, p bigint, a bigint, b bigint"


def _with_anchor(contexts: DataFrame, gram: int, id_kind: str) -> DataFrame:
    """Contexts with the place ``p`` of their anchor, of which no neighbourhood (a, b) is shared yet."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(np.argmax(Roller(_SYMBOL[np.frombuffer(d, np.uint8)]).every(gram).view(np.int64) == g)) for g, d in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            zero = pa.array(np.zeros(len(found), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([g.to_bytes(8, "little", signed=True) for g in batch.column(0).to_pylist()], pa.binary()), *batch.columns[1:], pa.array(found, pa.int64()), zero, zero], names=["g", *batch.schema.names[1:], "p", "a", "b"])

    return contexts.mapInArrow(place, _GROUPED.format(id_kind))


def _split(contexts: DataFrame, room: int, gram: int, length: int, id_kind: str) -> DataFrame:
    """Each context in the groups of its two halves: with the stretch before what its group shares,
    for windows that reach so far to the left, or the one after it, for all others."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for row, (g, lo, n, m, data, p, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7, 8, 9)), strict=True)):
                x = (room - a - b + 1) // 2
                y = room - a - b - x + 1
                if p - a - x >= 0:
                    key = xxhash.xxh3_128_digest(g + b"<" + data[p - a - x : p - a])
                    own.append(row), out.append((key, lo, n, min(m, p - a - x + 1), data[: p - a - x + length], p, a + x, b))
                cut = max(0, p - a - x + 1)
                if p + gram + b + y <= len(data) and cut < m:
                    key = xxhash.xxh3_128_digest(g + b">" + data[p + gram + b : p + gram + b + y])
                    own.append(row), out.append((key, lo + cut, n, m - cut, data[cut:], p - cut, a, b + y))
            if out:
                g, lo, n, m, data, p, a, b = zip(*out, strict=True)
                at = pa.array(own, pa.int64())
                numbers = [pa.array(v, pa.int64()) for v in (lo, n, m, p, a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), batch.column(1).take(at), batch.column(2).take(at), *numbers[:3], pa.array(data, pa.binary()), *numbers[3:]], names=batch.schema.names)

    return contexts.mapInArrow(halves, _GROUPED.format(id_kind))


def _by_parts(contexts: DataFrame, length: int, short: int, gram: int, most: int, id_kind: str) -> DataFrame:
    """Repeats among contexts of anchors that have more than ``most``: (id, k, lo, hi, full)."""
    room, spans = short - gram, None
    rows = stored(_with_anchor(contexts, gram, id_kind), "anchored")
    while not rows.isEmpty():
        whole = rows.where(F.col("a") + F.col("b") == room)
        # a group that shares a whole window, which starts in one place of each context: all of it
        # repeats, and the longer strings there are counted
        place, text = F.col("lo") + F.col("p") - F.col("a"), F.expr(f"substring(data, cast(p - a + 1 as int), {length})")
        whole = whole.where("p - a between 0 and m - 1").select("id", "k", "n", place.alias("lo"), place.alias("hi"), F.when(F.length(text) == length, F.sha2(text, 256)).alias("h"))
        again = whole.where("h is not null").groupBy("h").agg(F.sum("n").alias("c")).where("c > 1").select("h")
        long = whole.where("n = 1").join(again, "h", "left_semi").select("id", "k", "lo", "hi", F.lit(True).alias("full"))
        done = whole.where("n = 1").select("id", "k", "lo", "hi", F.lit(False).alias("full")).unionByName(long)
        halves = stored(_split(rows.where(F.col("a") + F.col("b") < room), room, gram, length, id_kind), "halves")
        sizes = stored(halves.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        halves = stored(halves.join(sizes, "g"), "halves")
        found = stored(done.unionByName(_by_shard(halves.where(F.col("size") <= most), length, short, id_kind)), "spans")
        spans = found if spans is None else spans.unionByName(found)
        rows = halves.where(F.col("size") > most).drop("size")
    return spans


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Runs of starts (id, k, lo, hi, full): the strings of ``short`` bytes that start there also
    start elsewhere, and with ``full`` those of ``length`` bytes as well, where the text has as many."""
    id_kind, texts = kind_of(docs, id_col), keyed(docs, id_col, text_col)
    anchors = stored(anchor_rows(texts, byte_reader, short, gram, length), "anchors")
    whole = F.lit(True).alias("full")
    copied = anchors.where("copies = 0").select("id", "k", "lo", "hi", whole)
    rows = anchors.where("copies > 0")
    # counts are written first, so that the joins with them can split a frequent key
    twice = stored(rows.groupBy("f").agg(F.sum("copies").alias("c")).where("c > 1").select("f"), "twice")
    rows = stored(rows.join(twice, "f", "left_semi"), "repeats")
    contexts = stored(rows.groupBy("f", "c1", "c2").agg(F.sum("copies").alias("n"), F.min(F.struct("id", "k", "lo", "hi")).alias("p")), "contexts")
    several = stored(contexts.groupBy("f").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "several")
    sure = rows.join(contexts.where("n > 1").select("f", "c1", "c2"), ["f", "c1", "c2"], "left_semi").select("id", "k", "lo", "hi", whole).unionByName(copied)
    unsure = contexts.join(several, "f").select("f", "n", "p.*", "size")
    # small and large groups are read in one pass, since it shuffles the texts
    found = stored(_contexts(unsure, texts, length), "contexts")
    spans = sure.unionByName(_by_shard(found.where(F.col("size") <= most), length, short, id_kind))
    if not several.where(F.col("size") > most).isEmpty():
        large = found.where(F.col("size") > most).drop("size")
        spans = spans.unionByName(_by_parts(large, length, short, gram, most, id_kind))
    return stored(spans, "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, and
    n_repeated, the bytes in strings of ``short`` bytes that start twice."""
    spans = repeated_spans(docs, id_col, text_col, length, short, gram, most)
    arrays = spans.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("lo", "hi", "full"))).alias("s")).select("id", "k", *[F.col(f"s.{c}").alias(c) for c in ("lo", "hi", "full")])
    both = with_places(keyed(docs, id_col, text_col), arrays, "left").select("id", "text", "lo", "hi", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                out = []
                for text, lo, hi, full in zip(*(piece.column(k) for k in (1, 2, 3, 4)), strict=True):
                    kept = raw = text.as_py().encode("utf-8", "surrogatepass")
                    gone = spans = repeated = 0
                    if lo.is_valid and raw:
                        first, last, long = np.array(lo.as_py()), np.array(hi.as_py()), np.array(full.as_py()) & (np.array(lo.as_py()) + length <= len(raw))
                        repeated = int(covered(len(raw), first, last + short).sum())
                        mask = covered(len(raw), first[long], np.minimum(last[long] + length, len(raw)))
                        gone, spans = int(mask.sum()), int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1).sum())
                        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                    out.append((len(raw), gone, spans, kept, hashlib.sha256(kept).hexdigest(), repeated))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_repeated"])

    return both.mapInArrow(run, f"id {kind_of(docs, id_col)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, n_repeated bigint").withColumnRenamed("id", id_col)
