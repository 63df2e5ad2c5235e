"""Phrase collocation mining over compressed position bitmaps.

The words of a language's documents stand on one position axis a shard, with a blank between
pieces, and each word has a bitmap of its positions, kept as its non-zero bytes and their places. The
bitmap of a phrase holds where it ends: shifting it by one and ANDing it with the bitmaps of words gives those of
all its extensions, and popcounts are their occurrences, overlaps included. A blank is in no bitmap, so no phrase crosses
the border of a piece. Prefix classes are extended depth first, a bounded slice of first words at a time.

Counts of shards are summed by Spark. Passes over the stored shards count words, then pairs and triples by slots of their hashes, then all likely phrases by name; a pass extends only what the passes before found
likely. A slot's sum is never less than the count of a phrase in it, so rare phrases, which are most, never leave a shard by name. Slots travel sorted, in byte planes, and there are
2^32 for each 2^21 positions or less, so they fill up at no corpus size. Shards learn of frequent phrases
from a filter of ``FILTER_BITS`` bits over phrase hashes (16 MB, whatever the corpus): a false hit costs
time, never a result, since the sums by name decide. A filter that fills up prunes less; raise ``filter_bits`` with the corpus.

A shard is closed at ``SHARD`` positions or at the end of a task's rows, so a language with a third of all rows fills more
shards; a single text longer than that is one shard. Scores are ratios of decimals with 38 digits, exact while 1000 * a * n stays below 10^38.

Defined results: null and empty texts have no words; a null language is ``und``, as is one of that name; rows that
repeat an id count each; a language without words or candidates has no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
SHARD, SLICE, FILTER_BITS = 1 << 19, 1 << 15, 1 << 27
#: Positions behind a group of slots, slots that a task holds before they leave it, and shards of a row group, of which a reader decodes all at once.
GROUP, HELD, ROW_GROUP = 1 << 21, 1 << 21, 4

#: Letters to lower case, borders of pieces to line feeds, tab to space; other bytes stay.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.int64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Ids(dict):
    """word -> number in order of first sight. Number 0 is the blank between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def word_ids(data: bytes, ids: Ids) -> np.ndarray:
    """Numbers of a text's words; 0 stands between pieces and at its end."""
    parts = data.translate(FOLD).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter((ids[x] for x in parts if x), np.int32)
    return np.append(found, np.int32(0))


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """Rows (lang, words, ids): the distinct words of a shard and its positions as numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Ids, list[np.ndarray], int]] = {}

        def closed(lang: str) -> pa.RecordBatch:
            ids, found, _ = open_.pop(lang)
            words = pa.array([list(ids)], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([lang]), words, pa.ListArray.from_arrays(pa.array([0, sum(map(len, found))], pa.int32()), pa.array(np.concatenate(found), pa.int32()))], names=["lang", "words", "ids"])

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, found, n = open_.get(lang) or (Ids({b"\n": 0}), [], 0)
                found.append(word_ids(data.as_py() or b"", ids))
                open_[lang] = ids, found, n + len(found[-1])
                if n + len(found[-1]) >= size:
                    yield closed(lang)
            # many languages at once share one bound
            while sum(n for _, _, n in open_.values()) >= 2 * size:
                yield closed(max(open_, key=lambda k: open_[k][2]))
        for lang in list(open_):
            yield closed(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, words array<binary>, ids array<int>")


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hash(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases given as rows of word numbers."""
    value = np.full(len(words), words.shape[1], np.uint64)
    for k in range(words.shape[1]):
        value = (value ^ hashes[words[:, k]]) * MIX
        value ^= value >> np.uint64(29)
    return value


class Bits:
    """Bitmaps side by side: bit b of ``byte[i]`` says that ``owner[i]`` has position 8 * ``at[i]`` + b."""

    def __init__(self, owner: np.ndarray, at: np.ndarray, byte: np.ndarray) -> None:
        self.owner, self.at, self.byte = owner, at, byte

    @classmethod
    def of(cls, owner: np.ndarray, position: np.ndarray) -> Bits:
        """From (owner, position), each at most once."""
        key = owner.astype(np.int64) << 32 | position >> 3
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.uint8(1) << (position[order] & 7).astype(np.uint8)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return cls(key[first] >> 32, key[first] & 0xFFFFFFFF, np.bitwise_or.reduceat(bit, first) if len(key) else bit)

    def shifted(self) -> Bits:
        """One position on; what leaves a byte goes on in the next."""
        low, high = (self.byte << 1).astype(np.uint8), self.byte >> 7
        stay, carry = low > 0, high > 0
        return Bits(np.concatenate([self.owner[stay], self.owner[carry]]), np.concatenate([self.at[stay], self.at[carry] + 1]), np.concatenate([low[stay], high[carry]]))

    def ordered(self, order: np.ndarray) -> Bits:
        return Bits(self.owner[order], self.at[order], self.byte[order])


class Shard:
    """The bitmaps of a shard's frequent words, also by place."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray, filters: dict[int, np.ndarray]) -> None:
        self.hashes, self.filters = word_hashes(lang, words), filters
        frequent = self.frequent(np.arange(len(words))[:, None])
        frequent[0] = False
        position = np.flatnonzero(frequent[ids])
        self.bits = Bits.of(ids[position], position)
        order = np.argsort(self.bits.at, kind="stable")
        self.by_place = self.bits.ordered(order)
        self.first = np.searchsorted(self.by_place.at, np.arange(len(ids) // 8 + 3))

    def frequent(self, words: np.ndarray) -> np.ndarray:
        """Which phrases may be frequent, as far as the passes before counted them."""
        known = self.filters.get(words.shape[1])
        if known is None:
            return np.ones(len(words), bool)
        slot = phrase_hash(self.hashes, words) % np.uint64(len(known) * 8)
        return known[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1

    def possible(self, words: np.ndarray) -> np.ndarray:
        """The last words of a phrase, as many as were counted, must be frequent; those before them were looked at in its prefix."""
        width = min(words.shape[1], max(self.filters))
        return self.frequent(np.ascontiguousarray(words[:, -width:]))

    def extended(self, phrases: np.ndarray, bits: Bits) -> tuple[np.ndarray, np.ndarray, Bits]:
        """All extensions by one word that occur and may be frequent: words, occurrences, bitmaps."""
        moved = bits.shifted()
        start = self.first[moved.at]
        n = self.first[moved.at + 1] - start
        row = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]
        both = moved.byte[row] & self.by_place.byte[other]
        hit = np.flatnonzero(both)
        row, other, both = row[hit], other[hit], both[hit]
        key = moved.owner[row] << 32 | self.by_place.owner[other]
        distinct, number = np.unique(key, return_inverse=True)
        words = np.hstack([phrases[distinct >> 32], (distinct & 0xFFFFFFFF)[:, None]])
        keep = self.possible(words)
        count = np.bincount(number, weights=POPCOUNT[both], minlength=len(distinct)).astype(np.int64)
        new = np.cumsum(keep) - 1
        live = keep[number]
        return words[keep], count[keep], Bits(new[number[live]], moved.at[row[live]], both[live])

    def grow(self, phrases: np.ndarray, bits: Bits, lengths: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of the asked lengths with their occurrences, depth first."""
        words, count, found = self.extended(phrases, bits)
        if not len(words):
            return
        if words.shape[1] in lengths:
            yield words, count
        if words.shape[1] < lengths.stop - 1:
            yield from self.grow(words, found, lengths)

    def mine(self, lengths: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        owners, start = np.unique(self.bits.owner, return_index=True)
        end = np.append(start[1:], len(self.bits.owner))
        at = 0
        while at < len(owners):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
            part = slice(start[at], end[stop - 1])
            owner = np.searchsorted(owners[at:stop], self.bits.owner[part])
            yield from self.grow(owners[at:stop, None], Bits(owner, self.bits.at[part], self.bits.byte[part]), lengths)
            at = stop


def joined(words: pa.Array, phrases: np.ndarray) -> pa.Array:
    columns = [words.take(pa.array(phrases[:, k])) for k in range(phrases.shape[1])]
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" ")


def counts(parts: DataFrame, lengths: range, filters: dict[int, np.ndarray]) -> DataFrame:
    """Rows (lang, phrase, f) of each shard, to be summed, of phrases that may be frequent."""
    shared = parts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, lang in enumerate(batch.column(0).to_pylist()):
                words, ids = batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                names = words.to_pylist()
                if lengths.start == 1:
                    n = np.bincount(ids, minlength=len(names))
                    found = iter([(np.arange(1, len(names))[:, None], n[1:])])
                else:
                    shard = Shard(lang, names, ids, shared.value)
                    found = shard.mine(lengths)
                for phrases, n in found:
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), joined(words, phrases), pa.array(n)], names=["lang", "phrase", "f"])

    return parts.mapInArrow(run, "lang string, phrase binary, f bigint")


def summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def merged(slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order with their sums."""
    order = np.argsort(slots)
    slots, n = slots[order], n[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, np.int64)
    return slots[first], np.add.reduceat(n, first) if len(slots) else n


def planes(slots: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as four planes of bytes, of which the upper ones hardly change."""
    return slots.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def likely(parts: DataFrame, length: int, filters: dict[int, np.ndarray], least: int, groups: int) -> DataFrame:
    """The slots (hash) whose phrases of ``length`` words occur ``least`` times in sum: the low 32 bits of the phrase hash and the
    number of its group, of which there are ``groups`` (a power of two), above them."""
    shared = parts.sparkSession.sparkContext.broadcast(filters)
    mask = np.uint64(groups * (1 << 32) - 1)

    def packed(found: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        slots, n = merged(np.concatenate(found), np.concatenate(sums))
        group = (slots >> np.uint64(32)).astype(np.int32)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = [*first[1:].tolist(), len(slots)]
        n = np.minimum(n, least).astype(np.int32)  # that many in one task are enough
        cut = list(zip(first.tolist(), ends, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array([planes(slots[a:b]) for a, b in cut], pa.binary()), pa.array([planes(n[a:b]) for a, b in cut], pa.binary())], names=["group", "slots", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums, held = [], [], 0
        for batch in batches:
            for k, lang in enumerate(batch.column(0).to_pylist()):
                names, ids = batch.column(1)[k].values.to_pylist(), batch.column(2)[k].values.to_numpy()
                shard = Shard(lang, names, ids, shared.value)
                for phrases, n in shard.mine(range(length, length + 1)):
                    found.append(phrase_hash(shard.hashes, phrases) & mask)
                    sums.append(n)
                    held += len(n)
                if held >= HELD:
                    yield packed(found, sums)
                    found, sums, held = [], [], 0
        if held:
            yield packed(found, sums)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n, group = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        held, bound = 0, HELD
        for batch in batches:
            for g, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                group = g
                slots.append(from_planes(a).astype(np.uint64))
                n.append(from_planes(b).astype(np.int64))
                held += len(n[-1])
                if held >= bound:
                    one, total = merged(np.concatenate(slots), np.concatenate(n))
                    slots, n, held, bound = [one], [total], len(one), max(HELD, 2 * len(one))
        one, total = merged(np.concatenate(slots), np.concatenate(n))
        hit = one[total >= least] | np.uint64(group << 32)
        yield pa.RecordBatch.from_arrays([pa.array(hit.view(np.int64))], names=["hash"])

    return parts.mapInArrow(run, "group int, slots binary, n binary").groupBy("group").applyInArrow(settled, "hash bigint")


def hashed(phrases: DataFrame) -> DataFrame:
    """The hashes of phrases (lang, phrase), as ``phrase_hash`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = phrase.split(b" ")
                out.append(phrase_hash(word_hashes(lang, words), np.arange(len(words))[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())], names=["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash bigint")


def hash_filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits (a power of two, at least 32,768) as bytes; a phrase sets the bit of its hash. The driver gets ``bits / 8`` bytes at most."""
    slots = frequent.select((F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1).alias("slot"))
    rows = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("m")).collect()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.reshape(-1)


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", size: int = SHARD, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    parts = stored(shards(docs, text_col, lang_col, size), "shards", ROW_GROUP)
    ones = counts(parts, range(1, 2), {})
    totals = stored(ones.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    out = stored(summed(ones, least), "words")
    if longest > 1:
        n = totals.agg(F.sum("n")).first()[0] or 0
        groups = 64
        while groups * GROUP < n:
            groups *= 2
        filters = {1: hash_filter(hashed(out), filter_bits)}
        for length in range(2, min(longest, 3) + 1):
            filters[length] = hash_filter(likely(parts, length, dict(filters), least, groups), filter_bits)
        out = out.unionByName(stored(summed(counts(parts, range(2, longest + 1), filters), least), "phrases"))
    phrase = F.col("phrase").cast("string")
    return out.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ", -1)).alias("words"), "f"), totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates of two words and more with their lowest-scoring cut: lang, phrase, words, a, l, r, n, score."""
    word = F.split("phrase", " ", -1)
    candidates = frequent.where("words > 1").withColumnRenamed("f", "a").join(totals, "lang")
    cuts = candidates.withColumn("w", word).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    head, tail = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.select("lang", "phrase", "words", "a", "n", "k", head.alias("head"), tail.alias("tail")).join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) * cast(1000 AS decimal(4,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best")
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def undominated(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Without phrases that stand inside a longer candidate that occurs as often. Between the two stands a candidate of
    each length between, with the same count, so those longer by one word decide."""
    word = F.split("phrase", " ", -1)
    longer = frequent.where("words > 2").select("lang", F.col("f").alias("covered"), F.explode(F.array(*[F.array_join(F.slice(word, F.lit(s), F.col("words") - 1), " ") for s in (1, 2)])).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("covered").alias("covered"))
    return candidates.join(covered, ["lang", "phrase"], "left").where("covered IS NULL OR covered < a").drop("covered")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", size: int = SHARD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent, totals = frequent_phrases(docs, least, longest, text_col, lang_col, size, filter_bits)
    kept = undominated(scored(frequent, totals), frequent)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
