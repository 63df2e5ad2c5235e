"""Near-duplicate groups: MinHash banding, sequential Bayesian verification, exact confirmation.

1. Every whole text becomes a set of word shingles (64-bit hashes), a MinHash signature and one
   key per band. Texts with equal word sequences form a class, and one row stands for it, so
   copies by the thousand cost one row.
2. Members of a band bucket are candidates. Instead of all pairs of a bucket, its members are
   compared with a pivot: first the member that shares most bands with others (the likely centre
   of a family), then other choices. Pairs whose members are in one component already need no
   comparison. Buckets that still hold several components after the pivot rounds are compared
   completely, so no candidate is skipped: small ones by a join, large ones in blocks of a
   bounded number of members and of bytes, of which only the surviving pairs leave the task.
   A bucket of more than ``HOT`` members is spread over several keys for its joins.
3. A pair's signatures are compared a batch at a time. With m of n values equal, the posterior
   of the similarity (uniform prior) gives the chance of reaching the threshold; below
   ``MISS`` the pair is dropped, most after the first batch.
4. What survives is confirmed on the full sets, as integers: 100 * shared >= percent * union.

25 bands of 6 values find a pair at 0.85 with probability 1 - 7e-6 and at 0.9 with 1 - 6e-9;
below 0.85, 30 bands of 5 find a pair at 0.8 with 1 - 7e-6. Defined results: null, empty or blank text has an empty set, is linked with nothing
and kept; with fewer words than a shingle the whole sequence is one shingle; rows that repeat a
doc_id are documents of their own, each linked by its own text (those with equal words share their result,
and what loses leaves alone what else has its id); a null doc_id loses against any other id,
and where a group has no other, component_id is null and its rows are all kept; of texts that tie, the smallest
doc_id stays; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused
from .components import stars

VALUES, BATCH, MISS = 150, 15, 1e-6
SALTS, ROUNDS, CACHED_WORDS = 16, 3, 200_000
SMALL, BLOCK, BLOCK_SHINGLES, HOT = 32, 256, 300_000, 500
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, VALUES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, VALUES, dtype=np.int64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 62, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def sequence(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def shingles(text: str | None, width: int, cache: Words) -> tuple[np.ndarray, bytes]:
    """The sorted distinct shingle hashes, and a digest of the word sequence."""
    words = sequence(text)
    if not words:
        return np.zeros(0, np.uint64), b""
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64), digest
    n = len(h) - width + 1
    s = h[:n] * _MIX[0]
    for k in range(1, width):
        s += h[k : k + n] * _MIX[k]
    s ^= s >> np.uint64(32)
    s *= _MIX[15]
    return np.unique(s ^ (s >> np.uint64(29))), digest


def signature(s: np.ndarray) -> np.ndarray:
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _A + _B).min(0), out=least)
    return least


def rows_a_band(percent: int) -> int:
    return 6 if percent >= 85 else 5


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.reshape(-1, rows).astype(np.uint64)
    keys = bands @ _MIX[:rows] + np.arange(len(bands), dtype=np.uint64) * _MIX[14]
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def least_matches(percent: int, size: int = VALUES, miss: float = MISS) -> np.ndarray:
    """For n compared values, the fewest matches at which P(similarity >= threshold) >= miss.

    With a uniform prior the posterior is Beta(m+1, n-m+1); its upper tail at t equals
    P(Binomial(n+1, t) <= m)."""
    t, out = percent / 100, np.zeros(size + 1, np.int64)
    for n in range(1, size + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out[n] = m
                break
    return out


def prune(left: np.ndarray, right: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows) survive the sequential test."""
    alive, seen = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, left.shape[1], BATCH):
        seen[alive] += (left[alive, at : at + BATCH] == right[alive, at : at + BATCH]).sum(1)
        alive = alive[seen[alive] >= fewest[min(at + BATCH, left.shape[1])]]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in batches:
            size, digest, sig, keys = [], [], [], []
            for text in batch.column(1):
                s, d = shingles(text.as_py(), width, cache)
                size.append(len(s)), digest.append(d)
                m = signature(s) if len(s) else None
                sig.append(m.tobytes() if len(s) else b""), keys.append(band_keys(m, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "sig", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {_kind(docs, id_col)}, n bigint, digest binary, sig binary, keys array<bigint>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in batches:
            made = [shingles(t.as_py(), width, cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for _, d in made], pa.binary()), pa.array([s.tobytes() for s, _ in made], pa.binary())], names=["id", "digest", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {_kind(docs, id_col)}, digest binary, shingles binary")


def _pruned(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that survive size bound and sequential test."""
    fewest = least_matches(percent)
    side = [reps.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(side[1], "b").join(side[0], "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(prune(left, right, fewest)))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _family_links(large: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of members (key, node, comp) of large buckets.

    Large buckets that share members form a family, met once instead of once a band. A family
    is cut into blocks of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, and each task compares one block with one
    other: signatures by the sequential test, then full sets. Of the links of a task only
    those that join two of its components leave it."""
    fewest = least_matches(percent)
    head = large.groupBy("key").agg(F.min("node").alias("head"))
    roots = stars(large.join(head, "key").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    nodes = large.groupBy("node").agg(F.min("comp").alias("comp")).join(roots.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left")
    nodes = nodes.select("node", "comp", F.coalesce("root", "node").alias("family")).join(reps.select(F.col("digest").alias("node"), "n", "sig"), "node")
    blocks = nodes.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = nodes.join(blocks, "family").join(sets.select(F.col("digest").alias("node"), "shingles"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        comp = np.unique(np.array(table.column("comp").to_pylist(), object), return_inverse=True)[1]
        n, node = table.column("n").to_numpy(), table.column("node").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(n), -1)
        values = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        ids = np.unique(np.concatenate(values), return_inverse=True)[1]
        of = np.split(ids, np.cumsum(n)[:-1])
        mark = np.zeros(ids.max() + 1, np.int64)
        first, second = np.flatnonzero(own == lo[0]), np.flatnonzero(own == hi[0])
        a, b = [], []
        for i in first:
            j = second if lo[0] != hi[0] else first[first > i]
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            j = j[prune(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], fewest)]
            if len(j):
                mark[of[i]] = 1
                shared = np.add.reduceat(mark[np.concatenate([of[k] for k in j])], np.concatenate([[0], np.cumsum(n[j])[:-1]]))
                mark[of[i]] = 0
                for k in j[100 * shared >= percent * (n[i] + n[j] - shared)]:
                    if comp[k] != comp[i]:
                        comp[comp == comp[k]] = comp[i]
                        a.append(min(node[i], node[k])), b.append(max(node[i], node[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.select("family", "lo", "hi", "own", "node", "comp", "n", "sig", "shingles").groupBy("family", "lo", "hi").applyInArrow(compare, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = [sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(side[1], "b").join(side[0], "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _spread(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` of members joined with one row a bucket, (key, size, ...): a bucket has a salt for
    each ``HOT`` members, so that no task gets more of a large one. The bucket rows are stored:
    counted in the same stage, they would bind the join to whole keys."""
    salts = F.ceil(F.col("size") / HOT).cast("long")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    right = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("size")
    return left.join(right, ["key", "salt"]).drop("salt")


def _with_components(members: DataFrame, star: DataFrame | None) -> DataFrame:
    if star is None:
        return members.withColumn("comp", F.col("node"))
    known = members.join(star.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left")
    return stored(known.select("key", "size", "node", "degree", F.coalesce("root", "node").alias("comp")), "known")


def _open_buckets(known: DataFrame, turn: int, rounds: int) -> DataFrame:
    """The buckets that hold more than one component, (key, size, heads): in the pivot rounds with the pivots of the turn."""
    order = [F.struct("degree", "node")] if turn == 0 else [F.struct(F.xxhash64("node", F.lit(turn * 8 + k)), "node") for k in range(2 * turn if turn < rounds else 0)]
    chosen = [F.max(F.struct(o, F.struct(F.col("node").alias("pivot"), F.col("comp").alias("pc")).alias("head"))).alias(f"p{k}") for k, o in enumerate(order)]
    buckets = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.first("size").alias("size"), *chosen).where("x != y")
    heads = [F.array_distinct(F.array(*[F.col(f"p{k}.head") for k in range(len(order))])).alias("heads")] if order else []
    return stored(buckets.select("key", "size", *heads), "buckets")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    return _groups(docs, id_col, text_col, width, percent, rounds).drop("digest")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``near_groups`` with the digests of their word sequences."""
    all_rows = stored(sketches(docs, id_col, text_col, width, rows_a_band(percent)), "sketches")
    reps = stored(
        all_rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "n", "sig", "keys")).alias("r"), F.count(F.lit(1)).alias("copies")).select("digest", "copies", "r.id", "r.n", "r.sig", "r.keys"), "classes"
    )
    keyed = reps.select(F.col("digest").alias("node"), F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = stored(keyed.join(shared, "key"), "members")
    degree = stored(members.groupBy("node").agg(F.sum("size").alias("degree")), "degree")
    members = stored(members.join(degree, "node"), "members")

    # the texts that can be compared: those of classes with a band in common with another
    needed = reps.join(degree, reps["digest"] == degree["node"], "left_semi").select(F.col("id").alias(id_col), "digest")
    picked = docs.select(id_col, text_col).join(needed.select(id_col).distinct(), id_col, "left_semi")
    # a class without any id is found by its digest alone
    nameless = full_sets(docs.where(F.col(id_col).isNull()), id_col, text_col, width).dropDuplicates(["digest"])
    sets = stored(full_sets(picked, id_col, text_col, width).unionByName(nameless).join(needed.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "sets")

    star, edges, tested = None, None, None
    for turn in range(rounds + 1):
        known = _with_components(members, star)
        buckets = _open_buckets(known, turn, rounds)
        if buckets.isEmpty():
            break
        links = None
        if turn < rounds:
            pivots = buckets.select("key", "size", F.explode("heads").alias("h")).select("key", "size", "h.pivot", "h.pc")
            pairs = _spread(known, pivots).where("comp != pc").select("node", "pivot")
        else:
            open_now = stored(_spread(known, buckets), "open")
            small = open_now.where(F.col("size") <= SMALL)
            other = small.select("key", F.col("node").alias("pivot"), F.col("comp").alias("pc"))
            pairs = small.join(other, "key").where("comp != pc and node < pivot").select("node", "pivot")
            large = open_now.where(F.col("size") > SMALL)
            links = None if large.isEmpty() else _family_links(large, reps, sets, percent)
        pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = _confirmed(_pruned(pairs, reps, percent), sets, percent)
        fresh = stored(fresh if links is None else fresh.unionByName(links), "links")
        if fresh.isEmpty():
            continue
        edges = fresh if star is None else fresh.unionByName(star.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
        star = stars(edges)

    classes = reps.select("digest", "id", "copies")
    if star is not None:
        # the smallest id of a component, at every class of it
        root = classes.join(star.select(F.col("hi").alias("digest"), F.col("lo").alias("root")), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        least = root.groupBy("root").agg(F.min("id").alias("comp"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        classes = root.join(least, "root", "left").select("digest", "id", "copies", F.coalesce("comp", "id").alias("comp"))
    else:
        classes = classes.withColumn("comp", F.col("id"))
    moved = classes.where("copies > 1 or not (comp <=> id)").select("digest", "comp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    rows = all_rows.select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    own = F.coalesce("comp", "id")
    return rows.join(moved, ["digest", "salt"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), "digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """The documents that stay, one of each group, with all their columns. A row goes by its id; where
    rows of one id fare differently, or have none, by the digest of its words."""
    lost, fate, own = unused("lost_digest", docs), unused("fate", docs), unused("own_digest", docs)
    groups = stored(_groups(docs, id_col, text_col, width, percent).select(id_col, "digest", "kept"), "groups")
    losers = stored(groups.where(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("digest").alias(lost)).distinct(), "losers")
    stay = groups.where("kept").select(F.col(id_col).alias("id")).join(losers.select("id").distinct(), "id", "left_semi").distinct()
    ids = losers.select("id").distinct().where("id IS NOT NULL").join(stay.withColumn("also_kept", F.lit(True)), "id", "left")
    ids = stored(ids.select(F.col("id").alias(fate), F.coalesce("also_kept", F.lit(False)).alias("mixed")), "fates")
    mixed, named = unused("mixed", docs), F.col(id_col) == F.col(fate)
    docs_left = docs.join(ids.where("not mixed").select(fate), named, "left_anti")
    unclear = losers.join(ids.where("mixed").select(F.col(fate).alias("id")), "id", "left_semi").unionByName(losers.where("id IS NULL"))
    if unclear.isEmpty():
        return docs_left

    @F.arrow_udf("binary")
    def digest(texts: pa.Array, looked_at: pa.Array) -> pa.Array:
        pairs = zip(texts, looked_at.to_pylist(), strict=True)
        return pa.array([xxhash.xxh3_128_digest(b" ".join(sequence(t.as_py()))) if x else None for t, x in pairs], pa.binary())

    marks = unclear.select(F.col("id").alias(fate)).where(F.col(fate).isNotNull()).distinct().withColumn(mixed, F.lit(True))
    rows = docs_left.join(marks, named, "left")
    rows = rows.withColumn(own, digest(F.col(text_col), F.col(id_col).isNull() | F.col(mixed).isNotNull()))
    gone = unclear.select(F.col("id").alias(unused("lost_id", docs)), lost)
    same = F.col(id_col).eqNullSafe(F.col(gone.columns[0])) & (F.col(own) == F.col(lost))
    return rows.join(gone, same, "left_anti").select(*[F.col(c) for c in docs.columns])
