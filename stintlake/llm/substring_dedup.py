"""Substring de-duplication of word windows with a log-structured fingerprint index.

The index is a folder of immutable runs and of small manifests, so a later job opens it where the
last one stopped. A run is a table bucketed and sorted by fingerprint. Neighbouring windows
(``WINDOW`` consecutive words) that share their anchor are one entry: fingerprint, digest of all
their words, place; that is about an eighth of the entries that single windows would take. A new
batch becomes a run, is put beside the older runs bucket by bucket (no further shuffle, one sort)
and verified; ``compact`` merges runs into one, which keeps the earliest place of every entry.

A window is removed where its words also start earlier: in a document with a smaller id, or
before in the same one. An entry whose words (128-bit digest of their bytes) were seen earlier
settles all of its windows at once. Where a fingerprint occurs with several contents, the texts
are read again and single windows are compared by the digest of their words; the earliest place is
found by an aggregation that combines before the shuffle.

Batches must come in order of id: the index keeps the largest id that it has seen, and refuses a batch
that has an equal or a smaller one (among documents with a window). Defined results: null or empty text has no words; rows with the same
doc_id and text are one document read twice, so they remove nothing of each other and share one
verdict; rows with the same doc_id and other texts are documents of their own, in order of a hash
of their text; a null doc_id comes before all others; ids may be of any type that Spark orders; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchored import Roller, anchor_rows, covered, keyed, kind_of, with_places
from .common import delete_folder, scratch_root, shuffles_removed, stored

WINDOW, GRAM, PARTS = 20, 5, 3
PLACE = ("id", "k", "lo")
#: Words are hashed in pieces of at most this many bytes; a longer word is hashed by itself.
PIECE = 1 << 16


def _bytes_of(text: str | None) -> tuple[bytes, np.ndarray]:
    """The words of the text joined by one space, and where each starts (and where one more would)."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
    if not data:
        return data, np.zeros(1, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # no word holds a space
    return data, np.concatenate([[0], gaps + 1, [len(data) + 1]])


def word_hashes(data: bytes, where: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over all bytes and not word by word. Equal words
    have equal hashes; they only choose anchors, so the hashes of other words may agree too."""
    out, at = np.zeros(len(where) - 1, np.uint64), 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(where, where[at] + PIECE, "right")) - 1)
        low, high = int(where[at]), int(where[end]) - 1
        if high - low >= PIECE:
            out[at] = xxhash.xxh64_intdigest(memoryview(data)[low:high])
        else:
            piece = Roller(np.frombuffer(data, np.uint8, high - low, low).astype(np.uint64))
            out[at:end] = piece.stretch(where[at:end] - low, np.diff(where[at : end + 1]) - 1)
        at = end
    return out


def word_reader():
    def symbols(text: str | None) -> tuple[np.ndarray, bytes, np.ndarray]:
        data, where = _bytes_of(text)
        return word_hashes(data, where), data, where

    return symbols


class FingerprintIndex:
    """Runs of entries (f, c1, c2, id, k, lo, hi, copies) below ``path``, each bucketed by f.

    Manifest n names the runs that are valid after step n; the newest one counts, so a job that
    dies while it writes a run leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> None:
        self.spark, self.window, self.gram = spark, window, gram
        self.path = path or f"{scratch_root(spark)}/index-{uuid.uuid4().hex}"
        self.step, self.runs, self.tables, self.kind, self.last = 0, [], [], None, None
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that an earlier job left at ``path``."""
        last = spark.read.parquet(f"{path}/manifest-*").orderBy(F.desc("step")).first()
        index = cls(spark, path, last["window"], last["gram"], last["buckets"])
        index.step, index.runs, index.kind, index.last = last["step"], list(last["runs"]), last["kind"], last["last"]
        return index

    def _commit(self, runs: list[str]) -> None:
        self.step, self.runs = self.step + 1, runs
        row = [(self.step, runs, self.window, self.gram, self.buckets, self.kind, self.last)]
        frame = self.spark.createDataFrame(row, f"step int, runs array<string>, window int, gram int, buckets int, kind string, last {self.kind}")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self.step:06d}")

    def _schema(self) -> str:
        return f"f bigint, c1 bigint, c2 bigint, id {self.kind}, k bigint, lo bigint, hi bigint, copies bigint"

    def _write(self, rows: DataFrame, placed: bool = False) -> str:
        """A new run; ``placed`` rows are in their buckets' partitions already."""
        run, name = f"run-{uuid.uuid4().hex}", f"fingerprints_{uuid.uuid4().hex}"
        (rows if placed else rows.repartition(self.buckets, "f")).write.bucketBy(self.buckets, "f").sortBy("f", "c1", "c2").option("path", f"{self.path}/{run}").saveAsTable(name)
        self.tables.append(name)
        return run

    def _table(self, run: str) -> DataFrame:
        """A run with its buckets, through a catalogue entry that ``release`` takes away again."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self._schema()}) USING parquet CLUSTERED BY (f) SORTED BY (f, c1, c2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        self.tables.append(name)
        return self.spark.table(name)

    def release(self) -> None:
        """Drop the catalogue entries; the runs stay."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")

    def add(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take in a batch (id, k, text). Returns (spans, unsure), both written: stretches (id, k,
        lo, end) whose windows are all repeats, and the entries to be verified window by window."""
        self.kind = kind_of(texts, "id")
        run = self._write(anchor_rows(texts, word_reader, self.window, self.gram, self.window, once=True))
        batch = self._table(run)
        last = self._in_order(batch)
        # all runs lie in the same buckets, so their union needs no shuffle (no column may be added to its parts), and one sort
        # serves both windows; as batches come in order of id, entries of older runs come first and are known by their id
        rows = batch.where("copies > 0")
        for run_ in self.runs:
            rows = rows.unionByName(self._table(run_).where("copies > 0"))
        upto = F.lit(False) if self.last is None else F.coalesce(F.col("id") <= F.lit(self.last), F.lit(False))
        old = (F.col("id").isNull() | upto) if self.runs else F.lit(False)
        by_place = Window.partitionBy("f", "c1", "c2").orderBy(*PLACE)
        rows = rows.withColumns({"_n": F.row_number().over(by_place), "_rank": F.rank().over(by_place)}).withColumns({"old": old, "fresh": (F.col("_n") == 1) & ~old})
        by_anchor = Window.partitionBy("f")
        rows = rows.withColumns({"_fresh": F.count_if("fresh").over(by_anchor), "_past": F.max("old").over(by_anchor)})
        # the earliest place met again (of rank 1 too), in a row that repeats its document, is no repeat
        again = ~F.col("old") & (F.col("_rank") > 1)
        new = F.col("fresh") & ((F.col("_fresh") > 1) | F.col("_past"))
        known = F.col("old") & (F.col("_n") == 1) & (F.col("_fresh") > 0)
        rows = rows.where(again | new | known).select(*PLACE, "hi", again.alias("again"), new.alias("new"))
        copies = batch.where("copies = 0").select(*PLACE, "hi", F.lit(True).alias("again"), F.lit(False).alias("new"))
        rows = stored(rows.unionByName(copies), "repeats")
        spans = rows.where("again").select(*PLACE, (F.col("hi") + self.window).alias("end"))
        out = spans, rows.where("not again").select(*PLACE, "hi", "new")
        self.last = last
        self._commit([*self.runs, run])
        self.release()
        return out

    def _in_order(self, batch: DataFrame):
        """The largest id so far; an error where the batch doesn't follow those before it."""
        seen = batch.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n")).first()
        late = seen["nameless"] or (seen["low"] is not None and self.last is not None and seen["low"] <= self.last)
        if self.runs and seen["n"] and late:
            self.release()
            raise ValueError(f"batches must come in order of id: this one starts at {None if seen['nameless'] else seen['low']}, the index holds ids up to {self.last}")
        return self.last if seen["high"] is None else seen["high"]

    def compact(self) -> None:
        """Merge all runs into one; the earliest place of an entry stays. Old runs are deleted once
        the manifest names the new one."""
        if len(self.runs) < 2:
            return
        old, merged = self.runs, None
        for run in old:
            table = self._table(run).where("copies > 0")
            merged = table if merged is None else merged.unionByName(table)
        best = merged.repartition(self.buckets, "f").groupBy("f", "c1", "c2").agg(F.min(F.struct("id", "k", "lo", "hi", "copies")).alias("p")).select("f", "c1", "c2", "p.*")
        self._commit([self._write(best, placed=True)])
        self.release()
        for run in old:
            delete_folder(self.spark, f"{self.path}/{run}")

    def verify(self, unsure: DataFrame, texts: DataFrame) -> DataFrame:
        """Stretches (id, k, lo, end) of new windows whose words start earlier. ``texts`` holds
        the texts (id, k, text) of all batches so far."""
        wanted = unsure.groupBy("id", "k").agg(F.collect_set(F.struct("lo", "hi", "new")).alias("w")).select("id", "k", "w.lo", "w.hi", "w.new")
        both = with_places(texts, wanted, "inner").select("id", "k", "text", "lo", "hi", "new")
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    piece = batch.slice(at, 200)
                    owner, digests, starts, news = [], [], [], []
                    for row in range(piece.num_rows):
                        text, lo, hi, new = (piece.column(c)[row].as_py() for c in (2, 3, 4, 5))
                        data, where = _bytes_of(text)
                        view = memoryview(data)
                        at_ = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
                        digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(where[at_].tolist(), (where[at_ + window] - 1).tolist(), strict=True)]
                        owner.append(np.full(len(at_), row)), starts.append(at_)
                        news.append(np.repeat(np.array(new, bool), np.array(hi) - np.array(lo) + 1))
                    if owner:
                        owner, starts, news = (np.concatenate(x) for x in (owner, starts, news))
                        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner)), piece.column(1).take(pa.array(owner)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(starts), pa.array(news)], names=["id", "k", "h1", "h2", "lo", "new"])

        windows = stored(both.mapInArrow(run, f"id {kind_of(texts, 'id')}, k bigint, h1 bigint, h2 bigint, lo bigint, new boolean"), "windows")
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "p")
        return windows.where("new").join(first, ["h1", "h2"]).where(~F.struct(*PLACE).eqNullSafe(F.col("p"))).select("id", "k", "lo", (F.col("lo") + window).alias("end"))


def batches_by_id(docs: DataFrame, parts: int, id_col: str, sample: int = 1000) -> list[tuple[DataFrame, DataFrame]]:
    """``docs`` cut into about equal parts in order of id, as (part, all parts up to it); every row is
    in one part. The cuts are quantiles of the ``sample`` ids with the smallest hashes, so an
    id of any type that has an order will do. Cuts decide how even the parts are, nothing else."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(sample if parts > 1 else 0)
    known = sorted(r[0] for r in ids.collect())
    cuts = sorted({known[len(known) * k // parts] for k in range(1, parts)}) if known else []
    out, low = [], F.lit(True)
    for cut in [*cuts, None]:
        upto = F.lit(True) if cut is None else F.coalesce(F.col(id_col) <= F.lit(cut), F.lit(True))
        out.append((docs.where(low & upto), docs.where(upto)))
        low = F.lit(False) if cut is None else F.coalesce(F.col(id_col) > F.lit(cut), F.lit(False))
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text and its SHA-256."""
    arrays = spans.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("lo", "end"))).alias("s")).select("id", "k", F.col("s.lo").alias("starts"), F.col("s.end").alias("ends"))
    both = with_places(keyed(docs, id_col, text_col), arrays, "left").select("id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                total, removed, texts, digests = [], [], [], []
                for text, starts, ends in zip(*(piece.column(k) for k in (1, 2, 3)), strict=True):
                    kept, where = _bytes_of(text.as_py())
                    n, gone = len(where) - 1, 0
                    if starts.is_valid and n:
                        mask = covered(n, starts.values.to_numpy(), ends.values.to_numpy())
                        gone = int(mask.sum())
                        turns = where[np.flatnonzero(np.diff(mask, prepend=True, append=True))].tolist()
                        kept = b" ".join([kept[x : y - 1] for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    total.append(n), removed.append(gone), texts.append(kept), digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())], names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return both.mapInArrow(run, f"id {kind_of(docs, id_col)}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string").withColumnRenamed("id", id_col)


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, window: int = WINDOW, gram: int = GRAM, path: str | None = None) -> DataFrame:
    """Take ``docs`` in as ``parts`` batches by id and remove repeated windows of all of them. After
    each batch but the last the index is compacted. With ``path`` it is left there for later jobs."""
    spark = docs.sparkSession
    index, spans = FingerprintIndex(spark, path, window, gram), None
    batches = batches_by_id(docs, parts, id_col)
    with shuffles_removed(spark):
        for n, (batch, so_far) in enumerate(batches):
            sure, unsure = index.add(keyed(batch, id_col, text_col))
            more = sure.unionByName(stored(index.verify(unsure, keyed(so_far, id_col, text_col)), "spans"))
            spans = more if spans is None else spans.unionByName(more)
            if n + 1 < len(batches):
                index.compact()
    if path is None:
        delete_folder(spark, index.path)
    return remove_spans(docs, spans, id_col, text_col)
