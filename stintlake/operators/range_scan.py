"""Greedy down-sampling cut into time chunks, so that no task reads a whole key.

A sample is kept when it lies at least a gap after the last kept one, which depends on all choices before it.
Between chunks the dependency is narrow, though: what a chunk needs to know is which of its first samples is kept first,
and only samples within a gap of its start (and the next one) can be that. So

1. each chunk is passed once: for every sample that may be its first kept one, when the next sample may be kept after the chunk;
2. that moment is looked up in the next chunk with samples, which makes a link from a possible entry to the entry that follows;
3. entries really reached from a key's first sample are found by doubling the links, in as many passes as the
   logarithm of the number of chunks;
4. each chunk is passed once more from its entry and yields what it keeps.

Both passes are streams over sorted rows whose memory is the open entries of one chunk, at most the samples of one gap."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import durable


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, tuple, pa.RecordBatch]]:
    """(is it a new group, its key, rows) of runs of equal leading columns; a group may come in several runs."""
    last = object()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        cuts = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        for start, stop in zip(cuts, cuts[1:]):
            yield rows[start] != last, rows[start], batch.slice(start, stop - start)
            last = rows[start]


class _Walkers:
    """Possible entries of a chunk, walked forward together: those that keep the same sample go on as one.

    ``open`` holds (moment from which a sample is kept, entries), in order of the moment."""

    def __init__(self, gap: int, size: int) -> None:
        self.gap, self.size = gap, size
        self.begin()

    def begin(self) -> None:
        self.open, self.past = deque(), False

    def read(self, chunk: int, times: np.ndarray) -> None:
        border = chunk * self.size + self.gap
        for t in times.tolist():
            here = [] if self.past else [t]  # up to the first sample at or after the border
            self.past = self.past or t >= border
            while self.open and self.open[0][0] <= t:
                here += self.open.popleft()[1]
            if here:
                self.open.append((t + self.gap, here))

    def links(self) -> Iterator[tuple[int, int]]:
        for until, entries in self.open:
            yield from ((t, until) for t in dict.fromkeys(entries))


def chunked_downsample(df: DataFrame, by: list[str], on: str, tie: str, gap_seconds: float, chunk_seconds: float = 900) -> DataFrame:
    """The rows (by, on, tie) that a single pass over each key in order of (on, tie) would keep. Of rows of one
    time the first by ``tie`` counts; without a gap all rows are kept; rows without a time, none."""
    gap = round(gap_seconds * 1_000_000)
    # as fields of one column, null keys are equal in joins too
    rows = df.select(F.struct(*by).alias("_k"), F.unix_micros(F.col(on).cast("timestamp")).alias("_t"), F.col(tie).alias("_tie")).where("_t is not null")
    out = lambda kept: kept.select("_k.*", F.timestamp_micros("_t").cast("timestamp_ntz").alias(on), F.col("_tie").alias(tie))
    if gap <= 0:
        return out(rows)
    size = max(round(chunk_seconds * 1_000_000), gap)
    keys = ["_k", "_c"]
    rows = durable(rows.withColumn("_c", F.floor(F.col("_t") / size).cast("long")).select(*keys, "_t", "_tie"))
    same = [rows.schema[c] for c in keys]

    def find_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers, key = _Walkers(gap, size), None

        def closed() -> pa.RecordBatch:
            pairs = list(walkers.links())
            arrays = [pa.array([v] * len(pairs), f.type) for v, f in zip(key, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=[f"c{k}" for k in range(len(keys) + 2)])

        types = None
        for new, who, part in _groups(batches, len(keys)):
            types = types or [part.schema.field(k) for k in range(len(keys))]
            if new:
                if key is not None:
                    yield closed()
                walkers.begin()
                key = who
            walkers.read(who[-1], part.column(len(keys)).to_numpy())
        if key is not None:
            yield closed()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_t", "_tie")
    links = durable(ordered.mapInArrow(find_links, StructType([*same, StructField("_t", LongType()), StructField("_until", LongType())])))

    # the entry that follows: in the next chunk the first possible one from the moment on, else the head of the next chunk with samples
    heads = links.groupBy(*keys).agg(F.min("_t").alias("_head"))
    after = Window.partitionBy("_k").orderBy("_c")
    heads = heads.select(*keys, *[F.lead(c, n).over(after).alias(f"{c}{n}") for n in (1, 2) for c in ("_c", "_head")])
    ask = links.join(heads, keys).select("_k", F.floor(F.col("_until") / size).cast("long").alias("_c"), F.col("_until").alias("_x"), F.lit(0).alias("_side"), F.col("_t").alias("_from"), F.col("_c").alias("_of"), F.when(F.col("_c1") == F.floor(F.col("_until") / size), F.col("_head2")).otherwise(F.col("_head1")).alias("_else"))
    offer = links.select(*keys, F.col("_t").alias("_x"), F.lit(1).alias("_side"))
    upward = Window.partitionBy(*keys).orderBy(F.desc("_x"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = ask.unionByName(offer, allowMissingColumns=True).withColumn("_to", F.last(F.when(F.col("_side") == 1, F.col("_x")), True).over(upward)).where("_side = 0")
    jumps = durable(found.select("_k", F.col("_from").alias("_t"), F.coalesce("_to", "_else").alias("_to")).where("_to is not null"))

    reached = durable(rows.groupBy("_k").agg(F.min("_t").alias("_t")))
    while True:
        step = reached.join(jumps, ["_k", "_t"]).select("_k", F.col("_to").alias("_t"))
        more = durable(step.join(reached, ["_k", "_t"], "left_anti").distinct())
        if more.isEmpty():
            break
        reached = durable(reached.unionByName(more))
        onward = jumps.select("_k", F.col("_t").alias("_to"), F.col("_to").alias("_then"))
        jumps = durable(jumps.join(onward, ["_k", "_to"]).select("_k", "_t", F.col("_then").alias("_to")))

    entries = reached.withColumn("_c", F.floor(F.col("_t") / size).cast("long")).withColumnRenamed("_t", "_first")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt = None
        for new, _, part in _groups(batches, len(keys)):
            if new:
                nxt = None
            take = []
            for t, first in zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 2).to_pylist(), strict=True):
                wanted = t >= (first if nxt is None else nxt)
                if wanted:
                    nxt = t + gap
                take.append(wanted)
            yield part.filter(pa.array(take, pa.bool_()))

    ready = rows.select(*keys, "_t", "_tie").join(entries, keys).select(*keys, "_t", "_tie", "_first").repartition(*keys).sortWithinPartitions(*keys, "_t", "_tie")
    return out(ready.mapInArrow(keep, ready.schema))
