"""Greedy down-sampling: a sample is kept when at least a gap lies between it and the last kept one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def greedy_downsample(df: DataFrame, by: list[str], on: str, tie: str, gap_seconds: int) -> DataFrame:
    """Kept rows of each key. Whether a row stays depends on which stayed before, which no
    window function says; a pass over the ordered samples does. Its state is the key and the
    last kept time, so memory is bounded by a batch and the sort can spill; the samples of one
    key are read by one task."""
    gap, n = gap_seconds * 1_000_000, len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True)
            take = []
            for who, t in zip(keys, batch.column(n).to_pylist(), strict=True):
                new = who != key or last is None or t - last >= gap
                if new:
                    key, last = who, t
                take.append(new)
            yield batch.filter(pa.array(take, pa.bool_()))

    rows = df.select(*by, F.unix_micros(F.col(on).cast("timestamp")).alias("_t"), tie)
    schema = StructType([*(rows.schema[c] for c in by), StructField("_t", LongType()), rows.schema[tie]])
    kept = rows.repartition(*by).sortWithinPartitions(*by, "_t", tie).mapInArrow(run, schema)
    return kept.select(*by, F.timestamp_micros("_t").cast("timestamp_ntz").alias(on), tie)
