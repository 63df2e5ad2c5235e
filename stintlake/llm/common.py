"""Shared helpers of the training-data operators: reading, shared scratch tables, word caches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session's ``spark.checkpoint.dir``
    names it; only where that is unset, on one machine (tests), a temporary one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stintlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str = "table", row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that
    outlive any executor. Tables of very large rows name how many make a row group, since readers decode all of one at once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.block.row.count.limit": row_group} if row_group else {}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it shuffle files go when their query ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(id_col: str):
    """True where crc32 of the id's text leaves 2 modulo 4; such rows never teach a model."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, inputs: dict[str, Column], id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """The documents of at most ``rows`` labelled ids outside the held-out quarter: the columns ``inputs``,
    the label ``y`` and a hash ``k`` of the id and the first input. The ids are chosen by a hash, so the
    choice neither depends on partitioning nor grows with the corpus. Of several labels of one id the
    smallest counts. An id may have any number of rows; the second value says whether these are more
    than ``rows``, of which the first ``rows`` by ``k`` are to be taken.

    The sampled ids are at most ``rows`` pairs of numbers, which bounds the broadcast."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64(F.col("id").cast("string")), F.col("id"))
        .limit(rows)
    )
    many = docs.select(F.col(id_col).alias("id")).join(F.broadcast(picked), "id").count() > rows  # reads ids alone
    known = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in inputs.items()]).join(F.broadcast(picked), "id")
    return known.select(*inputs, "y", F.xxhash64(next(iter(inputs)), "id").alias("k")), many


class WordHashes(dict):
    """word -> crc32 of its UTF-8 bytes. At most ``limit`` words are kept; others are hashed anew."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.limit:
            self[word] = value
        return value
