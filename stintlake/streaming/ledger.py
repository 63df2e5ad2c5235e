"""Bounded, resumable loads of an inbox of files, each on its own.

A stream lists the inbox, a few files a micro-batch. A file that can't be read, or lacks a column, is recorded as failed and
the others of its batch are loaded; nothing of a failed file is taken in. Rows are merged into a keyed table whose
keys are spread over buckets by hash, and only the buckets that a batch touches are written again. A batch's rows go to a
folder of their own, then its ledger is written, with where the newest rows of each bucket are; a ledger counts once it is
written whole, so a run that dies between the two leaves the table as it was, and the batch is done again."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stintlake.operators.core import keyed_merge

FILES, BUCKETS = 2, 16
LEDGER = "source string, batch long, state string, rows long, error string"
PLACES = "bucket int, batch long"


@dataclass(frozen=True)
class Inbox:
    """Where files come from and go to, and what a row is known by: of rows of one key the largest ``version`` stays."""

    folder: str
    target: str
    schema: StructType
    keys: tuple[str, ...]
    version: str
    files: int = FILES
    buckets: int = BUCKETS


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _last(spark: SparkSession, inbox: Inbox) -> int | None:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{inbox.target}/batch-*/places/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return max((int(f.getPath().getParent().getParent().getName()[6:]) for f in found), default=None)


def _at(inbox: Inbox, batch: int, what: str) -> str:
    return f"{inbox.target}/batch-{batch:08d}/{what}"


def ledger(spark: SparkSession, inbox: Inbox) -> DataFrame:
    """(source, batch, state, rows, error) of every file that a finished batch has seen."""
    last = _last(spark, inbox)
    return spark.createDataFrame([], LEDGER) if last is None else spark.read.schema(LEDGER).parquet(*[_at(inbox, b, "ledger") for b in range(last + 1)])


def _places(spark: SparkSession, inbox: Inbox, last: int | None) -> dict[int, int]:
    """bucket -> the batch that wrote it last: at most ``buckets`` rows."""
    return {} if last is None else {r.bucket: r.batch for r in spark.read.schema(PLACES).parquet(_at(inbox, last, "places")).collect()}


def _rows(spark: SparkSession, inbox: Inbox, places: dict[int, int]) -> DataFrame:
    paths = [f"{_at(inbox, batch, 'rows')}/_bucket={bucket}" for bucket, batch in sorted(places.items())]
    return spark.read.schema(inbox.schema).parquet(*paths) if paths else spark.createDataFrame([], inbox.schema)


def loaded(spark: SparkSession, inbox: Inbox) -> DataFrame:
    """The keyed table after the last finished batch."""
    return _rows(spark, inbox, _places(spark, inbox, _last(spark, inbox)))


def _take_in(spark: SparkSession, inbox: Inbox, source: str, staged: str) -> tuple[str, int, str | None]:
    """Copy one file to the batch's folder: (state, rows, error)."""
    try:
        found = spark.read.parquet(source)
        missing = sorted(set(inbox.schema.names) - set(found.columns))
        if missing:
            return "failed", 0, f"missing columns: {', '.join(missing)}"
        found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in inbox.schema]).write.mode("overwrite").parquet(staged)
        return "loaded", spark.read.parquet(staged).count(), None
    except PySparkException as error:  # recorded, and the next file is read
        return "failed", 0, error.getCondition() or type(error).__name__
    except Py4JJavaError as error:
        return "failed", 0, error.java_exception.getClass().getName()


def load_batch(spark: SparkSession, inbox: Inbox, sources: list[str], batch: int) -> None:
    """Take in at most a few files as batch number ``batch``; a batch that is finished is left alone."""
    last = _last(spark, inbox)
    if last is not None and batch <= last:
        return
    places = _places(spark, inbox, last)
    notes, parts = [], []
    for n, source in enumerate(sorted(sources)):
        staged = _at(inbox, batch, f"staged-{n}")
        state, rows, error = _take_in(spark, inbox, source, staged)
        notes.append((source, batch, state, rows, error))
        if state == "loaded":
            parts.append(staged)
    if parts:
        places = _merge(spark, inbox, spark.read.schema(inbox.schema).parquet(*parts), batch, places)
    spark.createDataFrame(notes, LEDGER).coalesce(1).write.mode("overwrite").parquet(_at(inbox, batch, "ledger"))
    _finish(spark, inbox, batch, places)


def _merge(spark: SparkSession, inbox: Inbox, new: DataFrame, batch: int, places: dict[int, int]) -> dict[int, int]:
    """Write the buckets that the new rows touch, merged with what they held; ``new`` is read twice. Returns where buckets are now."""
    bucket = F.pmod(F.xxhash64(*inbox.keys), F.lit(inbox.buckets)).cast("int")
    touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
    old = _rows(spark, inbox, {b: places[b] for b in touched if b in places})
    # rows of one version are told apart by all their columns, so a batch that is done again makes the same choice
    order = [F.col(inbox.version).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in inbox.schema.names if c not in (*inbox.keys, inbox.version)]]
    merged = keyed_merge(old, new, list(inbox.keys), order).withColumn("_bucket", bucket)
    merged.write.mode("overwrite").partitionBy("_bucket").parquet(_at(inbox, batch, "rows"))
    return places | {b: batch for b in touched}


def _finish(spark: SparkSession, inbox: Inbox, batch: int, places: dict[int, int]) -> None:
    spark.createDataFrame(list(places.items()), PLACES).coalesce(1).write.mode("overwrite").parquet(_at(inbox, batch, "places"))


def merge_batch(spark: SparkSession, inbox: Inbox, new: DataFrame, batch: int) -> None:
    """Merge rows that a stream delivers as batch number ``batch``; a batch that is finished is left alone."""
    last = _last(spark, inbox)
    if last is None or batch > last:
        _finish(spark, inbox, batch, _merge(spark, inbox, new, batch, _places(spark, inbox, last)))


class Enough(Exception):
    """The run has done its batches; the one at hand is left to the next run."""


def run_inbox(spark: SparkSession, inbox: Inbox, batches: int | None = None) -> DataFrame:
    """Load what is new in the inbox, ``files`` files a batch, up to ``batches`` of them, and return the keyed table. A run that
    was cut short is gone on with by the next; files that came meanwhile are found too."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    listing = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", inbox.files).load(inbox.folder).select("path")
    done = 0

    def load(paths: DataFrame, batch: int) -> None:
        nonlocal done
        if batches is not None and done >= batches:
            raise Enough
        load_batch(spark, inbox, [r.path for r in paths.collect()], batch)  # at most ``files`` names
        done += 1

    query = listing.writeStream.foreachBatch(load).option("checkpointLocation", f"{inbox.target}/_log").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except PySparkException:
        if batches is None or done < batches:
            raise
    return loaded(spark, inbox)
