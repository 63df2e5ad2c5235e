"""Sessions are released a while after their end, and corrected once if rows come later still.

The gate keeps one row a session as state. Stream time is the largest event time of the batches before;
when it has passed a session's end by ``hold``, the session is released as version 1. Rows of a released
session still count while stream time is within ``lateness`` of its end; then version 2 is emitted, if there were any, and
the session leaves the state, so state follows the open sessions and not the stream. Rows that are older than stream time by ``lateness``
are dropped.

State is a table in the target folder. A batch is combined by session, meets the state in one aggregation and is written with it as
a step: no code runs for a single session. A step counts once its clock is written, so a run that dies before leaves
the state as it was, and a batch that comes again after its step is passed over. When all that is there has been read, a last step without
rows lets stream time catch up. Steps are not deleted; the state of a step is needed until the next one is written."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLD, LATENESS = dt.timedelta(minutes=30), dt.timedelta(days=1)

OUT = ("session_id", "ends_at", "n", "total", "late", "version")
#: a step's rows: sessions with what is known of them, the version it emits, whether they stay, the largest time of the batch's own rows
STEP = "session_id string, ends_at timestamp, n long, total double, late long, released boolean, version long, open boolean, seen timestamp"
CLOCK = "step long, batch long, high long"  # stream time in microseconds


def _at(target: str, step: int, what: str) -> str:
    return f"{target}/step-{step:08d}/{what}"


def _clock(spark: SparkSession, target: str) -> tuple[int, int, int | None]:
    """(step, batch, stream time) of the last whole step."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/step-*/clock/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    last = max((int(f.getPath().getParent().getParent().getName()[5:]) for f in found), default=None)
    return (-1, -1, None) if last is None else tuple(spark.read.schema(CLOCK).parquet(_at(target, last, "clock")).first())


def _take(spark: SparkSession, target: str, rows: DataFrame | None, batch: int | None, hold: dt.timedelta, lateness: dt.timedelta) -> None:
    """One step: the rows of a batch, or none, and what is due at the stream time before them."""
    step, taken, now = _clock(spark, target)
    if batch is not None and batch <= taken:
        return
    none = spark.createDataFrame([], STEP)
    state = spark.read.schema(STEP).parquet(_at(target, step, "rows")).where("open") if step >= 0 else none
    state = state.withColumns({"seen": F.lit(None).cast("timestamp"), "fresh": F.lit(0)})
    passed = lambda end, span: F.coalesce(end + F.lit(span) <= F.timestamp_micros(F.lit(now).cast("long")), F.lit(False))
    if rows is not None:
        held = rows.where(~passed(F.col("at"), lateness))
        new = held.groupBy("session_id").agg(F.min("ends_at").alias("ends_at"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("at").alias("seen"))
        state = state.unionByName(new.withColumns({"late": F.lit(0), "released": F.lit(False), "fresh": F.col("n")}), allowMissingColumns=True)
    added = [F.sum(c).alias(c) for c in ("n", "total", "late", "fresh")]
    known = state.groupBy("session_id").agg(F.min("ends_at").alias("ends_at"), *added, F.bool_or("released").alias("released"), F.max("seen").alias("seen"))
    late = F.col("late") + F.when(F.col("released"), F.col("fresh")).otherwise(0)
    due, final = passed(F.col("ends_at"), hold), passed(F.col("ends_at"), lateness)
    version = F.when(~F.col("released") & (due | final), 1).when(F.col("released") & final & (F.col("late") > 0), 2)
    known = known.withColumn("late", late).withColumns({"version": version.cast("long"), "open": ~final, "released": F.col("released") | due})
    known.select(*none.columns).write.mode("overwrite").parquet(_at(target, step + 1, "rows"))
    seen = spark.read.schema(STEP).parquet(_at(target, step + 1, "rows")).agg(F.unix_micros(F.max("seen"))).first()[0]
    clock = (step + 1, taken if batch is None else batch, max((t for t in (now, seen) if t is not None), default=None))
    spark.createDataFrame([clock], CLOCK).coalesce(1).write.mode("overwrite").parquet(_at(target, step + 1, "clock"))


def run_gate(stream: DataFrame, target: str, hold: dt.timedelta = HOLD, lateness: dt.timedelta = LATENESS) -> DataFrame:
    """Run over all that is there of a stream (session_id string, ends_at, at, value) and return all versions emitted to ``target`` so
    far; a later run goes on from there."""
    spark = stream.sparkSession
    take = lambda rows, batch: _take(rows.sparkSession, target, rows, batch, hold, lateness)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/_log").trigger(availableNow=True).start().awaitTermination()
    _take(spark, target, None, None, hold, lateness)
    steps = [_at(target, k, "rows") for k in range(_clock(spark, target)[0] + 1)]
    return spark.read.schema(STEP).parquet(*steps).where("version is not null").select(*OUT)


def settled(versions: DataFrame) -> DataFrame:
    """Of each session the last version."""
    return versions.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "session_id"]), "version").alias("v")).select("session_id", "v.*")
