"""Join, window and merge shapes that the plans are made of. All are lazy DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder


def top1_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, tolerance_seconds: int | None = None) -> DataFrame:
    """For each left row the latest right row of the same ``by`` with ``right.on <= left.on``.

    Both sides are merged and the last right row is carried forward, so there is one shuffle on
    ``by`` and no range join. ``tie`` orders right rows of equal time; right columns come out
    prefixed with ``r_``."""
    packed = F.struct(*[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    rows = right.select(*by, on, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), packed.alias("_right"))
    rows = left.withColumns({"_side": F.lit(1), "_tie": F.lit(None)}).unionByName(rows, allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy(F.col(on).asc(), F.col("_side").asc(), F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_right", F.last("_right", ignorenulls=True).over(window)).where("_side = 1")
    if tolerance_seconds is not None:
        near = F.col(on) - F.make_dt_interval(secs=F.lit(tolerance_seconds)) <= F.col(f"_right.r_{on}")
        out = out.withColumn("_right", F.when(near, F.col("_right")))
    return out.select(*left.columns, *[F.col(f"_right.r_{c}") for c in right.columns if c not in by])


def with_interval_end(df: DataFrame, by: list[str], on: str, tie: str, name: str = "until") -> DataFrame:
    """Each row's interval ends where the next of its key starts; the last is open (null)."""
    return df.withColumn(name, F.lead(on).over(Window.partitionBy(*by).orderBy(on, tie)))


def last_in_interval(intervals: DataFrame, points: DataFrame, by: list[str], start: str, end: str, on: str, tie: str) -> DataFrame:
    """The last point within [start, end) of each interval; intervals of a key don't overlap, so
    the as-of match from a point back to its interval settles it without a range join."""
    matched = asof_join(points, intervals, by, on, start) if on == start else asof_join(points, intervals.withColumn(on, F.col(start)), by, on, tie)
    inside = matched.where(F.col(f"r_{start}").isNotNull() & (F.col(f"r_{end}").isNull() | (F.col(on) < F.col(f"r_{end}"))))
    return inside


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def keyed_merge(existing: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Upsert: of each key the row that comes first in ``version`` stays."""
    return top1_per_key(existing.unionByName(new), keys, version)


def append_unseen(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Content-addressed append: new rows whose key is not there yet, and only once."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def replace_partitions(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a partition key that ``new`` holds are replaced by its rows."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order, with the total and the next offset (null on the last page)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    nxt = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("next_offset", nxt)


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the single row of an aggregate without grouping to every row."""
    return df.crossJoin(F.broadcast(scalar))


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first


def follow_redirects(links: DataFrame, source: str, target: str) -> DataFrame:
    """The end of each redirect chain by pointer jumping: the distance covered doubles a pass, until
    no row changes, so a chain may be of any length. Each pass is checkpointed, as its plan holds
    the last one twice. A chain that runs into a cycle, which passes over as many links as there
    are make certain, ends at the smallest member of the cycle. A source has one target."""
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    now = links.select(source, target, F.least(source, target).alias("_least")).checkpoint()
    for _ in range(now.count().bit_length()):
        nxt = now.where(F.col(target).isNotNull()).select(F.col(source).alias(target), F.col(target).alias("_n"), F.col("_least").alias("_l"))
        moved = now.join(nxt, target, "left").select(source, F.coalesce("_n", target).alias(target), F.least("_least", "_l").alias("_least"), (F.col("_n") != F.col(target)).alias("_moved")).checkpoint()
        now = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    # what still points at a source has gone round a cycle, and that source is on it
    cycle = now.where(F.col(target).isNotNull()).select(F.col(source).alias(target), F.col("_least").alias("_l"))
    return now.join(cycle, target, "left").select(source, F.coalesce("_l", target).alias(target))
