"""Lookups: optional predicates, natural keys or ids, names before aliases, exclusive nearest pairs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows that equal every value given; a column whose value is None isn't looked at. The filter is
    built from plain comparisons, so it reaches the scan."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def by_key_or_id(requests: DataFrame, entities: DataFrame, key: str, slug: str, id_col: str) -> DataFrame:
    """Requests with the entity whose slug, or else whose id as text, is the requested ``key``: two
    equi-joins folded into one, instead of a join on a disjunction."""
    names = entities.select(F.col(slug).alias("_k"), F.lit(0).alias("_p"), F.col(id_col).alias("_id"))
    names = names.unionByName(entities.select(F.col(id_col).cast("string").alias("_k"), F.lit(1).alias("_p"), F.col(id_col).alias("_id")))
    best = names.groupBy("_k").agg(F.min(F.struct("_p", "_id")).alias("_best"))
    rows = requests.join(best.withColumnRenamed("_k", key), key, "left").withColumn("_found", F.col("_best._id")).drop("_best")
    return rows.join(entities, F.col("_found") == F.col(id_col), "left").drop("_found")


def by_name_or_alias(mentions: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """mentions with ``entity_id`` of names (entity_id, name, preference) that equal them but for case and
    outer space; the smallest preference wins, then the smallest id."""
    lookup = names.select(F.lower(F.trim("name")).alias("_n"), "preference", "entity_id").groupBy("_n").agg(F.min(F.struct("preference", "entity_id")).alias("_b"))
    return mentions.withColumn("_n", F.lower(F.trim(column))).join(lookup, "_n", "left").withColumns({"entity_id": F.col("_b.entity_id"), "preference": F.col("_b.preference")}).drop("_n", "_b")


def valid_alias(mentions: DataFrame, aliases: DataFrame, key: str, season: str) -> DataFrame:
    """mentions with the aliases of their key that are valid in their season; an open end is null."""
    at = F.col(season)
    return mentions.join(aliases, key).where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at <= F.col("valid_to"))))


def exclusive_nearest(left: DataFrame, right: DataFrame, by: str, on: str, hours: float) -> DataFrame:
    """Pairs (left_id, right_id) of rows (by, id, on) within ``hours``: of each ``by`` the left rows, in
    order of time and id, each take the nearest right row still free.

    The rows are read once in order of time. A left row is settled when all right rows that it may take have been
    read, and right rows that none can take any more are forgotten, so a task holds what lies within twice
    ``hours`` of one time and not its whole group. Rows without a time take and give nothing."""
    rows = left.select(by, F.col("id"), F.col(on).alias("at"), F.lit(0).alias("side")).unionByName(right.select(by, F.col("id"), F.col(on).alias("at"), F.lit(1).alias("side")))
    kind = dict(rows.dtypes)["id"]
    rows = rows.where("at is not null").select(by, F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "side", "id")
    reach = round(hours * 3_600_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple[int, object]] = deque()
        free: list[tuple[int, object]] = []
        group = object()

        def settled(until: int | None) -> Iterator[tuple[object, object]]:
            while waiting and (until is None or waiting[0][0] + reach < until):
                t, own = waiting.popleft()
                while free and free[0][0] < t - reach:
                    free.pop(0)
                near = [(abs(x - t), n) for n, (x, _) in enumerate(free) if x <= t + reach]
                if near:
                    yield own, free.pop(min(near)[1])[1]

        id_type = None
        for batch in batches:
            id_type, pairs = batch.schema.field(3).type, []
            for who, t, side, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if who != group:
                    pairs += settled(None)
                    free.clear()
                    group = who
                pairs += settled(t)
                (free if side else waiting).append((t, name))
            yield pa.RecordBatch.from_arrays([pa.array(x, id_type) for x in (list(zip(*pairs, strict=True)) or [[], []])], names=["left_id", "right_id"])
        pairs = list(settled(None))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, id_type) for x in zip(*pairs, strict=True)], names=["left_id", "right_id"])

    return rows.repartition(by).sortWithinPartitions(by, "t", "side", "id").mapInArrow(run, f"left_id {kind}, right_id {kind}")


def nested_top(outer: DataFrame, inner: DataFrame, key: str, link: str, outer_order: list[Column], inner_order: list[Column]) -> DataFrame:
    """Of each ``key`` the first outer row, and of that one the first inner row (joined on ``link``): the inner
    choice is made for chosen outer rows only."""
    first = outer.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*outer_order))).where("_r = 1").drop("_r")
    rows = first.join(inner, link, "left")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*inner_order))).where("_r = 1").drop("_r")
