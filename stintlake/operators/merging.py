"""Merges beyond last-wins: keep what is known, update only what may be updated, clean up, keep books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key of either side: (keys, old, new); ``updates`` has one row a key."""
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return pack(target, "old").join(pack(updates, "new"), keys, "full")


def coalescing_merge(target: DataFrame, updates: DataFrame, keys: list[str], greatest: tuple[str, ...] = (), objects: tuple[str, ...] = ()) -> DataFrame:
    """A new value replaces an old one unless it is null; of columns in ``greatest`` the larger
    value stays; map columns in ``objects`` are merged entry by entry, the new entry winning."""

    def value(c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in greatest:
            return F.greatest(old, new)
        return merged_map(old, new) if c in objects else F.coalesce(new, old)

    return _both(target, updates, keys).select(*keys, *[value(c).alias(c) for c in target.columns if c not in keys])


def merged_map(old: Column, new: Column) -> Column:
    """Entries of both maps; of an equal key the right one. A null map has none."""
    left = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.coalesce(new, F.create_map().cast("map<string,string>")), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(left, new))


def conditional_update(target: DataFrame, updates: DataFrame, keys: list[str], may_change: Column) -> DataFrame:
    """Rows for which ``may_change`` (over the target's columns) holds take all values of an update;
    others stay; keys without a row are added."""
    rest = [c for c in target.columns if c not in keys]
    rows = _both(target.withColumn("_may", F.coalesce(may_change, F.lit(False))), updates, keys)
    take = F.col("new").isNotNull() & (F.col("old").isNull() | F.col("old._may"))
    return rows.select(*keys, *[F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest])


def without_derived(derived: DataFrame, parents: DataFrame, key: str, gone: Column) -> DataFrame:
    """Derived rows but for those of parents that are gone (merged away)."""
    return derived.join(parents.where(gone).select(F.col(key)).distinct(), key, "left_anti")


def run_log(rows: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """One audit row a run: how many rows it read and how many failed, and the status that makes.
    A source that fails leaves the others as they are."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(failed).alias("rows_failed"))
    return out.withColumn("status", F.when(F.col("rows_failed") == 0, "success").when(F.col("rows_failed") < F.col("rows_read"), "partial").otherwise("failed"))
