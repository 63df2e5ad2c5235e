"""Connected components of an edge table by alternating large and small stars.

Each pass points nodes at smaller ones until every component is a star around its smallest
node. A star is one shuffle by node and a window over its neighbours; passes are written to the
shared folder, so no lineage grows. Rows say whether their pass moved something, and the first
pass that moves nothing is the last: nothing but that answer reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(hi, lo): every node of an edge but the smallest of its component, with that smallest.
    Edges may repeat, but each copy is a row at its nodes, so callers with many copies remove them first."""
    node = Window.partitionBy("hi")
    order = node.orderBy("lo")
    all_of = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("hi"), F.col(b).alias("lo"))
    while True:
        # larger neighbours of a node go to the smallest of it and its neighbours; at a local minimum all stay
        both = now.select(F.inline(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))))
        least = F.least("hi", F.min("lo").over(node))
        large = both.select("hi", "lo", least.alias("m")).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"), (F.col("m") < F.col("hi")).alias("moved"))
        # smaller neighbours of a node, and itself, go to the smallest of them
        small = large.select("hi", "lo", F.min("lo").over(all_of).alias("m"), F.lag("lo").over(order).alias("last"), (F.bool_or("moved").over(all_of) | (F.min("lo").over(all_of) < F.max("lo").over(all_of))).alias("moved"))
        small = small.where("last IS NULL OR last < lo").select(F.when(F.col("last").isNull(), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"), "moved")
        now = stored(small, "edges")
        if now.where("moved").isEmpty():
            return now.drop("moved")
