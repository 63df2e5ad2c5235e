"""Ingestion views: merges, snapshots, partition replacement, incremental plans, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.operators.core import append_unseen, keyed_merge, replace_partitions
from stintlake.streaming.incremental import merged_stream, stream_counts

from .registry import QUERIES, query


@query("orders", sql="""
WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS v FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey, o_totalprice, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, o_orderkey DESC) AS n FROM u) WHERE n = 1""")
def keyed_merge_orders(orders):
    """SNK01-03, TS03: upsert; the new version of a key wins. Finished orders arrive again, corrected."""
    cols = ["o_custkey", "o_orderkey", "o_totalprice"]
    old = orders.select(*cols, F.lit(0).alias("v"))
    new = orders.where("o_orderstatus = 'F'").select(*cols[:2], (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("v"))
    return keyed_merge(old, new, ["o_custkey"], [F.col("v").desc(), F.col("o_orderkey").desc()])


@query("orders", sql="""
WITH h AS (SELECT o_custkey, year(o_orderdate) AS season, sha256(o_custkey || '|' || year(o_orderdate) || '|' || o_orderstatus) AS hash, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders)
SELECT hash, max(old::INT)::INT AS was_there FROM h GROUP BY hash""")
def snapshot_dedup(orders):
    """SNK05, ST21: content-addressed append; a hash that is there is not stored again."""
    h = orders.select(F.sha2(F.concat_ws("|", "o_custkey", F.year("o_orderdate"), "o_orderstatus"), 256).alias("hash"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).alias("old"))
    stored = h.where("old").select("hash").distinct().withColumn("was_there", F.lit(1))
    return append_unseen(stored, h.where("not old").select("hash", F.lit(0).alias("was_there")), ["hash"])


@query("lineitem", sql="""
WITH new AS (SELECT l_orderkey, l_quantity + 100 AS q FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R')
SELECT l_orderkey, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def replace_partition(lineitem):
    """SNK04: a partition that arrives replaces all of its old rows."""
    new = lineitem.where("l_linenumber = 1 and l_returnflag = 'R'").select("l_orderkey", (F.col("l_quantity") + 100).alias("q"))
    return replace_partitions(lineitem.select("l_orderkey", F.col("l_quantity").alias("q")), new, ["l_orderkey"])


@query("orders", sql="""
WITH c AS (SELECT DISTINCT year(o_orderdate) AS season, month(o_orderdate) AS round FROM orders), d AS (SELECT DISTINCT year(o_orderdate) AS season, month(o_orderdate) AS round FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT season, max(round) AS round FROM c GROUP BY 1)
SELECT * FROM (SELECT * FROM c EXCEPT SELECT * FROM d) UNION SELECT * FROM l""")
def incremental_plan(orders):
    """SL06, SO05, DM52, TS05: rounds not fetched yet, and always the latest."""
    key = [F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")]
    c = orders.select(*key).distinct()
    latest = c.groupBy("season").agg(F.max("round").alias("round"))
    return c.join(orders.where("o_orderstatus = 'P'").select(*key).distinct(), ["season", "round"], "left_anti").union(latest).distinct()


QUERIES["streaming_merge"] = merged_stream
QUERIES["streaming_windows"] = stream_counts
