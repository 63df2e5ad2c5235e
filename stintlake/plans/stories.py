"""Stories and calendars on the given tables: groups, primary items, entities, canonical races."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.operators import canonical, materialize

from .registry import query


@query("customer", sql="""
WITH RECURSIVE p AS (SELECT a.c_name AS l, b.c_name AS r FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 100),
reach AS (SELECT c_name AS id, c_name AS other FROM customer UNION SELECT reach.id, p.r FROM reach JOIN p ON p.l = reach.other)
SELECT id, min(other) AS story_id FROM reach GROUP BY id""")
def story_components(customer):
    """DM39, DM40: customers as items; pairs of one block with near balances are accepted, of which the links are made that join
    the same customers."""
    links = materialize.near_links(customer, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal", "c_name", 100)
    pairs = links.select("left_id", "right_id", F.lit(95).alias("score"), F.lit("multi_entity_title").alias("method"), F.lit("candidate").alias("status"))
    return materialize.story_groups(customer.select(F.col("c_name").alias("id"), F.lit("").alias("fingerprint")), pairs)


@query("part", sql="""
WITH m AS (SELECT p_size, p_partkey, p_name, p_retailprice, CASE WHEN p_brand LIKE '%1' THEN 35 WHEN p_brand LIKE '%2' THEN 30 WHEN p_brand LIKE '%3' THEN 10 ELSE 20 END
  + least(12, len(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '))) AS s FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY s DESC, p_partkey DESC) AS n, count(*) OVER (PARTITION BY p_size) AS c FROM m)
SELECT p_size, p_partkey AS primary_id, p_name AS title, c AS source_count, CASE WHEN c >= 2 THEN 'corroborated' ELSE 'tentative' END AS confidence FROM r WHERE n = 1""")
def story_primary(part):
    """DM41: parts of one size as the sources of a story, the brand as the kind of source."""
    brand, none = F.col("p_brand"), F.lit(None)
    kind = F.when(brand.endswith("1"), "first_party_team").when(brand.endswith("2"), "independent_editorial").when(brand.endswith("3"), "community_signal")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = part.select(F.col("p_size").alias("story_id"), F.col("p_partkey").alias("id"), kind.alias("source_class"), F.col("p_name").alias("title"), none.cast("string").alias("standfirst"), none.cast("string").alias("summary"), at.alias("published_at"), at.alias("fetched_at"), none.cast("string").alias("taxonomy"))
    return materialize.story_aggregates(rows).select(F.col("story_id").alias("p_size"), "primary_id", "title", "source_count", "confidence")


@query("orders", sql="""
WITH m AS (SELECT o_custkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 2 ELSE 0 END AS p, o_totalprice, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01')
SELECT o_custkey, o_orderstatus, p, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY p DESC, o_totalprice DESC, o_orderkey) AS n FROM m) WHERE n = 1""")
def strongest_mentions(orders):
    """DM41: of each story and entity the strongest relation."""
    relation = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "subject", "2-HIGH", "directly_involved", "3-MEDIUM", "affected", "5-LOW", "context")]), F.col("o_orderpriority")), F.lit("other"))
    method = F.when(F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp"), "source_context").otherwise("alias")
    rows = orders.select(F.col("o_custkey").alias("story_id"), F.col("o_orderstatus").alias("entity_id"), relation.alias("relation_type"), F.col("o_totalprice").alias("confidence"), method.alias("match_method"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("matched_alias"))
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("subject", 5, "directly_involved", 4, "affected", 3, "context", 2, "other", 0)]), F.col("relation_type"))
    return materialize.story_entities(rows).select(F.col("story_id").alias("o_custkey"), F.col("entity_id").alias("o_orderstatus"), rank.alias("p"), F.col("confidence").alias("o_totalprice"))


@query("customer", "supplier", "nation", sql="""
WITH k AS (SELECT c_custkey AS race_id, n_name, c_nationkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
known AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS e FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
SELECT race_id, CASE WHEN known.n > 1 THEN 'ambiguous_circuit' WHEN known.n = 1 THEN 'circuit' WHEN c_mktsegment = 'BUILDING' THEN 'alias' ELSE 'create' END AS method,
CASE WHEN known.n = 1 THEN known.e WHEN known.n IS NULL AND c_mktsegment = 'BUILDING' THEN 100000 END AS entity_id
FROM k LEFT JOIN known ON s_nationkey = c_nationkey""")
def canonical_races(customer, supplier, nation):
    """DM50: by circuit (the nation), else by alias (a segment), else new; ties are ambiguous."""
    calendar = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(F.col("c_custkey").alias("race_id"), F.lit(2024).alias("season"), F.col("n_name").alias("name"), F.col("c_nationkey").alias("circuit_id"), F.col("c_mktsegment").alias("circuit_name"), F.lit(None).cast("string").alias("locality"))
    known = supplier.where("s_acctbal > 9000").select(F.lit(2024).alias("season"), F.col("s_nationkey").alias("circuit_id"), F.col("s_suppkey").alias("entity_id"))
    spark = customer.sparkSession
    one = spark.range(1)
    entities = one.select(F.lit(100000).cast("long").alias("id"), F.lit("b").alias("slug"), F.lit("Building").alias("display_name"), F.lit(2020).alias("active_from"), F.lit(None).cast("int").alias("active_to"))
    aliases = one.select(F.lit(100000).cast("long").alias("entity_id"), F.lit("Building").alias("alias"), F.lit("venue").alias("alias_type"), F.lit(90).alias("confidence"), F.lit(True).alias("enabled"))
    return canonical.resolve_calendar(calendar, known, entities, aliases).select("race_id", "method", "entity_id")
