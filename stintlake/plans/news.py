"""What news items name and whether they make a story, on items that are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.functions import editorial as E
from stintlake.operators.mentions import classify_items

from .registry import query


@query("customer", "nation", "region", sql="""
WITH i AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal < 0 AS own, n_nationkey AS n, n_name AS team, n_regionkey + 100 AS p, r_name AS person FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT c_custkey, own, n AS entity_id, CASE seg WHEN 'FURNITURE' THEN 'mentioned' WHEN 'HOUSEHOLD' THEN 'mentioned' ELSE 'directly_involved' END AS relation_type, CASE seg WHEN 'HOUSEHOLD' THEN 90 WHEN 'MACHINERY' THEN 92 ELSE 97 END AS confidence,
        CASE seg WHEN 'HOUSEHOLD' THEN 'body_excerpt' WHEN 'MACHINERY' THEN 'standfirst' ELSE 'title' END || '_alias' AS match_method, team AS matched_alias, CASE seg WHEN 'HOUSEHOLD' THEN 'body_excerpt' WHEN 'MACHINERY' THEN 'standfirst,summary' ELSE 'title' END AS detected_in FROM i
      UNION ALL SELECT c_custkey, own, p, CASE WHEN seg = 'HOUSEHOLD' AND p <> 103 THEN 'mentioned' ELSE 'subject' END, 95, 'title_alias', person, 'title' FROM i WHERE seg <> 'MACHINERY'
      UNION ALL SELECT c_custkey, own, 103, 'subject', 95, 'title_alias', 'EUROPE', 'title' FROM i WHERE seg = 'HOUSEHOLD' AND p <> 103
      UNION ALL SELECT c_custkey, own, 201, 'context', 100, 'title_alias', 'Harbour Grand Prix', 'title' FROM i WHERE seg = 'MACHINERY')
SELECT c_custkey, entity_id, relation_type, confidence, match_method, matched_alias, detected_in FROM m
UNION ALL SELECT c_custkey, 0, 'context', 100, 'source_context', 'NATION_0', 'source' FROM i WHERE own AND n <> 0""")
def item_entities(customer, nation, region):
    """DM36, DM35, AG22, ST24, ST25, DX34, DX35: people (regions), teams (nations) and a race that each item (a
    customer) names in its four texts, with relation and confidence; the source's own team as context."""
    rows = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    is_ = {s: F.col("c_mktsegment") == s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")}
    team, person = F.col("n_name"), F.col("r_name")
    title = F.when(is_["AUTOMOBILE"], F.concat(team, F.lit(" driver praises "), person)).when(is_["BUILDING"], F.concat(person, F.lit(" joins "), team)).when(is_["FURNITURE"], F.concat(person, F.lit(", formerly quiet, of ex "), team))
    title = title.when(is_["MACHINERY"], "A day at the Harbour Grand Prix 2027").otherwise(F.concat(F.lit("EUROPE speaks after "), person, F.lit(" setback")))
    nothing, year = F.lit(None).cast("string"), F.lit(None).cast("int")
    items = rows.select(
        F.col("c_custkey").alias("item_id"), title.alias("title"), F.when(is_["MACHINERY"], team).alias("standfirst"), F.when(is_["MACHINERY"], F.concat(F.lit("By "), team)).alias("summary"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("a word of "), team)).alias("body_excerpt"), F.lit(2026).alias("season"), year.alias("race_season"), F.when(F.col("c_acctbal") < 0, "nation-0").alias("source_context_team_slug"),
    )

    def entity(df, id_, kind, name, alias, confidence, first, last):
        slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
        return df.select(id_.alias("entity_id"), F.lit(kind).alias("entity_type"), slug.alias("slug"), name.alias("display_name"), alias.alias("alias"), nothing.alias("alias_type"), F.lit(confidence).alias("confidence"), first.alias("valid_from_season"), last.alias("valid_to_season"))

    teams = entity(nation, F.col("n_nationkey"), "team", team, team, 92, F.lit(2020), year)
    people = entity(region, F.col("r_regionkey") + 100, "person", person, person, 90, year, year)
    harbour = F.lit("Harbour Grand Prix")
    races = region.where("r_regionkey < 2")
    # one edition a season; the title names the next season's
    races = entity(races, F.col("r_regionkey") + 200, "race", harbour, harbour, 99, F.col("r_regionkey") + 2026, F.col("r_regionkey") + 2026)
    found = classify_items(items, teams.unionByName(people).unionByName(races))
    return found.select(F.col("item_id").alias("c_custkey"), "entity_id", "relation_type", "confidence", "match_method", "matched_alias", F.array_join("detected_in", ",").alias("detected_in"))


@query("orders", sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'non_story_container' WHEN '2-HIGH' THEN CASE WHEN o_orderstatus = 'F' THEN 'first_party_evergreen_or_promo' WHEN o_orderstatus = 'P' THEN 'community_without_strong_entity' ELSE 'article_default_v2' END
  WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN 'first_party_destination_content' WHEN o_orderstatus = 'P' THEN 'community_without_strong_entity' ELSE 'article_default_v2' END
  ELSE CASE WHEN o_orderstatus <> 'P' THEN 'article_default_v2' WHEN o_orderpriority = '5-LOW' THEN 'community_with_strong_entity' ELSE 'community_without_strong_entity' END END AS reason,
  o_orderpriority <> '1-URGENT' AND CASE WHEN o_orderstatus = 'F' THEN o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') WHEN o_orderstatus = 'P' THEN o_orderpriority = '5-LOW' ELSE true END AS worthy FROM orders""")
def story_worthiness(orders):
    """ST16: whether an item makes a story, and why not."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    title = F.when(p == "1-URGENT", "Daily Discussion Thread: Friday").when(p == "2-HIGH", "Time Pieces of the season").when(p == "3-MEDIUM", "Explore Rome with us").otherwise("Upgrade brings pace")
    source = F.when(s == "F", "first_party_team").when(s == "P", "community_signal").otherwise("independent_editorial")
    relations = F.when(p == "5-LOW", F.array(F.lit("mentioned"), F.lit("subject"))).when(p != "2-HIGH", F.array(F.lit("mentioned")))
    reason = E.story_reason(title, source, relations)
    return orders.select("o_orderkey", reason.alias("reason"), E.is_story(reason).alias("worthy"))
