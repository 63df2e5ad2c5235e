"""Text expressions, placement, same-story pairs and pictures on texts that are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.functions import editorial as E
from stintlake.functions import placement as L
from stintlake.operators import canonical, media, stories

from .registry import query


@query("customer", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name || ' & Sons won' || CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE '.' END END AS summary,
       CASE c_mktsegment WHEN 'BUILDING' THEN c_name ELSE 'Haas F1 Team | ' || c_name END AS title, c_mktsegment IN ('BUILDING', 'MACHINERY') AS relevant FROM customer""")
def editorial_cleanup(customer):
    """ST07, ST08, ST09, ST13: entities decoded twice, promotional tails and title chrome cut, relevance."""
    tail = F.when(F.col("c_mktsegment") == "BUILDING", " Keep reading for more").when(F.col("c_mktsegment") == "MACHINERY", " - Read Also: other &lt;b&gt;things&lt;/b&gt;").otherwise("")
    raw = F.when(F.col("c_acctbal") < 0, "<p>&nbsp;</p>").otherwise(F.concat(F.lit("<p>"), F.col("c_name"), F.lit("&nbsp;&amp;amp; Sons<br/> won."), tail, F.lit("</p>")))
    source = F.when(F.col("c_mktsegment") == "BUILDING", "team_haas").otherwise("other")
    text = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "the F1 race ").when(F.col("c_mktsegment") == "MACHINERY", "Formula  One ").otherwise("F10 model "), F.col("c_name"))
    return customer.select("c_custkey", E.clean_summary(raw).alias("summary"), E.title_without_chrome(source, F.concat(F.lit("Haas F1 Team | "), F.col("c_name"))).alias("title"), E.is_relevant(text).alias("relevant"))


@query("orders", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'ICA-' || year(o_orderdate) || '-01,ICA-' || year(o_orderdate) || '-07-11' END AS refs,
       CASE o_orderstatus WHEN 'O' THEN d + INTERVAL 12 HOUR WHEN 'P' THEN d + INTERVAL 13 HOUR END AS at
FROM (SELECT *, CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END AS d FROM orders)""")
def document_cues(orders):
    """ST12, DT03: sorted distinct reference numbers and local moments of documents, whose
    years have two digits and lie in this century."""
    year = F.date_format("o_orderdate", "yyyy")
    refs = F.when(F.col("o_orderstatus") == "F", "ICA-12-1 only").otherwise(F.concat(F.lit("see ica-"), year, F.lit("-07-11, ICA-"), year, F.lit("-01; Ica-"), year, F.lit("-01.")))
    zone = F.when(F.col("o_orderstatus") == "O", "CEST").when(F.col("o_orderstatus") == "P", "CET").otherwise("BST")
    moment = F.concat(F.lit("published "), F.date_format("o_orderdate", "dd.MM.yy"), F.lit(" 14:00 "), zone)
    return orders.select("o_orderkey", F.array_join(E.reference_ids(refs), ",").alias("refs"), E.local_moment(moment).cast("timestamp_ntz").alias("at"))


@query("part", sql="""
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'The ' || p_name || ' was fitted to the car on Friday. A quite different matter was discussed by engineers.'
                       WHEN p_size <= 30 THEN 'The ' || p_name || ' was fitted to the car on Friday.' END AS summary FROM part""")
def summaries(part):
    """ST20: the first long sentence of each text that is unlike those taken before, two in all."""
    one = F.concat(F.lit("Short. The "), F.col("p_name"), F.lit(" was fitted to the car on Friday. More words follow here and there."))
    same = F.concat(F.lit("The "), F.col("p_name"), F.lit(" was fitted to the car on friday! "))
    other = F.when(F.col("p_size") <= 10, F.concat(same, F.lit("A quite different matter was discussed by engineers."))).otherwise(same)
    texts = F.when(F.col("p_size") <= 30, F.array(one, other)).otherwise(F.array(F.lit("Tiny."), F.lit("None.")))
    return part.select("p_partkey", E.extractive_summary(texts).alias("summary"))


@query("orders", sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'lap' WHEN '2-HIGH' THEN 'stint' WHEN '3-MEDIUM' THEN 'segment' WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'O' THEN 'race' ELSE 'timestamp' END ELSE 'session' END AS precision,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'race' WHEN '2-HIGH' THEN 'race' WHEN '3-MEDIUM' THEN 'qualifying' WHEN '4-NOT SPECIFIED' THEN 'practice_1' END AS session_code,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 12 END AS lap_number, CASE WHEN o_orderpriority = '2-HIGH' THEN 2 END AS stint_number, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'q2' END AS segment_code,
       CASE o_orderpriority WHEN '1-URGENT' THEN 98 WHEN '2-HIGH' THEN 96 WHEN '3-MEDIUM' THEN 98 WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'O' THEN 94 ELSE 80 END ELSE 96 END AS confidence,
       CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'O' THEN 'applies_to' ELSE 'reported_at' END ELSE 'occurred_at' END AS temporal_relation, year(o_orderdate) AS season FROM orders""")
def placements(orders):
    """DM43, ST18: where a story belongs on the timeline, by the finest cue of its text."""
    p, season = F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "O", F.year("o_orderdate"))
    text = F.when(p == "1-URGENT", "Pit stop drama on lap 12 of the race").when(p == "2-HIGH", "Safety car spoils the second stint").when(p == "3-MEDIUM", "Out in Q2 again").when(p == "5-LOW", "Team news of the week").otherwise("Notes from FP1")
    made = L.placement(text, F.lit("news"), F.col("o_orderdate"), season, F.lit(None).cast("timestamp_ntz"), 2024)
    rows = orders.select("o_orderkey", made.alias("p"))
    return rows.select("o_orderkey", *[F.col(f"p.{c}").alias(c) for c in ("precision", "session_code", "lap_number", "stint_number", "segment_code", "confidence", "temporal_relation", "season")])


@query("orders", sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2026 WHEN '2-HIGH' THEN 2025 END AS season, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 2008 END AS past,
       CASE o_orderstatus WHEN 'F' THEN 'calendar_announcement:2026' WHEN 'O' THEN 'personnel_appointment:aston_martin:technical_leadership' END AS event FROM orders""")
def season_cues(orders):
    """ST17, ST19: years tied to the sport and not to another series close by; anniversaries; named events."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    text = F.when(p == "1-URGENT", "The 2026 F1 season opens").when(p == "2-HIGH", "Rules for 2025 are set").when(p == "3-MEDIUM", "On this day in 2008").when(p == "5-LOW", "The 2024 season of Formula 2").otherwise("In 2023 nothing")
    title = F.when(s == "F", "F1 calendar 2026 out").when(s == "O", "Aston Martin hires technical chief").otherwise("Calendar 2026 out")
    return orders.select("o_orderkey", L.stated_season(text).alias("season"), L.historical_year(text).alias("past"), stories.event_fingerprint(title).alias("event"))


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('a','an','and','are','as','at','for','from','in','is','of','on','the','to','with')))"


@query("supplier", "part", sql=f"""
WITH i AS (SELECT p_partkey AS id, p_brand AS provider, p_name || ' ' || p_type || ' of ' || p_size AS title, TIMESTAMP '2024-01-01' + p_partkey * INTERVAL 7 HOUR AS at, p_type || p_size AS strong, p_size AS race FROM part),
t AS (SELECT *, {_TOKENS.format('title')} AS words FROM i),
p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS s, a.title = b.title AS same, abs(epoch(a.at) - epoch(b.at)) <= 72 * 3600 AS close,
             (a.strong = b.strong)::INT AS n, (a.race = b.race)::INT AS r
      FROM t a JOIN t b ON a.id < b.id AND a.provider <> b.provider AND (a.title = b.title OR (abs(epoch(a.at) - epoch(b.at)) <= 86400 * 28 AND (a.strong = b.strong OR a.race = b.race)
           AND abs(floor(epoch(a.at) / 86400 / 14) - floor(epoch(b.at) / 86400 / 14)) <= 1))),
c AS (SELECT *, CASE WHEN same THEN 100 WHEN NOT close THEN NULL WHEN n >= 1 AND s >= 0.40 THEN least(94, 86 + least(6, greatest(0, round_even((s - 0.40) * 15, 0)::INT)))
             WHEN n >= 1 AND r >= 1 AND s >= 0.12 THEN least(90, 84 + least(4, greatest(0, round_even((s - 0.12) * 20, 0)::INT))) WHEN s >= 0.9 AND r >= 1 THEN 90 END AS score FROM p)
SELECT left_id, right_id, score, CASE WHEN same THEN 'exact_title' WHEN n >= 1 AND s >= 0.40 THEN 'single_entity_title' WHEN n >= 1 AND r >= 1 AND s >= 0.12 THEN 'entity_race_title' ELSE 'title_race' END AS method FROM c WHERE score IS NOT NULL""")
def story_pairs(supplier, part):
    """DM37, ST04, AJ06, DT05: scored pairs of items of different providers that may tell one story."""
    items = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("provider"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" of "), F.col("p_size").cast("string")).alias("title"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("p_partkey") * 7).cast("int"))).alias("published_at"), F.array(F.concat("p_type", F.col("p_size").cast("string"))).alias("strong"), F.array(F.col("p_size").cast("string")).alias("races"),
    )
    return stories.same_story_pairs(items).select("left_id", "right_id", "score", "method")


@query("lineitem", "part", "orders", "supplier", sql="""
WITH k AS (SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'race' WHEN p_size <= 25 THEN 'person' ELSE 'team' END AS kind FROM part),
ae AS (SELECT DISTINCT l_suppkey AS asset_id, l_partkey AS e FROM lineitem WHERE l_returnflag = 'A'), se AS (SELECT DISTINCT l_orderkey AS story_id, l_partkey AS e FROM lineitem),
s AS (SELECT asset_id, story_id, count(*) AS shared, count(*) FILTER (kind = 'race') AS race, count(*) FILTER (kind = 'person') AS person, count(*) FILTER (kind = 'team') AS team FROM ae JOIN se USING (e) JOIN k ON p_partkey = e GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'race') > 0 OR count(*) >= 2),
r AS (SELECT s.*, o_orderpriority, row_number() OVER (PARTITION BY asset_id ORDER BY race DESC, shared DESC, o_orderdate DESC NULLS FIRST, story_id) AS n FROM s JOIN orders ON o_orderkey = story_id WHERE o_orderstatus <> 'P')
SELECT asset_id, story_id, CASE WHEN s_nationkey < 12 THEN 'hero' ELSE 'supporting' END AS story_role,
       CASE WHEN race > 0 AND person > 0 AND s_nationkey < 12 THEN 'exact_event' WHEN race > 0 THEN 'race_match' ELSE 'entity_match' END AS match_reason,
       least(95, 45 + least(shared, 3) * 10 + 20 * (race > 0)::INT + 10 * (person > 0)::INT + 5 * (team > 0)::INT + 10 * (s_nationkey < 12 AND o_orderpriority = '1-URGENT')::INT)::INT AS confidence, shared
FROM r JOIN supplier ON s_suppkey = asset_id WHERE n <= 30""")
def media_matches(lineitem, part, orders, supplier):
    """DM47, JN20, DX38, DX39, AJ04: pictures (suppliers) for stories (orders) by shared entities (parts)."""
    size = F.col("p_size")
    kinds = part.select(F.col("p_partkey").alias("id"), F.when(size <= 3, "race").when(size <= 25, "person").otherwise("team").alias("entity_type"))
    of_assets = lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("asset_id"), F.col("l_partkey").alias("entity_id")).distinct()
    of_stories = lineitem.select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("entity_id")).distinct()
    told = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "Driver on the Podium").otherwise("Quiet day").alias("title"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") == "P", 1).alias("merged_into"))
    assets = supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 12, "podium").otherwise("portrait").alias("content_role"))
    return media.media_story_scores(assets, of_assets, of_stories, told, kinds)


@query("lineitem", "part", sql="""
WITH r AS (SELECT DISTINCT l_orderkey AS story_id, l_partkey AS item_id, l_linenumber, l_suppkey, l_quantity > 25 AS main FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 5),
u AS (SELECT story_id, item_id, bool_or(main) AS main FROM r GROUP BY 1, 2)
SELECT story_id, item_id, p_name AS caption, CASE WHEN main THEN 90 ELSE 80 END AS confidence, row_number() OVER (PARTITION BY story_id ORDER BY main DESC, p_size DESC, item_id) AS n FROM u JOIN part ON p_partkey = item_id""")
def source_pictures(lineitem, part):
    """DM48: the pictures of a story's sources, the primary source first."""
    main = F.max((F.col("l_quantity") > 25).cast("int"))
    sources = lineitem.groupBy(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("item_id")).agg(F.when(main == 1, "primary").otherwise("supporting").alias("relation_type"))
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size"))
    items = part.select(F.col("p_partkey").alias("id"), F.lit("x").alias("provider"), F.lit("u").alias("source_url"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 20, at).alias("published_at"), at.alias("fetched_at"), F.when(F.col("p_size") > 5, "http://i").otherwise("").alias("image_url"))
    return media.source_media(sources, items).select("story_id", "item_id", "caption", "confidence", "n")
