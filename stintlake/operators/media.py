"""Pictures for stories: assets that share entities with a story, and the pictures of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: roles that show an event, and title words that speak of a role
EVENT_ROLES = ("podium", "winner", "race_start", "overtake", "incident", "pit_stop", "celebration")
ROLE_WORDS = {
    "podium": ("podium", "trophy", "champagne"),
    "winner": ("wins", "winner", "victory", "won"),
    "race_start": ("start", "turn one", "first lap"),
    "overtake": ("overtake", "passes", "battle", "fight"),
    "incident": ("crash", "collision", "contact", "spin", "incident"),
    "pit_stop": ("pit stop", "pitstop", "pit lane"),
    "strategy": ("strategy", "tyre", "tire", "undercut", "overcut"),
    "technical_detail": ("upgrade", "floor", "wing", "technical"),
    "celebration": ("celebrat", "champagne", "parc ferme"),
    "reaction": ("react", "reaction", "speaks", "says"),
}
BASE, SHARED, RACE, PERSON, TEAM, ROLE, MOST, STORIES = 45, 10, 20, 10, 5, 10, 95, 30
#: Stories of an entity beyond which it meets only together with another; the results are the same for any number.
COMMON = 1000


def role_in_title(role: Column, title: Column) -> Column:
    norm, hit = F.regexp_replace(F.lower(title), r"\s+", " "), F.lit(False)
    for name, words in ROLE_WORDS.items():
        hit = hit | ((role == name) & norm.rlike("|".join(words)))
    return F.coalesce(hit, F.lit(False))


def media_story_scores(assets: DataFrame, asset_entities: DataFrame, story_entities: DataFrame, stories: DataFrame, entities: DataFrame) -> DataFrame:
    """Scored (asset_id, story_id) for all assets at once; of each asset the thirty best stories, which
    is the feature. A pair needs a shared race or two shared entities. Merged stories are left out.

    assets (id, content_role), stories (id, title, updated_at, merged_into), entities (id, entity_type)."""
    live = stories.where("merged_into is null").select(F.col("id").alias("story_id"), "title", "updated_at")
    kind = entities.select(F.col("id").alias("entity_id"), "entity_type")

    told = story_entities.join(live.select("story_id"), "story_id", "left_semi").select("story_id", "entity_id").distinct()
    many = told.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > COMMON).select("entity_id", F.lit(True).alias("_many"))
    race = F.coalesce(F.col("entity_type") == "race", F.lit(False))
    known = kind.join(many, "entity_id", "left").select("entity_id", F.struct("entity_id", "entity_type").alias("e"), (F.coalesce("_many", F.lit(False)) & ~race).alias("common")).distinct()
    mine, theirs = asset_entities.select("asset_id", "entity_id").distinct().join(known, "entity_id").drop("entity_id"), told.join(known, "entity_id").drop("entity_id")

    def counted(rows: DataFrame) -> DataFrame:
        count = lambda name: F.count_if(F.col("e.entity_type") == name).alias(name)
        return rows.groupBy("asset_id", "story_id").agg(F.count(F.lit(1)).alias("shared"), count("race"), count("person"), count("team"))

    # entities of a bounded number of stories, and races, meet alone. A person of a third of all stories joins nothing
    # alone: common ones meet by two at once, and are looked up where something else has met
    few = counted(mine.where("not common").join(theirs.where("not common").drop("common"), "e"))
    of_asset, of_story = mine.where("common").drop("common"), theirs.where("common").drop("common")

    def two(rows: DataFrame, key: str) -> DataFrame:
        bag = rows.groupBy(key).agg(F.sort_array(F.collect_set("e")).alias("bag")).where(F.size("bag") > 1)
        return bag.select(key, F.posexplode("bag").alias("at", "first"), "bag").select(key, "first", F.explode(F.slice("bag", F.col("at") + 2, F.size("bag"))).alias("second"))

    pairs = two(of_asset, "asset_id").join(two(of_story, "story_id"), ["first", "second"]).select("asset_id", "story_id")
    met = few.join(of_story.select("story_id").distinct(), "story_id", "left_semi").select("asset_id", "story_id").unionByName(pairs).distinct()
    often = counted(met.join(of_story, "story_id").join(of_asset, ["asset_id", "e"]))
    total = [F.sum(c).cast("int").alias(c) for c in ("shared", "race", "person", "team")]
    shared = few.unionByName(often).groupBy("asset_id", "story_id").agg(*total).where("race > 0 or shared > 1")
    rows = shared.join(live, "story_id").join(assets.select(F.col("id").alias("asset_id"), "content_role"), "asset_id")
    order = Window.partitionBy("asset_id").orderBy(F.col("race").desc(), F.col("shared").desc(), F.col("updated_at").desc_nulls_first(), F.col("story_id"))
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= STORIES)
    bonus = lambda rule, value: F.when(rule, value).otherwise(0)
    race, person, team, event = F.col("race") > 0, F.col("person") > 0, F.col("team") > 0, F.col("content_role").isin(*EVENT_ROLES)
    score = BASE + F.least("shared", F.lit(3)) * SHARED + bonus(race, RACE) + bonus(person, PERSON) + bonus(team, TEAM) + bonus(role_in_title(F.col("content_role"), F.col("title")), ROLE)
    reason = F.when(race & person & event, "exact_event").when(race, "race_match").when(person | team, "entity_match").otherwise("fallback")
    return rows.select(
        "asset_id", "story_id", F.when(event | (F.col("content_role") == "race_hero"), "hero").otherwise("supporting").alias("story_role"),
        reason.alias("match_reason"), F.least(score, F.lit(MOST)).cast("int").alias("confidence"), "shared",
    )


def source_media(story_sources: DataFrame, items: DataFrame) -> DataFrame:
    """Pictures of a story's sources: story_sources (story_id, item_id, relation_type) with items (id,
    provider, source_url, title, published_at, fetched_at, image_url); ``n`` is the place."""
    rows = story_sources.join(items.withColumnRenamed("id", "item_id").where("nullif(image_url, '') is not null"), "item_id")
    primary = F.coalesce(F.col("relation_type") == "primary", F.lit(False))
    order = Window.partitionBy("story_id").orderBy(primary.desc(), F.coalesce("published_at", "fetched_at").desc_nulls_first(), F.col("item_id"))
    return rows.select(
        "story_id", "item_id", "image_url", F.col("title").alias("caption"), F.col("source_url").alias("discovery_page_url"), F.year("published_at").alias("season"),
        F.lit("hero").alias("story_role"), F.lit("source_article").alias("match_reason"), F.when(primary, 90).otherwise(80).alias("confidence"), F.row_number().over(order).alias("n"),
    )
