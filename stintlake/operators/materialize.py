"""Stories from source items: accepted pairs and shared event identities join items into one story.

Item by item, attaching to the best neighbour and merging the stories that meet ends where
the connected components of the accepted pairs end, in any order of arrival; so the components
are computed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.functions.editorial import sentences

from .core import top1_per_key
from .shared import durable

# fixed values: scores that accept a pair, weights of source classes and of relations, title openings
AUTO_SCORE, EVENT_SCORE, EVENT_METHOD = 94, 88, "event_fingerprint"
SOURCE_WEIGHT = {"first_party_team": 35, "independent_editorial": 30, "community_signal": 10}
OTHER_SOURCE, MOST_WORDS, CLIP_PENALTY = 20, 12, 4
CLIPS = ("video ", "social media ", "watch ")
RELATIONS = ("mentioned", "context", "affected", "directly_involved", "subject")
SAME_SENTENCE = 0.72


def accepted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, score, method, status) that join: accepted by hand, or a candidate
    with a high score; an event identity needs less. Rejected pairs never join."""
    strong = (F.col("score") >= AUTO_SCORE) | (F.col("method").startswith(EVENT_METHOD) & (F.col("score") >= EVENT_SCORE))
    return pairs.where((F.col("status") == "accepted") | ((F.col("status") == "candidate") & strong)).select("left_id", "right_id")


def near_links(rows: DataFrame, by: list[str], key: str, value: str, id_col: str, width: float) -> DataFrame:
    """Links (left_id, right_id) that join what all pairs of one block (``by``) join whose keys differ and whose values are at
    most ``width`` apart, at most three a row. What lies between two such rows in order is as near to both, so neighbours are enough:
    a stretch of near neighbours is linked to its first row. Rows of one key don't pair, so a row beside its own key is also linked to the nearest
    row of another key on either side. A block is sorted in one task and never gathered; rows without a value or an id pair with nothing."""
    known = rows.dropna(subset=[*by, key, value, id_col]).select(*by, F.struct(F.col(value).alias("value"), F.col(key).alias("key"), F.col(id_col).alias("id")).alias("me"))
    up, down = Window.partitionBy(*by).orderBy("me"), Window.partitionBy(*by).orderBy(F.desc("me"))
    other = lambda x: F.coalesce(F.col(f"{x}.key") != F.col("me.key"), F.lit(False))
    near = lambda x: F.coalesce(other(x) & (F.abs(F.col("me.value") - F.col(f"{x}.value")) <= width), F.lit(False))
    carried = lambda rule, x, order: F.last(F.when(rule, F.col(x)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    beside = known.withColumns({"before": F.lag("me").over(up), "after": F.lead("me").over(up)})
    placed = beside.withColumns({"head": carried(~near("before"), "me", up), "below": carried(other("before"), "before", up), "above": carried(other("after"), "after", down)})
    ends = F.array(F.col("head.id"), F.when(near("below") & ~other("before"), F.col("below.id")), F.when(near("above") & ~other("after"), F.col("above.id")))
    return placed.select(F.explode(F.array_compact(ends)).alias("left_id"), F.col("me.id").alias("right_id")).where("left_id <> right_id")


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id", a: str = "left_id", b: str = "right_id") -> DataFrame:
    """(id, root): the smallest id each node reaches. Every pass takes the smallest root among the
    neighbours and then the root's own root, so distances shrink fast; minima are combined
    before the shuffle, and no pass sends the nodes through the driver. Ends of edges that are no nodes are left out."""
    ids = nodes.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ends = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = durable(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().join(ids.withColumnRenamed("id", "x"), "x", "left_semi").join(ids.withColumnRenamed("id", "y"), "y", "left_semi"))
    now = durable(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("root")))
    while True:
        near = both.join(now.select(F.col("id").alias("y"), "root").hint("merge"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("near"))
        low = now.join(near.hint("merge"), "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = durable(low.join(up.hint("merge"), "root", "left").select("id", F.least("root", "above").alias("root"), "was"))
        settled = after.where("root != was").isEmpty()
        now = after.drop("was")
        if settled:
            break
    return ids.join(now, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def story_groups(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, story_id) of items (id, fingerprint). Items of one event identity are linked to
    its first item, so a thousand of them are a thousand links."""
    first = items.where("nullif(fingerprint, '') is not null").groupBy("fingerprint").agg(F.min("id").alias("left_id"))
    same = items.join(first, "fingerprint").select("left_id", F.col("id").alias("right_id"))
    return components(items, accepted_pairs(pairs).unionByName(same)).withColumnRenamed("root", "story_id")


def group_audit(groups: DataFrame) -> DataFrame:
    """One row: items, stories, items that joined another's story, stories of several items."""
    sizes = groups.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return sizes.agg(total("n", "items"), F.count(F.lit(1)).alias("stories"), total(F.col("n") - 1, "attached"), F.count_if(F.col("n") > 1).alias("corroborated"))


def title_score(source_class: Column, title: Column) -> Column:
    """How well a title stands for a story: the kind of source, its words up to twelve, less for clips."""
    words = T.normal(title)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHT.items() for x in pair]), F.coalesce(source_class, F.lit(""))), F.lit(OTHER_SOURCE))
    count = F.when(F.coalesce(words, F.lit("")) == "", 0).otherwise(F.size(F.split(words, " ")))
    clip = F.lit(False)
    for opening in CLIPS:
        clip = clip | F.coalesce(F.startswith(words, F.lit(opening)), F.lit(False))
    return kind + F.least(count, F.lit(MOST_WORDS)) - F.when(clip, CLIP_PENALTY).otherwise(0)


def story_aggregates(members: DataFrame) -> DataFrame:
    """One row a story of members (story_id, id, source_class, title, standfirst, summary,
    published_at, fetched_at, taxonomy): its primary item (best title, then earliest, then
    largest id), the range of its times, the number of sources, and a summary.

    The summary is the first sentence of the best item that has one (the primary item first) and
    the next item's first sentence unlike it. Both are minima by rank, so a story of any number of
    items is never gathered."""
    seen = F.coalesce("published_at", "fetched_at")
    rows = members.withColumns({"s": title_score(F.col("source_class"), F.col("title")), "at": seen})
    best = F.struct(F.col("s"), (-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), F.col("id"))
    body = F.struct("title", "taxonomy", "id")
    story = rows.groupBy("story_id").agg(
        F.max_by(body, best).alias("p"), F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"),
        F.min("fetched_at").alias("first_observed_at"), F.max("fetched_at").alias("last_observed_at"), F.count(F.lit(1)).alias("source_count"),
    )
    said = rows.join(story.select("story_id", F.col("p.id").alias("_top")), "story_id").select(
        "story_id", F.struct((F.col("id") != F.col("_top")).alias("other"), (-F.col("s")).alias("s"), (-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), F.col("id")).alias("rank"),
        sentences(F.coalesce("summary", "standfirst")).alias("says"),
    ).where(F.size("says") > 0)
    lead = said.groupBy("story_id").agg(F.min("rank").alias("r0"), F.min_by(F.get("says", F.lit(0)), F.col("rank")).alias("s0"))
    words = lambda s: F.array_distinct(F.split(T.normal(s), " "))
    rest = said.join(lead, "story_id").where("rank > r0").withColumn("new", F.get(F.filter("says", lambda x: T.jaccard(words(x), words(F.col("s0"))) < SAME_SENTENCE), F.lit(0)))
    second = rest.where("new is not null").groupBy("story_id").agg(F.min_by("new", "rank").alias("s1"))
    out = story.join(lead.select("story_id", "s0"), "story_id", "left").join(second, "story_id", "left")
    return out.select(
        "story_id", F.col("p.id").alias("primary_id"), F.col("p.title").alias("title"), F.col("p.taxonomy").alias("taxonomy"), "first_published_at", "last_published_at", "first_observed_at", "last_observed_at", "source_count",
        F.when(F.col("source_count") >= 2, "corroborated").otherwise("tentative").alias("confidence"), F.nullif(F.concat_ws(" ", "s0", "s1"), F.lit("")).alias("summary"),
    )


def story_entities(mentions: DataFrame) -> DataFrame:
    """Of mentions (story_id, entity_id, relation_type, confidence, match_method, matched_alias) the
    strongest of each story and entity; what was only assumed from the source doesn't count."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation_type")), F.lit(0))
    rows = mentions.where("match_method is null or match_method <> 'source_context'")
    return top1_per_key(rows, ["story_id", "entity_id"], [rank.desc(), F.col("confidence").desc_nulls_last(), F.col("matched_alias").asc_nulls_last()])
