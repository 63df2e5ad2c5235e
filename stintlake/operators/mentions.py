"""Which entities a news item names, where it names them, and how it relates to them.

Everything is set-based: the four texts of all items become rows, aliases meet them by equi-joins on
n-grams (codes on case-sensitive tokens), one aggregation picks the strongest mention of an entity
in an item, and a window over the item's few entities reads the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T

from .core import with_scalar

# fixed values: the texts of an item, the strongest first
SCOPES = ("title", "standfirst", "summary", "body_excerpt")
# fixed values: words of a title that decide a relation
FORMER = ("former", "ex", "like")
LATER = ("after", "following")
JOINING = ("join", "joins", "joined")
EDITION = r"\b(20(?:2\d|3\d))\b"


def alias_mentions(texts: DataFrame, text: str, entities: DataFrame, alias: str) -> DataFrame:
    """The pairs of a text and an entity whose alias it holds. Texts are exploded into their n-grams up to
    the longest alias, so the match is an equi-join, not a test of every alias on every text."""
    aliases = entities.withColumn("gram", T.normal(F.col(alias)))
    longest = aliases.agg(F.coalesce(F.max(F.size(F.split("gram", " "))), F.lit(1)).alias("longest"))
    rows = with_scalar(texts.withColumn("w", F.split(T.normal(F.col(text)), " ")), longest)
    sizes = F.sequence(F.lit(1), F.least(F.greatest("longest", F.lit(1)), F.size("w")))
    grams = F.flatten(F.transform(sizes, lambda n: _grams(F.col("w"), n)))
    return rows.select(*texts.columns, F.explode(F.array_distinct(grams)).alias("gram")).join(aliases, "gram").drop("gram")


def _grams(words: Column, n: Column) -> Column:
    starts = F.when(n <= F.size(words), F.sequence(F.lit(1), F.size(words) - n + 1))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " "))


def code_mentions(texts: DataFrame, text: str, entities: DataFrame, code: str) -> DataFrame:
    """The pairs of a text and an entity whose code, letters or digits, stands in it as a token in its own case."""
    codes = entities.withColumn("token", F.trim(code)).where("token != ''")
    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    return texts.select("*", F.explode(tokens).alias("token")).join(codes, "token").drop("token")


def edition_season(items: DataFrame) -> Column:
    """The season that decides which race is meant: the stated one, else the first year of the title, the
    standfirst or the summary, else the item's own. Bodies name many years and are not read."""
    years = [F.nullif(F.regexp_extract(c, EDITION, 1), F.lit("")).cast("int") for c in SCOPES[:3]]
    return F.coalesce(F.col("race_season"), *years, F.col("season"))


def strongest_mentions(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each item and entity that it names: the strongest mention and ``detected_in``, the texts
    with a mention. Stronger is the earlier text, then the longer alias, the higher confidence, and of
    equals the alias first in order."""
    scopes = F.array(*[F.struct(F.lit(n).alias("rank"), F.col(c).alias("said")) for n, c in enumerate(SCOPES)])
    texts = items.select("item_id", "season", edition_season(items).alias("edition"), F.inline(scopes)).where(T.normal(F.col("said")) != "")
    usable = aliases.where(F.length(T.normal(F.col("alias"))) >= 2)
    is_code = F.coalesce(F.col("alias_type"), F.lit("")) == "driver_code"
    found = alias_mentions(texts, "said", usable.where(~is_code), "alias").unionByName(code_mentions(texts, "said", usable.where(is_code), "alias"))
    at = F.when(F.col("entity_type") == "race", F.col("edition")).otherwise(F.col("season"))
    early, late = at < F.col("valid_from_season"), at > F.col("valid_to_season")
    found = found.where(~F.coalesce(early, F.lit(False)) & ~F.coalesce(late, F.lit(False)))
    order = F.struct("rank", (-F.length(T.normal(F.col("alias")))).alias("size"), (-F.col("confidence")).alias("weak"), "alias", "confidence", "entity_type", "slug", "display_name")
    best = found.groupBy("item_id", "entity_id").agg(F.min(order).alias("b"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    names = F.array(*[F.lit(c) for c in SCOPES])
    return best.select(
        "item_id", "entity_id", "b.entity_type", "b.slug", "b.display_name", F.col("b.alias").alias("matched_alias"), "b.confidence",
        F.get(names, F.col("b.rank")).alias("strongest_scope"), F.transform("ranks", lambda r: F.get(names, r)).alias("detected_in"),
    )


def title_relation(words: Column, at: Column, size: Column, kind: Column, people: Column) -> Column:
    """What a title says of an entity at word ``at`` (from 1; 0: its alias isn't there), ``size`` words long, where
    ``people`` are the places of the people in the title."""
    before, behind = F.get(words, at - 2), F.get(words, at - 1 + size)
    earlier = F.array_max(F.filter(people, lambda p: p < at))
    between = F.slice(words, earlier, at - earlier)
    of_team = F.when(before.isin(*FORMER), "mentioned").when((behind == "driver") | (before.isin(*JOINING) & (F.size(people) > 0)), "directly_involved")
    # who comes after another person and "after" or "following" is the background of what that one did
    of_person = F.when(F.arrays_overlap(between, F.array(*[F.lit(w) for w in LATER])), "mentioned")
    return F.coalesce(F.when(at > 0, F.when(kind == "team", of_team).when(kind == "person", of_person)), F.lit("subject"))


def classify_items(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations of items (item_id, title, standfirst, summary, body_excerpt, season, race_season,
    source_context_team_slug) to the entities of aliases (entity_id, entity_type, slug, display_name,
    alias, alias_type, confidence, valid_from_season, valid_to_season; an open end is null).

    The team a source belongs to is context of its items that don't name it. Null texts name nothing."""
    titles = items.select("item_id", F.split(T.normal(F.coalesce("title", F.lit(""))), " ").alias("words"))
    rows = strongest_mentions(items, aliases).join(titles, "item_id").withColumn("phrase", T.normal(F.col("matched_alias")))
    rows = rows.withColumn("size", F.size(F.split("phrase", " ")))
    rows = rows.withColumn("at", F.coalesce(F.array_position(_grams(F.col("words"), F.col("size")), F.col("phrase")), F.lit(0)).cast("int"))
    in_title, kind = F.array_contains("detected_in", "title"), F.col("entity_type")
    places = F.collect_list(F.when((kind == "person") & in_title & (F.col("at") > 0), F.col("at"))).over(Window.partitionBy("item_id"))
    rows = rows.withColumn("people", places)

    lead = F.array_contains("detected_in", "standfirst")
    several = (F.size("detected_in") >= 2) & (lead | F.array_contains("detected_in", "summary"))
    said = F.when(in_title, title_relation(F.col("words"), F.col("at"), F.col("size"), kind, F.col("people"))).when(several, "directly_involved").otherwise("mentioned")
    relation = F.when(kind == "race", F.when(in_title | lead, "context").otherwise("mentioned")).otherwise(said)
    sure = F.when(in_title, F.col("confidence") + 5).when(F.size("detected_in") == 1, F.least(F.col("confidence"), F.lit(90))).otherwise(F.col("confidence"))
    sure = sure + F.when(in_title & (relation == "context"), 2).otherwise(0)
    named = rows.select(
        "item_id", "entity_id", "entity_type", "slug", "display_name", relation.alias("relation_type"), F.least(F.lit(100), F.greatest(F.lit(1), sure)).cast("int").alias("confidence"),
        F.concat("strongest_scope", F.lit("_alias")).alias("match_method"), "matched_alias", "detected_in",
    )

    order = F.struct((-F.col("confidence")).alias("weak"), (-F.length("alias")).alias("size"), "alias", "entity_id", "display_name")
    teams = aliases.where("entity_type = 'team'").groupBy("slug").agg(F.min(order).alias("b")).select("slug", "b.entity_id", "b.display_name")
    hinted = items.select("item_id", F.col("source_context_team_slug").alias("slug")).join(teams, "slug")
    hinted = hinted.join(named.select("item_id", "entity_id"), ["item_id", "entity_id"], "left_anti")
    context = hinted.select(
        "item_id", "entity_id", F.lit("team").alias("entity_type"), "slug", "display_name", F.lit("context").alias("relation_type"), F.lit(100).alias("confidence"),
        F.lit("source_context").alias("match_method"), F.col("display_name").alias("matched_alias"), F.array(F.lit("source")).alias("detected_in"),
    )
    return named.unionByName(context)
