"""Feed items to stories by identifiers and weighted terms, for all items and rules at once.

An item that carries the identifier of one story belongs to it, of several it is ``ambiguous``. Otherwise an item that isn't about the domain is
``filtered``; of the others each story's terms that occur in the text add up, stories below their least score are out, a single best one
is ``matched``, equal best ones are ``ambiguous`` and none is ``unmatched``.

A term may begin anywhere in the text, so items and terms meet by the term's first letters (three, or all of a shorter one) among
the text's: an equi-join, whatever the number of rules, after which the whole term is looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.functions.editorial import is_relevant, reference_ids

from .shared import spread

LETTERS = 3


def searchable(title: Column, categories: Column) -> Column:
    """Title and categories as one text; null ones are nothing."""
    return F.concat_ws(" ", F.array_compact(F.concat(F.array(title), F.coalesce(categories, F.array().cast("array<string>")))))


def term_scores(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, story_id, score) of texts (id, text) by terms (story_id, term, weight) that occur in them, case aside. A term without
    letters occurs everywhere; a term that a story has twice counts twice."""
    terms = terms.where("term is not null").select("story_id", F.lower("term").alias("term"), "weight").withColumn("_key", F.substring("term", 1, LETTERS))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - n + 1, F.lit(1))), lambda k: F.substring(F.col("_text"), k, F.lit(n)))
    low = texts.select("id", F.lower("text").alias("_text"))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *[grams(n) for n in range(1, LETTERS + 1)]))
    met = low.select("id", "_text", F.explode(keys).alias("_key")).join(terms, "_key").where(F.contains("_text", F.col("term")))
    return met.groupBy("id", "story_id").agg(F.sum("weight").alias("score"))


def route_items(items: DataFrame, rules: DataFrame, terms: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(id, status, story_id, score) of items (id, title, categories) by rules (story_id, min_score), terms (story_id, term, weight
    above 0) and identifiers (story_id, value)."""
    # a text makes a row for each of its letters, so those of a small file must not be one task's
    texts = spread(items.select("id", searchable(F.col("title"), F.col("categories")).alias("text")), "id")
    owned = identifiers.select(F.upper("value").alias("value"), "story_id").join(rules.select("story_id"), "story_id", "left_semi").distinct()
    named = texts.select("id", F.explode(reference_ids(F.col("text"))).alias("value")).join(owned, "value")
    named = named.groupBy("id").agg(F.min("story_id").alias("_own"), (F.min("story_id") != F.max("story_id")).alias("_several"))
    eligible = term_scores(texts, terms).join(rules.select("story_id", "min_score"), "story_id").where("score >= min_score")
    best = eligible.groupBy("id").agg(F.max(F.struct("score")).alias("_top"), F.max_by(F.struct("story_id"), F.struct("score", "story_id")).alias("_story"))
    ties = eligible.join(best.select("id", F.col("_top.score").alias("score")), ["id", "score"]).groupBy("id").agg(F.count(F.lit(1)).alias("_ties"))
    # stories that ask for no score are eligible without a term; only where nothing else is do they count
    free = rules.where("min_score <= 0").agg(F.count(F.lit(1)).alias("_free"), F.min("story_id").alias("_free_story"))  # one row
    rows = texts.join(named, "id", "left").join(best, "id", "left").join(ties, "id", "left").crossJoin(F.broadcast(free))
    about, tie, none = is_relevant(F.col("text")), F.coalesce("_ties", "_free") > 1, F.coalesce("_ties", F.lit(0)) + F.when(F.col("_ties").isNull(), F.col("_free")).otherwise(0) == 0
    status = F.when(F.col("_several"), "ambiguous").when(F.col("_own").isNotNull(), "matched").when(~about, "filtered").when(none, "unmatched").when(tie, "ambiguous").otherwise("matched")
    rows = rows.withColumn("status", status)
    story = F.when(F.col("status") == "matched", F.coalesce("_own", "_story.story_id", "_free_story"))
    score = F.when(F.col("_own").isNotNull(), 100).when(F.col("status").isin("filtered", "unmatched"), 0).otherwise(F.coalesce("_top.score", F.lit(0)))
    return rows.select("id", "status", story.alias("story_id"), score.cast("long").alias("score"))
