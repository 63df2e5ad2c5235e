"""Who and what is meant: calendar entries to race entities, documents to races, drivers of a session,
the race that anchors a story and the moment within it. Every match is an equi-join; what can't be
told apart is reported as ambiguous, not guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.functions.placement import FUTURE, OTHER_SERIES, historical_year, plain

from .core import top1_per_key

# fixed values: how much an alias kind counts beside its confidence, and words that tell of a race event
ALIAS_SCORE = {"race_name": 500, "canonical": 400, "venue": 300}
DISPLAY_SCORE = 1000
RACE_NAMES = ("fia_event_name", "race_name", "canonical")
ALIAS_RANK = {"fia_event_name": 5, "race_name": 4, "canonical": 3, "venue": 2}
SCOPE_RANK = {"title": 4, "standfirst": 3, "summary": 2}
EVENT_TALK = (
    "grand prix", " gp ", "formula 1", "f1", "race", "qualifying", "practice", "pole", "grid", "pit stop", "pitstop", "vsc",
    "virtual safety car", "safety car", "tyre", "tire", "debrief", "recap", "preview", "weekend", "overtaking", "victory", "wins",
)


def resolve_calendar(calendar: DataFrame, known: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """calendar (race_id, season, name, circuit_id, circuit_name, locality) to race entities:
    race_id, entity_id, method, display_name, slug.

    First by the circuit within the season (known: season, circuit_id, entity_id), then by display
    name or alias (entities: id, slug, display_name, active_from, active_to; aliases: entity_id, alias,
    alias_type, confidence, enabled), otherwise a new entity. Two known races of one circuit, or two
    best entities of equal score, give ``ambiguous_circuit`` or ``ambiguous_alias`` without an entity."""
    races = calendar.withColumn("shown", F.concat_ws(" ", F.col("season").cast("string"), "name"))
    circuit = known.groupBy("season", "circuit_id").agg(F.count(F.lit(1)).alias("found"), F.min("entity_id").alias("by_circuit"))
    words = F.array_distinct(F.filter(F.transform(F.array("name", "circuit_name", "locality"), lambda w: F.lower(F.trim(w))), lambda w: w.isNotNull() & (w != "")))
    active = entities.select(F.col("id").alias("entity_id"), F.col("slug").alias("known_slug"), "active_from", "active_to", F.lower("display_name").alias("shown_key"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIAS_SCORE.items() for x in pair]), F.coalesce("alias_type", F.lit(""))), F.lit(0))
    named = aliases.where("enabled").select("entity_id", F.lower("alias").alias("word"), (kind + F.col("confidence")).alias("score"))
    by_alias = races.select("race_id", "season", F.explode(words).alias("word")).join(named, "word").join(active, "entity_id")
    by_name = races.select("race_id", "season", F.lower("shown").alias("shown_key")).join(active, "shown_key").withColumn("score", F.lit(DISPLAY_SCORE))
    cols = ["race_id", "season", "entity_id", "known_slug", "active_from", "active_to", "score"]
    hits = by_alias.select(cols).unionByName(by_name.select(cols)).where("coalesce(active_from <= season, true) and coalesce(active_to >= season, true)")
    scored = hits.groupBy("race_id", "entity_id", "known_slug").agg(F.max("score").alias("score"))
    best = scored.groupBy("race_id").agg(F.max("score").alias("score")).join(scored, ["race_id", "score"])
    best = best.groupBy("race_id").agg(F.count(F.lit(1)).alias("ties"), F.min("entity_id").alias("by_alias"))
    rows = races.join(circuit, ["season", "circuit_id"], "left").join(best, "race_id", "left")
    method = F.when(F.col("found") > 1, "ambiguous_circuit").when(F.col("found") == 1, "circuit").when(F.col("ties") > 1, "ambiguous_alias").when(F.col("ties") == 1, "alias").otherwise("create")
    rows = rows.withColumn("method", method)
    return rows.select(
        "race_id", F.when(F.col("method") == "circuit", F.col("by_circuit")).when(F.col("method") == "alias", F.col("by_alias")).alias("entity_id"),
        "method", F.col("shown").alias("display_name"), F.when(F.col("method") == "create", T.slug(F.col("shown"))).alias("slug"),
    )


def match_documents(documents: DataFrame, race_aliases: DataFrame) -> DataFrame:
    """documents (.., event_name) with the race_id of the alias (race_id, alias) of the same normal form;
    null where there is none, the smallest id where several share it."""
    lookup = race_aliases.groupBy(T.normal(F.col("alias")).alias("_event")).agg(F.min("race_id").alias("race_id")).where("_event <> ''")
    return documents.withColumn("_event", T.normal(F.col("event_name"))).join(lookup, "_event", "left").drop("_event")


def repair_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries without a driver get the one whose name (names: entity_id, name) equals theirs but for
    case and outer space; a name of several drivers fills nothing."""
    lookup = names.select(F.lower(F.trim("name")).alias("_name"), "entity_id").distinct().groupBy("_name").agg(F.count(F.lit(1)).alias("_n"), F.min("entity_id").alias("_id")).where("_n = 1 and _name <> ''")
    rows = entries.withColumn("_name", F.lower(F.trim("full_name"))).join(lookup, "_name", "left")
    return rows.withColumn("driver_entity_id", F.coalesce("driver_entity_id", "_id")).select(entries.columns)


def fill_drivers(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of a session without a driver get the driver of the entry with their number."""
    lookup = entries.where("driver_entity_id is not null").groupBy("session_id", "driver_number").agg(F.min("driver_entity_id").alias("_id"))
    return rows.join(lookup, ["session_id", "driver_number"], "left").withColumn("driver_entity_id", F.coalesce("driver_entity_id", "_id")).select(rows.columns)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def _rank(table: dict[str, int], key: Column, otherwise: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(key, F.lit(""))), F.lit(otherwise))


def story_anchor(candidates: DataFrame) -> DataFrame:
    """The race that a story is about, of candidates (story_id, text, title, reported_at, race_id, season,
    round, anchor_at, alias_type, matched_alias, detected_in, confidence); a story without an
    eligible candidate has no row.

    An anniversary year admits only races of that year. Names of a race count in title, standfirst
    or summary, a venue only in a title that speaks of an event. A text about other series needs the
    name of a grand prix in the title. Talk of the future takes the nearest race to come, otherwise
    races named in the title go first, then the more prominent place, kind of name and confidence."""
    text, title, alias, kind, where = plain(F.col("text")), plain(F.coalesce("title", "text")), plain(F.col("matched_alias")), F.coalesce("alias_type", F.lit("")), F.coalesce("detected_in", F.array().cast("array<string>"))
    year = historical_year(F.col("text"))
    in_title, up_front = F.array_contains(where, "title"), F.arrays_overlap(where, F.array(*map(F.lit, SCOPE_RANK)))
    grand_prix = alias.rlike(r"grand prix|\bgp\b")
    named = (alias != "") & F.contains(title, alias)
    talk = _any(F.concat(F.lit(" "), title, F.lit(" ")), EVENT_TALK) | _any(title, FUTURE)
    eligible = F.when(kind.isin(*RACE_NAMES), up_front).when((kind == "unknown") & up_front & grand_prix, True).when(kind == "venue", in_title & talk).otherwise(in_title & named & grand_prix)
    rows = candidates.where(year.isNull() | (F.col("season") == year)).where(eligible).where(~_any(text, OTHER_SERIES) | (named & grand_prix))
    ahead = F.coalesce(_any(text, FUTURE) & (F.col("anchor_at") >= F.col("reported_at")), F.lit(False))
    prominence = F.coalesce(F.array_max(F.transform(where, lambda w: _rank(SCOPE_RANK, w, 1))), F.lit(1))
    order = [ahead.desc(), F.when(ahead, F.col("anchor_at")).asc_nulls_last(), named.desc(), prominence.desc(), _rank(ALIAS_RANK, kind, 1).desc(), F.coalesce("confidence", F.lit(0)).desc(), F.col("season").asc(), F.coalesce("round", F.lit(999)).asc(), F.col("race_id").asc()]
    return top1_per_key(rows, ["story_id"], order)


def deep_anchor(placements: DataFrame, stints: DataFrame, laps: DataFrame) -> DataFrame:
    """placements (story_id, session_id, driver_entity_id, lap_number, stint_number, fallback) with
    ``anchor_at``: when the lap started, for the driver or, where none is known, the first of all.
    A driver's stint stands for the lap it began with; without a lap the fallback stays."""
    key = ["session_id", "driver_entity_id", "stint_number"]
    begun = top1_per_key(stints, key, [F.col("fetched_at").desc_nulls_first(), F.col("lap_start").asc_nulls_last()]).select(*key, "lap_start")
    rows = placements.join(begun, key, "left").withColumn("_lap", F.coalesce(F.nullif("lap_start", F.lit(0)), "lap_number"))
    own = laps.where("driver_entity_id is not null").groupBy("session_id", F.col("lap_number").alias("_lap"), "driver_entity_id").agg(F.min("started_at").alias("_own"))
    first = laps.groupBy("session_id", F.col("lap_number").alias("_lap")).agg(F.min("started_at").alias("_first"))
    rows = rows.join(own, ["session_id", "_lap", "driver_entity_id"], "left").join(first, ["session_id", "_lap"], "left")
    found = F.when(F.col("driver_entity_id").isNull(), F.col("_first")).otherwise(F.col("_own"))
    return rows.withColumn("anchor_at", F.coalesce(found, "fallback")).select(*placements.columns, "anchor_at")
