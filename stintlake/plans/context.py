"""What happened around a session, race, driver, team, season or story, and what it is related to.

A timeline is a union of branches. A branch is data as a facet is: which rows, when they happened,
how they read and where they lead. The newest of each kind are kept, then the newest of all."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facets import FACETS, Facet, rows_of_all, select_rows

PER_TYPE, TOTAL = 12, 30


@dataclass(frozen=True)
class Branch:
    kind: str
    rows: Facet
    at: tuple[str, ...]  # the first of these columns that is known
    label: str
    leads_to: tuple[str, str] = ("null", "null")  # type and key of the target, as expressions
    race: bool = False  # widened by the race of the row


_SESSION_KEY = "concat(race_key, '-', replace(session_code, '_', '-'))"
_SEEN = ("source_timestamp", "published_at", "captured_at", "created_at")
_CLAIM = "coalesce(normalized_claim, raw_excerpt_or_reference, source_name)"


def _story(target: str) -> Branch:
    return Branch("story", FACETS[target, "stories"], ("updated_at",), "title", ("'story'", "slug"))


def _evidence(target: str) -> Branch:
    return Branch("evidence", FACETS[target, "evidence"], _SEEN, _CLAIM)


def _document(target: str) -> Branch:
    return Branch("document", FACETS[target, "documents"], ("published_at", "created_at"), "title", ("'document'", "coalesce(external_id, cast(id as string))"))


def _control(scope: str) -> Branch:
    spec = Facet("session_race_control_events", (scope,), ("observed_at",), ("session", "race_of_session"))
    return Branch("race_control", spec, ("observed_at",), "message", ("'session'", _SESSION_KEY))


def _driver(name: str, number: str) -> str:
    return f"coalesce({name}, concat('Driver ', {number}))"


_IS_DRIVER = ("if(driver_key is null, null, 'driver')", "driver_key")
TIMELINES: dict[str, tuple[Branch, ...]] = {
    "driver": (
        Branch("race_result", FACETS["driver", "race_results"], ("_start", "_end", "fetched_at"), "concat(race_name, if(finish_position is null, '', concat(' · P', finish_position)))", ("'race'", "race_key"), race=True),
        _control("driver_entity_id"), _story("driver"), _evidence("driver"),
    ),
    "team": (Branch("race_result", FACETS["team", "race_results"], ("_start", "_end", "fetched_at"), "concat(race_name, if(finish_position is null, '', concat(' · best P', finish_position)))", ("'race'", "race_key"), race=True), _story("team"), _evidence("team")),
    "race": (
        Branch("session", Facet("race_sessions", ("race_id",), (), ("race",)), ("starts_at",), "session_name", ("'session'", _SESSION_KEY)),
        _document("race"), _story("race"), _control("_race_id"),
    ),
    "session": (
        Branch("session_start", Facet("race_sessions", ("id",), (), ("race",)), ("starts_at",), "concat(session_name, ' started')", ("'session'", _SESSION_KEY)),
        Branch("race_control", FACETS["session", "race_control"], ("observed_at",), "message", _IS_DRIVER),
        Branch("pit_stop", FACETS["session", "pit_stops"], ("observed_at",), f"concat({_driver('driver_name', 'provider_driver_number')}, ' pit stop · lap ', lap_number)", _IS_DRIVER),
        Branch("overtake", FACETS["session", "overtakes"], ("observed_at",), f"concat({_driver('overtaking_driver_name', 'overtaking_driver_number')}, ' overtook ', {_driver('overtaken_driver_name', 'overtaken_driver_number')})", ("if(overtaking_driver_key is null, null, 'driver')", "overtaking_driver_key")),
        _evidence("session"),
    ),
    "season": (Branch("race", FACETS["season", "races"], ("start_at", "weekend_end_date"), "official_name", ("'race'", "slug")), _story("season"), _document("season")),
    "story": (_evidence("story"), Branch("publication", FACETS["story", "publications"], ("published_at", "updated_at", "created_at"), "headline", ("'publication'", "slug"))),
}


def _as_events(rows: DataFrame, tables: Mapping[str, DataFrame], target: str, branch: Branch) -> DataFrame:
    """Selected rows, with their target as ``_target``, as events."""
    if branch.race:
        rows = rows.join(tables["races"].select(F.col("id").alias("race_id"), F.col("start_at").alias("_start"), F.col("weekend_end_date").alias("_end")), "race_id")
    if branch.kind == "race_result" and target == "team":  # one event a race, with the best car
        best = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in ("race_id", "_target")]), F.struct(F.col("finish_position").isNull(), F.col("finish_position"), F.col("id")))
        rows = rows.groupBy("_target", "race_id").agg(best.alias("b"), F.max("fetched_at").alias("newest")).select("_target", "race_id", "b.*", "newest").withColumn("fetched_at", F.col("newest")).withColumn("id", F.concat(F.lit("team-race:"), F.col("race_id").cast("string")))
    if branch.rows.distinct:
        rows = rows.dropDuplicates(["_target", "id"])
    at = F.coalesce(*[F.col(c) for c in branch.at]).cast("timestamp")
    return rows.select(F.col("_target").alias("target"), F.lit(branch.kind).alias("event_type"), F.col("id").cast("string").alias("event_id"), at.alias("occurred_at"), F.expr(branch.label).alias("label"), *[F.expr(e).cast("string").alias(n) for e, n in zip(branch.leads_to, ("target_type", "target_key"), strict=True)])


def timeline(tables: Mapping[str, DataFrame], target: str, key, per_type: int = PER_TYPE, total: int = TOTAL) -> DataFrame:
    """The newest events of a target: ``per_type`` of each kind, ``total`` of all (both are the feature);
    what has no time is left out. The rank is taken within one target's rows, a branch at a time."""

    def newest(branch: Branch) -> DataFrame:
        events = _as_events(select_rows(tables, branch.rows, key).withColumn("_target", F.lit(key)), tables, target, branch).drop("target").where("occurred_at is not null")
        return events.orderBy(F.col("occurred_at").desc(), "event_id").limit(per_type)

    events = reduce(DataFrame.unionByName, map(newest, TIMELINES[target]))
    return events.orderBy(F.col("occurred_at").desc(), "event_type", "event_id").limit(total)


def timelines(tables: Mapping[str, DataFrame], target: str, per_type: int = PER_TYPE, total: int = TOTAL) -> DataFrame:
    """``timeline`` of every target of a kind, with the column ``target``: one tagged union of the branches, in which
    ranks by target and kind are limited before the shuffle, and again by target."""
    newest_first = [F.col("occurred_at").desc(), F.col("event_type"), F.col("event_id")]
    events = reduce(DataFrame.unionByName, [_as_events(rows_of_all(tables, b.rows), tables, target, b) for b in TIMELINES[target]]).where("occurred_at is not null")
    events = events.withColumn("_n", F.row_number().over(Window.partitionBy("target", "event_type").orderBy(*newest_first))).where(F.col("_n") <= per_type).drop("_n")
    out = events.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy(*newest_first))).where(F.col("_n") <= total).drop("_n")
    return out.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


def participation(tables: Mapping[str, DataFrame], by: str) -> DataFrame:
    """For all drivers (``by='driver'``) or teams the other side of their session entries: distinct
    sessions, first and last start."""
    own, other = ("driver_entity_id", "team_entity_id") if by == "driver" else ("team_entity_id", "driver_entity_id")
    rows = tables["session_entries"].where(F.col(own).isNotNull() & F.col(other).isNotNull()).join(tables["race_sessions"].select(F.col("id").alias("session_id"), "starts_at"), "session_id")
    found = rows.groupBy(F.col(own).alias("entity_id"), F.col(other).alias("related_id")).agg(F.countDistinct("session_id").alias("sessions"), F.min("starts_at").alias("first_at"), F.max("starts_at").alias("last_at"))
    return found.withColumn("relation", F.lit("participated_for" if by == "driver" else "fielded_driver"))


def roster_relations(roster: DataFrame, by: str) -> DataFrame:
    """roster (driver_entity_id, team_entity_id, role): declared membership, a driver's or another's."""
    own, other = ("driver_entity_id", "team_entity_id") if by == "driver" else ("team_entity_id", "driver_entity_id")
    name = F.lit("roster_driver_for") if by == "driver" else F.when(F.col("role") == "driver", "has_roster_driver").otherwise("has_team_member")
    return roster.select(F.col(own).alias("entity_id"), F.col(other).alias("related_id"), name.alias("relation")).where("entity_id is not null and related_id is not null").distinct()


def relations(tables: Mapping[str, DataFrame], by: str) -> DataFrame:
    """Declared and observed relations together; counts are null for declared ones."""
    return roster_relations(tables["roster"], by).unionByName(participation(tables, by), allowMissingColumns=True)


def structure(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The fixed relations of seasons, races and sessions as (source, relation, target, order)."""
    races, sessions = tables["races"], tables["race_sessions"]
    edge = lambda df, kind, a, rel, kind2, b, at: df.select(F.concat(F.lit(kind), F.col(a).cast("string")).alias("source"), F.lit(rel).alias("relation"), F.concat(F.lit(kind2), F.col(b).cast("string")).alias("target"), F.col(at).cast("string").alias("position"))
    placed = sessions.join(races.select(F.col("id").alias("race_id"), "season"), "race_id")
    return reduce(DataFrame.unionByName, [
        edge(races, "race:", "id", "part_of_season", "season:", "season", "round"), edge(races, "season:", "season", "has_race", "race:", "id", "round"),
        edge(placed, "race:", "race_id", "has_session", "session:", "id", "starts_at"), edge(placed, "session:", "id", "part_of_race", "race:", "race_id", "starts_at"),
        edge(placed, "session:", "id", "part_of_season", "season:", "season", "starts_at"),
    ])
