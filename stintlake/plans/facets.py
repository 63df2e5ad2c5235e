"""Context facets: which rows belong to a session, race, driver, team, season or story, in which order.

Each facet is data: a table, the look-ups that widen it, the column that a target selects and an
order. ``facet`` turns it into equi-joins, ``facet_rows`` adds the page. A looked-up column replaces
one of the same name; columns that begin with ``_`` serve the selection and are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.operators.core import page

from .registry import query


@dataclass(frozen=True)
class Lookup:
    table: str
    local: str
    remote: str
    columns: tuple[tuple[str, str], ...]  # (name, column of the table)
    how: str = "left"


@dataclass(frozen=True)
class Facet:
    table: str
    scope: tuple[str, ...]  # a row belongs to the target if one of these columns holds its id
    order: tuple[str, ...]  # "x": rising, "-x": falling, nulls last in both; "^x": falling, nulls first
    lookups: tuple[str, ...] = ()
    distinct: bool = False


def _entity(key: str, prefix: str, name: str | None = None) -> Lookup:
    shown = (("display_name", name or f"{prefix}_name"),)
    return Lookup("entities", key, "id", tuple((new, old) for old, new in (("slug", f"{prefix}_key"), *shown)))


LOOKUPS = {
    "session": Lookup("race_sessions", "session_id", "id", (("_race_id", "race_id"), ("session_code", "session_code"), ("session_name", "session_name")), "inner"),
    "race_of_session": Lookup("races", "_race_id", "id", (("race_key", "slug"), ("_race_name", "official_name"), ("season", "season"), ("round", "round")), "inner"),
    "race": Lookup("races", "race_id", "id", (("race_key", "slug"), ("race_name", "official_name"), ("season", "season"), ("round", "round")), "inner"),
    "driver": _entity("driver_entity_id", "driver"),
    "team": _entity("team_entity_id", "team"),
    "entry_team": _entity("team_entity_id", "team", "team_name_canonical"),
    "overtaking": _entity("overtaking_driver_entity_id", "overtaking_driver"),
    "overtaken": _entity("overtaken_driver_entity_id", "overtaken_driver"),
    "driver_snapshot": Lookup("driver_standings_snapshots", "snapshot_id", "id", tuple((c, c) for c in ("season", "after_round", "fetched_at", "source_url")), "inner"),
    "team_snapshot": Lookup("constructor_standings_snapshots", "snapshot_id", "id", tuple((c, c) for c in ("season", "after_round", "fetched_at", "source_url")), "inner"),
    "mention": Lookup("story_entities", "id", "story_id", (("_entity", "entity_id"), ("relation_type", "relation_type"), ("relation_confidence", "confidence")), "inner"),
    "bare_mention": Lookup("story_entities", "id", "story_id", (("_entity", "entity_id"),), "inner"),
    "race_of_mention": Lookup("races", "_entity", "entity_id", (("_about", "id"),), "inner"),
    "mentioned_race": Lookup("races", "_entity", "entity_id", (("_season", "season"),), "inner"),
    "document_mention": Lookup("race_document_entities", "id", "race_document_id", (("_entity", "entity_id"), ("matched_alias", "matched_alias"), ("match_method", "match_method"), ("relation_confidence", "confidence")), "inner"),
    "entity": Lookup("entities", "entity_id", "id", (("entity_type", "entity_type"), ("entity_key", "slug"), ("display_name", "display_name"), ("entity_metadata", "metadata")), "inner"),
    "published_story": Lookup("publication_stories", "id", "publication_id", (("_story", "story_id"),), "inner"),
}

_WHO, _SESSION, _NEWEST = ("driver", "team"), ("session", "race_of_session"), ("-_moment", "id")
_LATEST = ("^season", "-round")
_STORIES = Facet("stories", ("_entity",), ("^updated_at", "title"), ("mention",))
_DOCUMENTS = Facet("race_documents", ("_entity",), ("-published_at", "id"), ("document_mention",))
_STANDING = ("^season", "^after_round", "^fetched_at")
#: tables that hold rows of a session, with the column their rows follow
_TIMED = {"laps": "lap_number", "stints": "stint_number", "positions": "observed_at", "intervals": "observed_at", "pit_stops": "lap_number"}


def _evidence(scope: str) -> Facet:
    return Facet("evidence", (scope,), _NEWEST)


def _session_facets() -> dict[str, Facet]:
    here = ("session_id",)
    timed = {k: Facet(f"session_{k}", here, ("driver_name", c) if k == "stints" else (c, "driver_name"), (*_SESSION, "driver")) for k, c in _TIMED.items()}
    return timed | {
        "entries": Facet("session_entries", here, ("driver_number", "driver_name"), ("driver", "entry_team")),
        "results": Facet("session_results", here, ("position", "driver_number"), _WHO),
        "starting_grid": Facet("session_starting_grid", here, ("position", "driver_name"), _WHO),
        "overtakes": Facet("session_overtakes", here, ("observed_at", "id"), ("overtaking", "overtaken")),
        "race_control": Facet("session_race_control_events", here, ("observed_at", "id"), ("driver",)),
        "weather": Facet("session_weather", here, ("observed_at", "id")),
        "evidence": _evidence("session_id"),
    }


def _race_facets() -> dict[str, Facet]:
    order = _TIMED | {"results": "position", "starting_grid": "position", "overtakes": "observed_at", "race_control_events": "observed_at", "weather": "observed_at"}
    names = {"results": "session_results", "race_control_events": "race_control"}
    of_sessions = {names.get(k, k): Facet(f"session_{k}", ("_race_id",), ("session_code", c), _SESSION) for k, c in order.items()}
    return of_sessions | {
        "sessions": Facet("race_sessions", ("race_id",), ("starts_at", "sequence")),
        "race_results": Facet("race_results", ("race_id",), ("finish_position", "driver_name"), _WHO),
        "qualifying_results": Facet("qualifying_results", ("race_id",), ("position", "driver_name"), _WHO),
        "documents": Facet("race_documents", ("race_id",), ("-published_at", "-document_number", "id")),
        "stories": Facet("stories", ("_about",), _STORIES.order, ("mention", "race_of_mention")),
        "evidence": _evidence("race_id"),
    }


def _driver_facets() -> dict[str, Facet]:
    me = ("driver_entity_id",)
    order = {k: ("^" if c == "observed_at" else "") + c for k, c in _TIMED.items()} | {"results": "session_code", "starting_grid": "position"}
    of_sessions = {"session_results" if k == "results" else k: Facet(f"session_{k}", me, (*_LATEST, c), _SESSION) for k, c in order.items()}
    return of_sessions | {
        "race_results": Facet("race_results", me, _LATEST, ("race", "team")),
        "qualifying_results": Facet("qualifying_results", me, _LATEST, ("race", "team")),
        "overtakes": Facet("session_overtakes", ("overtaking_driver_entity_id", "overtaken_driver_entity_id"), (*_LATEST, "-observed_at"), (*_SESSION, "overtaking", "overtaken")),
        "standings": Facet("driver_standing_rows", me, _STANDING, ("driver_snapshot",)),
        "stories": _STORIES,
        "documents": _DOCUMENTS,
        "evidence": _evidence("driver_entity_id"),
    }


def _team_facets() -> dict[str, Facet]:
    us, of_session = ("team_entity_id",), (*_SESSION, "driver")
    return {
        "race_results": Facet("race_results", us, (*_LATEST, "finish_position"), ("race", "driver")),
        "qualifying_results": Facet("qualifying_results", us, (*_LATEST, "position"), ("race", "driver")),
        "session_results": Facet("session_results", us, (*_LATEST, "session_code", "position"), of_session),
        "session_entries": Facet("session_entries", us, (*_LATEST, "session_code", "driver_number"), of_session),
        "starting_grid": Facet("session_starting_grid", us, (*_LATEST, "position"), of_session),
        "standings": Facet("constructor_standing_rows", us, _STANDING, ("team_snapshot",)),
        "stories": _STORIES,
        "documents": _DOCUMENTS,
        "evidence": _evidence("team_entity_id"),
    }


def _season_facets() -> dict[str, Facet]:
    year = ("season",)
    return {
        "races": Facet("races", year, ("round", "start_at")),
        "race_results": Facet("race_results", year, ("-round", "finish_position"), ("race", *_WHO)),
        "qualifying_results": Facet("qualifying_results", year, ("-round", "position"), ("race", *_WHO)),
        "sessions": Facet("race_sessions", year, ("-round", "starts_at"), ("race",)),
        "session_results": Facet("session_results", year, ("-round", "session_code", "position"), (*_SESSION, *_WHO)),
        "documents": Facet("race_documents", year, ("-published_at", "id"), ("race",)),
        "stories": Facet("stories", ("_season",), ("^updated_at", "title"), ("bare_mention", "mentioned_race"), distinct=True),
    }


def _story_facets() -> dict[str, Facet]:
    return {
        "evidence": _evidence("story_id"),
        "entities": Facet("story_entities", ("story_id",), ("^confidence", "display_name"), ("entity",)),
        "publications": Facet("publications", ("_story",), ("-published_at", "^updated_at", "headline"), ("published_story",)),
    }


FACETS: dict[tuple[str, str], Facet] = {
    (target, name): spec
    for target, specs in (("session", _session_facets()), ("race", _race_facets()), ("driver", _driver_facets()), ("team", _team_facets()), ("season", _season_facets()), ("story", _story_facets()))
    for name, spec in specs.items()
}


def _widen(df: DataFrame, look: Lookup, tables: Mapping[str, DataFrame]) -> DataFrame:
    side = tables[look.table].select(F.col(look.remote).alias("__key"), *[F.col(old).alias(new) for new, old in look.columns])
    return df.select([c for c in df.columns if c not in side.columns or c == look.local]).join(side, F.col(look.local) == F.col("__key"), look.how).drop("__key")


def rows_of_all(tables: Mapping[str, DataFrame], spec: Facet) -> DataFrame:
    """The rows of a specification for all targets, with the target as ``_target``. A row whose scope names
    two targets is there for each."""
    rows = reduce(lambda df, hop: _widen(df, LOOKUPS[hop], tables), spec.lookups, tables[spec.table])
    if len(spec.scope) == 1:
        return rows.withColumn("_target", F.col(spec.scope[0])).where("_target is not null")
    return rows.withColumn("_target", F.explode(F.array_distinct(F.array_compact(F.array(*map(F.col, spec.scope))))))


def first_rows(tables: Mapping[str, DataFrame], target: str, first: int) -> DataFrame:
    """(facet, target, n, first_ids) of every facet of every target of a kind. The rank is limited before the
    shuffle, so a target with a third of all rows sends ``first`` rows a task."""

    def one(name: str, spec: Facet) -> DataFrame:
        rows = rows_of_all(tables, spec).withColumnRenamed("_target", "target")
        rows = rows.drop(*[c for c in rows.columns if c.startswith("_")])
        rows = rows.distinct() if spec.distinct else rows
        rank = F.row_number().over(Window.partitionBy("target").orderBy(*facet_order(target, name, rows.columns)))
        top = rows.select("target", F.col("id").cast("string").alias("id"), rank.alias("r")).where(F.col("r") <= first)
        ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",")
        sizes = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
        return sizes.join(top.groupBy("target").agg(ids.alias("first_ids")), "target").select(F.lit(name).alias("facet"), F.col("target").cast("string").alias("target"), "n", "first_ids")

    return reduce(DataFrame.unionByName, [one(name, spec) for (kind, name), spec in FACETS.items() if kind == target])


def select_rows(tables: Mapping[str, DataFrame], spec: Facet, key) -> DataFrame:
    """The rows of a specification for a target, with the columns that only serve the selection."""
    rows = reduce(lambda df, hop: _widen(df, LOOKUPS[hop], tables), spec.lookups, tables[spec.table])
    return rows.where(reduce(lambda a, b: a | b, [F.col(c) == F.lit(key) for c in spec.scope]))


def facet(tables: Mapping[str, DataFrame], target: str, name: str, key) -> DataFrame:
    """All rows of a facet. Tables without the facet's columns fail; an unknown facet is a KeyError.

    Without look-ups between the scope and the table the filter reaches the scan; with inner
    look-ups Catalyst pushes it through to the table that holds the scope."""
    spec = FACETS[target, name]
    rows = select_rows(tables, spec, key)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_")])
    return rows.distinct() if spec.distinct else rows


def facet_order(target: str, name: str, columns: list[str]) -> list[Column]:
    """The facet's order, made total by the row's id so that pages neither overlap nor miss a row."""

    def one(term: str) -> Column:
        col = F.coalesce("source_timestamp", "published_at", "captured_at") if term.endswith("_moment") else F.col(term.lstrip("-^"))
        return col.desc_nulls_last() if term[0] == "-" else col.desc_nulls_first() if term[0] == "^" else col.asc_nulls_last()

    terms = FACETS[target, name].order
    return [one(t) for t in terms] + ([F.col("id").asc_nulls_last()] if "id" in columns and "id" not in terms else [])


def facet_rows(tables: Mapping[str, DataFrame], target: str, name: str, key, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a facet with the total and the next offset."""
    rows = facet(tables, target, name, key)
    return page(rows, facet_order(target, name, rows.columns), offset, limit)


@query("orders", "customer", "nation", sql="""
SELECT year(o_orderdate) AS season, 'r' || month(o_orderdate) AS race_key, n_name AS team_name, count(*) AS results, max(o_totalprice) AS most
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3""")
def facet_season_results(orders, customer, nation):
    """DM29, AG10: the race results of all seasons, with orders as results and their months as races, by race and team."""
    rows = results_of_season(orders, customer, nation, F.col("season"))
    return rows.groupBy("season", "race_key", "team_name").agg(F.count(F.lit(1)).alias("results"), F.max("points").alias("most"))


@query("orders", "customer", "nation", sql="""
SELECT o_orderkey AS id, o_totalprice AS points, year(o_orderdate) AS season, month(o_orderdate) AS round, 'r' || month(o_orderdate) AS race_key, c_name AS driver_name, n_name AS team_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate IS NOT NULL""")
def facet_season_results_all(orders, customer, nation):
    """DM29: the same for every season; the key is the row's own."""
    return results_of_season(orders, customer, nation, F.col("season"))


def results_of_season(orders, customer, nation, season):
    number = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    entity = lambda df, key, name, kind: df.select(F.concat(F.lit(kind), key).alias("id"), F.lit(kind).alias("slug"), F.col(name).alias("display_name"))
    held = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    tables = {
        "races": orders.select(number.alias("id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round"), F.concat(F.lit("r"), F.month("o_orderdate")).alias("slug"), F.lit("").alias("official_name")).distinct(),
        "race_results": held.select(F.col("o_orderkey").alias("id"), number.alias("race_id"), F.concat(F.lit("d"), "o_custkey").alias("driver_entity_id"), F.concat(F.lit("t"), "c_nationkey").alias("team_entity_id"), F.col("o_totalprice").alias("points")),
        "entities": entity(customer, "c_custkey", "c_name", "d").unionByName(entity(nation, "n_nationkey", "n_name", "t")),
    }
    return facet(tables, "season", "race_results", season).select("id", "points", "season", "round", "race_key", "driver_name", "team_name")
