"""The unified timeline from a season down to a driver's laps, for all scopes of a level at once.

Every event has a coordinate: season, race, session, driver, stint, lap, as far as its precision goes. A level is a union of branches in
one schema with the column ``scope``: seasons show their races, races their sessions (but cancelled ones), sessions what race control said,
pit stops and overtakes, drivers of a session their laps and stints. ``first_of_scope`` orders a scope's events totally: those without a time
last, then by time, lap, stint and id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("scope", "event_id", "event_type", "label", "timeline_at", "precision", "season", "race_key", "session_code", "drivers", "driver_key", "stint_number", "lap_number")
LIMIT = 200


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _event(rows: DataFrame, kind: str, event_id: Column, label: Column, at: str, precision: Column, drivers: Column | None = None) -> DataFrame:
    none = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(
        F.col("scope").cast("string").alias("scope"), event_id.alias("event_id"), F.lit(kind).alias("event_type"), label.alias("label"), F.col(at).cast("timestamp_ntz").alias("timeline_at"), precision.alias("precision"),
        none("season", "int").cast("int").alias("season"), none("race_key", "string").alias("race_key"), none("session_code", "string").alias("session_code"),
        (F.array().cast("array<string>") if drivers is None else drivers).alias("drivers"), none("driver_key", "string").alias("driver_key"),
        none("stint_number", "int").cast("int").alias("stint_number"), none("lap_number", "int").cast("int").alias("lap_number"),
    )


def _placed(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of sessions with their coordinate."""
    races = tables["races"].select(F.col("id").alias("race_id"), "season", F.col("slug").alias("race_key"))
    sessions = tables["race_sessions"].join(races, "race_id").select(F.col("id").alias("session_id"), "season", "race_key", "session_code", "starts_at")
    return rows.join(sessions, "session_id")


def _named(rows: DataFrame, tables: dict[str, DataFrame], column: str, prefix: str) -> DataFrame:
    names = tables["entities"].select(F.col("id").alias(column), F.col("slug").alias(f"{prefix}_key"), F.col("display_name").alias(f"{prefix}_name"))
    return rows.join(names, column, "left")


def _driver(name: str, number: str) -> Column:
    return F.coalesce(name, F.concat(F.lit("Driver "), F.col(number).cast("string")))


def season_events(tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables["races"].withColumns({"scope": F.col("season"), "race_key": F.col("slug")})
    return _event(rows, "race", _text("race:", "id"), F.col("official_name"), "start_at", F.lit("race"))


def race_events(tables: dict[str, DataFrame]) -> DataFrame:
    sessions = tables["race_sessions"]
    live = sessions.where("not coalesce(is_cancelled, false)") if "is_cancelled" in sessions.columns else sessions
    rows = _placed(live.select(F.col("id").alias("session_id"), F.col("race_id").alias("scope"), "session_name"), tables)
    return _event(rows, "session", _text("session:", "session_id"), F.col("session_name"), "starts_at", F.lit("session"))


def session_events(tables: dict[str, DataFrame]) -> DataFrame:
    """``drivers`` holds those that an event concerns, so an overtake is found from both."""
    of = lambda *columns: F.array_distinct(F.array_compact(F.array(*map(F.col, columns))))
    own = lambda name: _named(_placed(tables[name].withColumn("scope", F.col("session_id")), tables), tables, "driver_entity_id", "driver")
    control, stops = own("session_race_control_events"), own("session_pit_stops")
    passes = _placed(tables["session_overtakes"].withColumn("scope", F.col("session_id")), tables)
    passes = _named(_named(passes, tables, "overtaking_driver_entity_id", "driver"), tables, "overtaken_driver_entity_id", "other")
    overtook = F.concat(_driver("driver_name", "overtaking_driver_number"), F.lit(" overtook "), _driver("other_name", "overtaken_driver_number"))
    return reduce(DataFrame.unionByName, [
        _event(control, "race_control", _text("race-control:", "id"), F.col("message"), "observed_at", F.when(F.col("lap_number").isNull(), "timestamp").otherwise("lap"), of("driver_entity_id")),
        _event(stops, "pit_stop", _text("pit-stop:", "id"), F.concat(_driver("driver_name", "provider_driver_number"), F.lit(" pit stop")), "observed_at", F.lit("lap"), of("driver_entity_id")),
        _event(passes, "overtake", _text("overtake:", "id"), overtook, "observed_at", F.lit("timestamp"), of("overtaking_driver_entity_id", "overtaken_driver_entity_id")),
    ])


def driver_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Laps and stints of the drivers of a session (scope ``session/driver``). A stint stands where its first lap began, or with the
    session's start where that lap isn't known; of several starts of one lap the earliest counts."""
    me = F.concat_ws("/", F.col("session_id").cast("string"), F.col("driver_entity_id"))
    known = lambda rows: _named(_placed(rows.where("driver_entity_id is not null"), tables), tables, "driver_entity_id", "driver").where("driver_name is not null").withColumn("scope", me)
    laps = tables["session_laps"]
    begun = laps.groupBy("session_id", "driver_entity_id", F.col("lap_number").alias("lap_start")).agg(F.min("started_at").alias("_begun"))
    stints = known(tables["session_stints"].join(begun, ["session_id", "driver_entity_id", "lap_start"], "left"))
    stints = stints.withColumns({"_at": F.coalesce("_begun", "starts_at"), "lap_number": F.col("lap_start")})
    numbered = lambda word, c: F.concat(F.col("driver_name"), F.lit(f" · {word} "), F.col(c).cast("string"))
    who = F.array("driver_entity_id")
    return _event(known(laps), "lap", _text("lap:", "id"), numbered("lap", "lap_number"), "started_at", F.lit("lap"), who).unionByName(_event(stints, "stint", _text("stint:", "id"), numbered("stint", "stint_number"), "_at", F.lit("stint"), who))


LEVELS = {"season": season_events, "race": race_events, "session": session_events, "driver": driver_events}


def of_driver(events: DataFrame, driver: str) -> DataFrame:
    return events.where(F.array_contains("drivers", driver))


def of_lap(events: DataFrame, lap: int, stints: DataFrame | None = None) -> DataFrame:
    """The events of a lap; with ``stints`` (id, lap_start, lap_end), also the stints that cover it, an open end covering none."""
    here = (F.col("lap_number") == lap) & (F.col("event_type") != "stint")
    if stints is None:
        return events.where(here)
    covering = stints.where(F.lit(lap).between(F.col("lap_start"), F.col("lap_end"))).select(_text("stint:", "id").alias("event_id")).distinct()
    return events.where(here).unionByName(events.where("event_type = 'stint'").join(covering, "event_id", "left_semi").select(events.columns))


def first_of_scope(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first events of every scope (the limit is the feature) with their ``place``; ranks are limited before the shuffle."""
    order = [F.col("timeline_at").isNull(), F.col("timeline_at"), F.coalesce("lap_number", F.lit(0)), F.coalesce("stint_number", F.lit(0)), F.col("event_id")]
    return events.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(*order))).where(F.col("place") <= limit)


def session_choices(tables: dict[str, DataFrame]) -> DataFrame:
    """The sessions of every race in order, for a picker: race_id, session_id, session_code, place, results, drivers, loaded. ``drivers`` counts those
    entered or timed, ``loaded`` says whether laps are there. Cancelled sessions are left out."""
    sessions = tables["race_sessions"]
    live = sessions.where("not coalesce(is_cancelled, false)") if "is_cancelled" in sessions.columns else sessions
    order = Window.partitionBy("race_id").orderBy(F.col("starts_at").asc_nulls_last(), "id")
    rows = live.select("race_id", F.col("id").alias("session_id"), "session_code", F.row_number().over(order).alias("place"))
    count = lambda name, out: tables[name].groupBy("session_id").agg(F.count(F.lit(1)).alias(out))
    seen = tables["session_entries"].select("session_id", "driver_entity_id").unionByName(tables["session_laps"].select("session_id", "driver_entity_id"))
    drivers = seen.groupBy("session_id").agg(F.countDistinct("driver_entity_id").alias("drivers"))
    rows = rows.join(count("session_results", "results"), "session_id", "left").join(drivers, "session_id", "left").join(count("session_laps", "laps"), "session_id", "left")
    return rows.select("race_id", "session_id", "session_code", "place", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("drivers", F.lit(0)).alias("drivers"), F.col("laps").isNotNull().alias("loaded"))


def session_drivers(tables: dict[str, DataFrame]) -> DataFrame:
    """The drivers of every session, for a picker: session_id, driver_entity_id, driver_key, driver_name, laps; those with a name alone."""
    laps = tables["session_laps"].groupBy("session_id", "driver_entity_id").agg(F.count(F.lit(1)).alias("laps"))
    seen = tables["session_entries"].select("session_id", "driver_entity_id").where("driver_entity_id is not null").distinct()
    rows = seen.join(laps.where("driver_entity_id is not null"), ["session_id", "driver_entity_id"], "full")
    named = tables["entities"].select(F.col("id").alias("driver_entity_id"), F.col("slug").alias("driver_key"), F.col("display_name").alias("driver_name"))
    return rows.join(named, "driver_entity_id").select("session_id", "driver_entity_id", "driver_key", "driver_name", F.coalesce("laps", F.lit(0)).alias("laps"))
