"""Timing tower and track map at one instant a session, for all sessions at once.

Each kind of sample is reduced to its latest row of a session and car by one conditional aggregation, which combines before the shuffle, and
joined to the entries; no sample is ranked or sorted. Of samples of one time the one that is larger in its other columns counts, so a
repeated run makes the same choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.functions.results import tyre_token

CAR = ["session_id", "driver_number"]
#: a location is shown for this long
STALE_SECONDS = 3


def latest(samples: DataFrame, instants: DataFrame, on: str, columns: list[str], within: int | None = None, order: str | None = None) -> DataFrame:
    """(session_id, driver_number, columns) of the last sample with ``on`` at or before its session's instant, at most
    ``within`` seconds before it; with ``order``, of the largest value of that column instead."""
    rows = samples.join(instants, "session_id").where(F.col(on) <= F.col("at"))
    if within is not None:
        rows = rows.where(F.col(on) >= F.col("at") - F.make_dt_interval(secs=F.lit(within)))
    rank = F.struct(*[F.col(c) for c in dict.fromkeys(filter(None, (order, on, *columns)))])
    return rows.groupBy(*CAR).agg(F.max_by(F.struct(*columns), rank).alias("x")).select(*CAR, "x.*")


def gap_text(position: Column, text: Column, seconds: Column) -> Column:
    """LEADER for the first, else the text that was sent, else the seconds."""
    return F.when(position == 1, "LEADER").otherwise(F.coalesce(text, F.when(seconds.isNotNull(), F.format_string("%.3f", seconds))))


def tower(entries: DataFrame, instants: DataFrame, positions: DataFrame, intervals: DataFrame, laps: DataFrame, stints: DataFrame, pit_stops: DataFrame) -> DataFrame:
    """entries (session_id, driver_number) with position, gap, interval_seconds, lap_number, last_lap_seconds, stint_number, compound,
    tyre, tyre_age, pit_stops and ``place``; instants (session_id, at).

    The stint is the latest begun that covers the last lap; one without an end is open. A tyre's age is what it had and the laps since."""
    last_lap = latest(laps, instants, "started_at", ["lap_number", "lap_seconds"], order="lap_number")
    covering = stints.join(last_lap.select(*CAR, "lap_number"), CAR).where((F.col("lap_start") <= F.col("lap_number")) & (F.col("lap_end").isNull() | (F.col("lap_number") <= F.col("lap_end"))))
    tyre = F.struct("stint_number", "compound", "lap_start", "tyre_age_at_start")
    on = covering.groupBy(*CAR).agg(F.max(tyre).alias("s")).select(*CAR, "s.*")
    stops = pit_stops.join(instants, "session_id").where("observed_at <= at").groupBy(*CAR).agg(F.count(F.lit(1)).alias("stops"))
    rows = entries.select(*CAR).distinct().join(latest(positions, instants, "observed_at", ["position"]), CAR, "left")
    rows = rows.join(latest(intervals, instants, "observed_at", ["gap_seconds", "gap_text", "interval_seconds"]), CAR, "left").join(last_lap, CAR, "left").join(on, CAR, "left").join(stops, CAR, "left")
    age = F.col("tyre_age_at_start") + F.col("lap_number") - F.col("lap_start")
    return rows.select(
        *CAR, "position", gap_text(F.col("position"), F.col("gap_text"), F.col("gap_seconds")).alias("gap"), "interval_seconds", "lap_number", F.col("lap_seconds").alias("last_lap_seconds"),
        "stint_number", "compound", tyre_token(F.col("compound")).alias("tyre"), age.alias("tyre_age"), F.coalesce("stops", F.lit(0)).alias("pit_stops"),
    )


def track_map(entries: DataFrame, instants: DataFrame, locations: DataFrame, positions: DataFrame, laps: DataFrame) -> DataFrame:
    """Where the cars with a fresh location are: entries with observed_at, x, y, z, position, lap_number and the session's bounds."""
    here = latest(locations, instants, "observed_at", ["observed_at", "x", "y", "z"], STALE_SECONDS)
    bounds = locations.groupBy("session_id").agg(*[f(c).alias(f"{name}_{c}") for c in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))])
    started = laps.where("started_at is not null").withColumn("lap_seconds", F.lit(None).cast("double"))
    last_lap = latest(started, instants, "started_at", ["lap_number"], order="lap_number")
    rows = entries.select(*CAR).distinct().join(here, CAR).join(latest(positions, instants, "observed_at", ["position"]), CAR, "left").join(last_lap, CAR, "left")
    return rows.join(bounds, "session_id")


def reference_paths(laps: DataFrame, locations: DataFrame) -> DataFrame:
    """The locations of each session's fastest lap that isn't an out-lap: (session_id, driver_number, lap_number, observed_at, x, y, z).
    Of equal laps the smallest car and lap count. One lap a session is all that the samples are joined with."""
    clean = laps.where("started_at is not null and lap_seconds is not null and not coalesce(is_pit_out_lap, true)")
    best = clean.groupBy("session_id").agg(F.min(F.struct("lap_seconds", "driver_number", "lap_number", "started_at")).alias("b")).select("session_id", "b.*")
    until = F.col("started_at") + F.make_dt_interval(secs=F.col("lap_seconds").cast("decimal(18,6)"))
    return locations.join(best, CAR).where((F.col("observed_at") >= F.col("started_at")) & (F.col("observed_at") <= until)).select(*CAR, "lap_number", "observed_at", "x", "y", "z")
