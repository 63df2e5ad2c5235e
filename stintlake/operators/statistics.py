"""Career and season statistics of drivers: one pass of conditional aggregates over each kind of result.

Inputs are races (driver, season, round, finish_position, grid_position, points, status, fastest_lap_rank), qualifying (driver, season,
round, position), sprints (driver, season, round, finish_position, points, status) and standings (driver, season, after_round, position,
points, season_complete), of which the latest of a driver and season counts. Each is aggregated to one row a
driver (or driver and season) before they are joined, so nothing fans out.

A standing's points replace those of the rounds that it covers, sprints included; rounds after it are added. A driver known from any of
the four has a row; counts without rows are 0, averages and rates null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.functions.results import status_class

from .core import safe_ratio

COUNTS = (
    "race_entries", "starts", "wins", "podiums", "poles", "qualifying_p1s", "fastest_laps", "classified_finishes", "dnfs", "dns", "dsqs", "sprint_entries", "sprint_starts", "sprint_wins", "sprint_top3s",
    "positions_gained", "championships",
)
POINTS = ("points", "race_points", "sprint_points", "points_adjustment")
RATES = ("average_grid", "average_finish", "average_classification_position", "win_rate", "podium_rate")


def latest_standings(standings: DataFrame) -> DataFrame:
    """The standing after the latest round of each driver and season; of several of one round the best placed."""
    body = F.struct("after_round", (-F.col("position")).alias("p"), "points", F.coalesce("season_complete", F.lit(False)).alias("season_complete"))
    last = standings.groupBy("driver", "season").agg(F.max(body).alias("s"))
    return last.select("driver", "season", F.col("s.after_round").alias("after_round"), (-F.col("s.p")).alias("position"), F.col("s.points").alias("standing_points"), F.col("s.season_complete").alias("season_complete"))


def _counted(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _race_measures(races: DataFrame, by: list[str]) -> DataFrame:
    kind, finish, grid = F.col("class"), F.col("finish_position"), F.col("grid_position")
    started = kind != "dns"
    on_grid = F.when(started & (grid > 0), grid)
    return races.withColumn("class", status_class(F.col("status"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("race_entries"), _counted(started).alias("starts"), _counted(finish == 1).alias("wins"), _counted(finish <= 3).alias("podiums"),
        F.countDistinct(F.when(grid == 1, F.struct("season", "round"))).alias("poles"), _counted(F.col("fastest_lap_rank") == 1).alias("fastest_laps"),
        _counted(kind == "classified").alias("classified_finishes"), _counted(kind == "dnf").alias("dnfs"), _counted(kind == "dns").alias("dns"), _counted(kind == "dsq").alias("dsqs"),
        F.sum("points").alias("race_points"), F.sum(on_grid - finish).alias("positions_gained"), F.avg(on_grid).alias("average_grid"),
        F.avg(F.when(kind == "classified", finish)).alias("average_finish"), F.avg(F.when(started, finish)).alias("average_classification_position"),
    )


def _sprint_measures(sprints: DataFrame, by: list[str]) -> DataFrame:
    finish = F.col("finish_position")
    return sprints.withColumn("class", status_class(F.col("status"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sprint_entries"), _counted(F.col("class") != "dns").alias("sprint_starts"), _counted(finish == 1).alias("sprint_wins"), _counted(finish <= 3).alias("sprint_top3s"), F.sum("points").alias("sprint_points"),
    )


def _points(races: DataFrame, sprints: DataFrame, standings: DataFrame, by: list[str]) -> DataFrame:
    """Points by ``by``: standings with the rounds after them. Rounds are summed a (driver, season, round) first."""
    won = races.select("driver", "season", "round", "points").unionByName(sprints.select("driver", "season", "round", "points"))
    rounds = won.groupBy("driver", "season", "round").agg(F.sum("points").alias("points"))
    later = rounds.join(standings.select("driver", "season", "after_round"), ["driver", "season"], "left").where("after_round is null or round > after_round")
    both = later.select("driver", "season", "points").unionByName(standings.select("driver", "season", F.col("standing_points").alias("points")))
    return both.groupBy(*by).agg(F.sum("points").alias("points"))


def driver_statistics(races: DataFrame, qualifying: DataFrame, sprints: DataFrame, standings: DataFrame, by_season: bool = False) -> DataFrame:
    """The 26 measures of every driver, or of every driver and season with ``position`` and ``season_complete``."""
    by = ["driver", "season"] if by_season else ["driver"]
    standings = latest_standings(standings)
    first = F.when(F.col("position") == 1, F.struct("season", "round"))
    poles = qualifying.groupBy(*by).agg(F.countDistinct(first).alias("qualifying_p1s"))
    won = F.when((F.col("position") == 1) & F.col("season_complete"), F.col("season"))
    titles = [F.countDistinct(won).alias("championships")] + ([F.max("position").alias("position"), F.max("season_complete").alias("season_complete")] if by_season else [])
    parts = [_race_measures(races, by), _sprint_measures(sprints, by), poles, standings.groupBy(*by).agg(*titles), _points(races, sprints, standings, by)]
    wide = reduce(lambda a, b: a.join(b, by, "full"), parts)
    wide = wide.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], *[F.coalesce(c, F.lit(0)).alias(c) for c in POINTS[:3]], *RATES[:3], *(["position", F.coalesce("season_complete", F.lit(False)).alias("season_complete")] if by_season else []))
    return wide.withColumns({"points_adjustment": F.col("points") - F.col("race_points") - F.col("sprint_points"), "win_rate": safe_ratio(F.col("wins"), F.col("starts")), "podium_rate": safe_ratio(F.col("podiums"), F.col("starts"))})
