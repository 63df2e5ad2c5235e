"""Driver statistics on results made of orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.operators.statistics import driver_statistics

from .registry import query

_STATUS = ("Finished", "+1  Lap", "LAPPED", "Engine", "Did not   start", "withdrew", "Disqualified", "Excluded from results", "Classified", None)
_MEASURES = """
SELECT {by}, count(*) AS race_entries, count(*) FILTER (cls <> 'dns') AS starts, count(*) FILTER (finish_position = 1) AS wins, count(*) FILTER (finish_position <= 3) AS podiums,
  count(DISTINCT CASE WHEN grid_position = 1 THEN season * 100 + round END) AS poles, count(*) FILTER (fastest_lap_rank = 1) AS fastest_laps, count(*) FILTER (cls = 'classified') AS classified_finishes,
  count(*) FILTER (cls = 'dnf') AS dnfs, count(*) FILTER (cls = 'dns') AS dns, count(*) FILTER (cls = 'dsq') AS dsqs, sum(points) AS race_points,
  sum(grid_position - finish_position) FILTER (cls <> 'dns' AND grid_position > 0) AS positions_gained, avg(grid_position) FILTER (cls <> 'dns' AND grid_position > 0) AS average_grid,
  avg(finish_position) FILTER (cls = 'classified') AS average_finish, avg(finish_position) FILTER (cls <> 'dns') AS average_classification_position FROM races GROUP BY {by}"""
_INPUTS = """
WITH races AS (SELECT *, CASE WHEN regexp_matches(s, '^(did not start|did not qualify|did not prequalify|withdrawn|withdrew)') THEN 'dns' WHEN regexp_matches(s, '^(disqualified|excluded)') THEN 'dsq'
    WHEN s IN ('finished', 'classified', 'lapped') OR starts_with(s, '+') THEN 'classified' ELSE 'dnf' END AS cls FROM (
  SELECT o_custkey AS driver, year(o_orderdate) AS season, month(o_orderdate) AS round, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 7 + 1 END AS finish_position, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 6 END AS grid_position,
    (o_orderkey % 26)::BIGINT AS points, o_orderkey % 5 AS fastest_lap_rank,
    coalesce(lower(regexp_replace(['Finished', '+1  Lap', 'LAPPED', 'Engine', 'Did not   start', 'withdrew', 'Disqualified', 'Excluded from results', 'Classified', NULL][1 + o_orderkey % 10], '\\s+', ' ', 'g')), '') AS s FROM orders)),
sprints AS (SELECT o_custkey AS driver, year(o_orderdate) AS season, month(o_orderdate) AS round, l_linenumber AS finish_position, (l_quantity::BIGINT % 9) AS points, l_returnflag = 'N' AS dns FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 5),
quali AS (SELECT o_custkey AS driver, year(o_orderdate) AS season, month(o_orderdate) AS round, o_orderkey % 4 AS position FROM orders WHERE o_orderstatus <> 'P'),
standings AS (SELECT driver, season, after_round, position, points, done FROM (SELECT o_custkey AS driver, year(o_orderdate) AS season, month(o_orderdate) AS after_round, o_orderkey % 3 + 1 AS position, (o_orderkey % 400)::BIGINT AS points, o_orderkey % 2 = 0 AS done,
  row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY month(o_orderdate) DESC, o_orderkey % 3, o_orderkey % 400 DESC, (o_orderkey % 2 = 0) DESC) AS k FROM orders WHERE o_orderkey % 5 = 0) WHERE k = 1),
won AS (SELECT driver, season, round, points FROM races UNION ALL SELECT driver, season, round, points FROM sprints),
total AS (SELECT driver, season, sum(points) AS points FROM (SELECT w.driver, w.season, w.points FROM won w LEFT JOIN standings s USING (driver, season) WHERE s.driver IS NULL OR w.round > s.after_round UNION ALL SELECT driver, season, points FROM standings) GROUP BY 1, 2)"""
_NAMES = "race_entries starts wins podiums poles fastest_laps classified_finishes dnfs dns dsqs positions_gained".split()


def _sql(by: str, seasonal: bool) -> str:
    zero = lambda c, t: f"coalesce({t}.{c}, 0)::BIGINT AS {c}"
    keys = by.split(", ")
    same = lambda t: " AND ".join(f"k.{c} = {t}.{c}" for c in keys)
    extra = ", st.position AS position, coalesce(st.done, false) AS season_complete" if seasonal else ""
    placed = ", max(position) AS position, bool_or(done) AS done" if seasonal else ""
    return f"""{_INPUTS},
m AS ({_MEASURES.format(by=by)}),
sp AS (SELECT {by}, count(*) AS sprint_entries, count(*) FILTER (NOT dns) AS sprint_starts, count(*) FILTER (finish_position = 1) AS sprint_wins, count(*) FILTER (finish_position <= 3) AS sprint_top3s, sum(points) AS sprint_points FROM sprints GROUP BY {by}),
q AS (SELECT {by}, count(DISTINCT CASE WHEN position = 1 THEN season * 100 + round END) AS qualifying_p1s FROM quali GROUP BY {by}),
st AS (SELECT {by}, count(*) FILTER (position = 1 AND done) AS championships{placed} FROM standings GROUP BY {by}),
pt AS (SELECT {by}, sum(points) AS points FROM total GROUP BY {by}),
k AS (SELECT {by} FROM m UNION SELECT {by} FROM sp UNION SELECT {by} FROM q UNION SELECT {by} FROM st)
SELECT {", ".join(f"k.{c}" for c in keys)}, {", ".join(zero(c, "m") for c in _NAMES)}, {zero("qualifying_p1s", "q")}, {zero("championships", "st")}, {", ".join(zero(c, "sp") for c in ("sprint_entries", "sprint_starts", "sprint_wins", "sprint_top3s"))},
  {zero("points", "pt")}, {zero("race_points", "m")}, {zero("sprint_points", "sp")}, (coalesce(pt.points, 0) - coalesce(m.race_points, 0) - coalesce(sp.sprint_points, 0))::BIGINT AS points_adjustment,
  round(average_grid, 6) AS average_grid, round(average_finish, 6) AS average_finish, round(average_classification_position, 6) AS average_classification_position,
  round(m.wins * 1.0 / nullif(m.starts, 0), 6) AS win_rate, round(m.podiums * 1.0 / nullif(m.starts, 0), 6) AS podium_rate{extra}
FROM k LEFT JOIN m ON {same("m")} LEFT JOIN sp ON {same("sp")} LEFT JOIN q ON {same("q")} LEFT JOIN st ON {same("st")} LEFT JOIN pt ON {same("pt")}"""


def _statistics(orders, lineitem, by_season: bool):
    when = [F.col("o_custkey").alias("driver"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")]
    k = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in _STATUS]), (k % 10).cast("int"))
    races = orders.select(*when, F.when(k % 8 != 0, k % 7 + 1).alias("finish_position"), F.when(k % 9 != 0, k % 6).alias("grid_position"), (k % 26).alias("points"), status.alias("status"), (k % 5).alias("fastest_lap_rank"))
    lines = lineitem.where("l_linenumber <= 5").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("finish_position"), (F.col("l_quantity").cast("long") % 9).alias("points"), F.when(F.col("l_returnflag") == "N", "Did not start").otherwise("Finished").alias("status"))
    sprints = lines.join(orders, "o_orderkey").select(*when, "finish_position", "points", "status")
    qualifying = orders.where("o_orderstatus <> 'P'").select(*when, (k % 4).alias("position"))
    standings = orders.where(k % 5 == 0).select(when[0], when[1], F.month("o_orderdate").alias("after_round"), (k % 3 + 1).alias("position"), (k % 400).alias("points"), (k % 2 == 0).alias("season_complete"))
    out = driver_statistics(races, qualifying, sprints, standings, by_season)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("orders", "lineitem", sql=_sql("driver", False))
def driver_measures(orders, lineitem):
    """AG01-AG04, DM01: the 26 measures of every driver."""
    return _statistics(orders, lineitem, False)


@query("orders", "lineitem", sql=_sql("driver, season", True))
def driver_season_measures(orders, lineitem):
    """AG01, AG02, DM02: the same by season, with the standing's position and whether the season is complete."""
    return _statistics(orders, lineitem, True)
