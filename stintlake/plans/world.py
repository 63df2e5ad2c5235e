"""Tables of a motorsport database derived from the given ones, and its facets, timelines and relations for all targets at once.

Orders stand for results, their months for race weekends, customers for drivers, their nations for teams and lines for what is timed. Each
table is one SELECT that reads alike in Spark and in the comparison, so both sides start from the same rows; what
is compared is the library's selection, order and limits against SQL written from the same declarations."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.operators import drilldown
from stintlake.operators import tower as towers
from stintlake.operators.canonical import deep_anchor
from stintlake.operators.shared import durable

from . import context, facets
from .registry import query

GIVEN = ("orders", "customer", "nation", "lineitem")
_TIMED = "SELECT id, race_id * 10 + 3 AS session_id, driver_entity_id, n AS {c}, at_ AS {d} FROM {{lines}} WHERE n <= {most}"

WORLD = {
    "held": """SELECT o_orderkey AS id, year(o_orderdate) * 100 + month(o_orderdate) AS race_id, year(o_orderdate) AS season, month(o_orderdate) AS round, 'd' || o_custkey AS driver_entity_id,
        't' || c_nationkey AS team_entity_id, o_orderdate AS at_, o_orderkey % 20 + 1 AS place FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey WHERE o_orderdate IS NOT NULL""",
    "lines": """SELECT l_orderkey * 10 + l_linenumber AS id, min(h.id) AS order_id, min(race_id) AS race_id, min(driver_entity_id) AS driver_entity_id, min(team_entity_id) AS team_entity_id, min(l_linenumber) AS n,
        min(l_shipdate) AS at_, min(l_suppkey) AS supp FROM {lineitem} JOIN {held} h ON h.id = l_orderkey GROUP BY l_orderkey * 10 + l_linenumber""",
    "races": "SELECT race_id AS id, min(season) AS season, min(round) AS round, 'r' || race_id AS slug, 'Race ' || race_id AS official_name, 'r' || race_id AS entity_id, min(at_) AS start_at, max(at_) AS weekend_end_date FROM {held} GROUP BY race_id",
    "race_sessions": " UNION ALL ".join(
        f"SELECT id * 10 + {k} AS id, id AS race_id, '{code}' AS session_code, '{name}' AS session_name, start_at + INTERVAL {k} HOUR AS starts_at, {k} AS sequence FROM {{races}}" for k, code, name in ((1, "practice_1", "Practice 1"), (2, "qualifying", "Qualifying"), (3, "race", "Race"))
    ),
    "entities": """SELECT 'd' || c_custkey AS id, 'driver-' || c_custkey AS slug, c_name AS display_name, 'person' AS entity_type, c_mktsegment AS metadata FROM {customer}
        UNION ALL SELECT 't' || n_nationkey, 'team-' || n_nationkey, n_name, 'team', n_name FROM {nation} UNION ALL SELECT entity_id, slug, official_name, 'race', slug FROM {races}""",
    "session_entries": "SELECT id, race_id * 10 + 1 + id % 3 AS session_id, CASE WHEN id % 13 <> 0 THEN driver_entity_id END AS driver_entity_id, CASE WHEN id % 17 <> 0 THEN team_entity_id END AS team_entity_id, id % 99 AS driver_number, 'x' AS team_name FROM {held}",
    "session_results": "SELECT id, race_id * 10 + 3 AS session_id, driver_entity_id, team_entity_id, CASE WHEN id % 9 <> 0 THEN place END AS position, id % 99 AS driver_number FROM {held}",
    "session_starting_grid": "SELECT id, race_id * 10 + 3 AS session_id, driver_entity_id, team_entity_id, place AS position FROM {held} WHERE id % 2 = 0",
    "session_laps": _TIMED.format(c="lap_number", d="started_at", most=7),
    "session_stints": """SELECT id, race_id * 10 + 3 AS session_id, driver_entity_id, n AS stint_number, at_ AS fetched_at, CASE WHEN n = 1 THEN 1 WHEN id % 3 = 0 THEN 40 ELSE 3 END AS lap_start,
        CASE WHEN n = 1 THEN 2 WHEN id % 2 = 0 THEN 50 END AS lap_end FROM {lines} WHERE n <= 2""",
    "session_positions": _TIMED.format(c="position", d="observed_at", most=4),
    "session_intervals": _TIMED.format(c="gap", d="observed_at", most=5),
    "session_pit_stops": "SELECT id, race_id * 10 + 3 AS session_id, CASE WHEN id % 7 <> 0 THEN driver_entity_id END AS driver_entity_id, n AS lap_number, at_ AS observed_at, id % 99 AS provider_driver_number FROM {lines} WHERE n > 4",
    "session_overtakes": """SELECT id, race_id * 10 + 3 AS session_id, driver_entity_id AS overtaking_driver_entity_id, CASE WHEN supp % 5 = 0 THEN driver_entity_id ELSE 'd' || supp END AS overtaken_driver_entity_id,
        CASE WHEN id % 6 <> 0 THEN at_ END AS observed_at, id % 99 AS overtaking_driver_number, supp AS overtaken_driver_number FROM {lines} WHERE n <= 2""",
    "session_race_control_events": "SELECT id, race_id * 10 + 1 + id % 3 AS session_id, CASE WHEN id % 4 <> 0 THEN driver_entity_id END AS driver_entity_id, at_ AS observed_at, 'Flag for ' || supp AS message, CASE WHEN id % 3 <> 0 THEN n END AS lap_number FROM {lines} WHERE n = 1",
    "session_weather": "SELECT id, race_id * 10 + 3 AS session_id, at_ AS observed_at FROM {lines} WHERE n = 2",
    "race_results": "SELECT id, race_id, driver_entity_id, team_entity_id, CASE WHEN id % 9 <> 0 THEN place END AS finish_position, at_ AS fetched_at FROM {held}",
    "qualifying_results": "SELECT id, race_id, driver_entity_id, team_entity_id, place AS position FROM {held} WHERE id % 2 = 1",
    "driver_standings_snapshots": "SELECT id, season, round AS after_round, start_at AS fetched_at, slug AS source_url FROM {races}",
    "constructor_standings_snapshots": "SELECT id, season, round AS after_round, start_at AS fetched_at, slug AS source_url FROM {races}",
    "driver_standing_rows": "SELECT id, race_id AS snapshot_id, driver_entity_id FROM {held}",
    "constructor_standing_rows": "SELECT id, race_id AS snapshot_id, team_entity_id FROM {held}",
    "stories": "SELECT 's' || id AS id, 'Story ' || id AS title, 'story-' || id AS slug, CASE WHEN id % 25 <> 0 THEN at_ END AS updated_at FROM {held} WHERE id % 5 = 0",
    "story_entities": """SELECT id * 10 + 1 AS id, 's' || id AS story_id, driver_entity_id AS entity_id, 'subject' AS relation_type, id % 100 AS confidence FROM {held} WHERE id % 5 = 0
        UNION ALL SELECT id * 10 + 2, 's' || id, team_entity_id, 'mentioned', 50 FROM {held} WHERE id % 5 = 0 UNION ALL SELECT id * 10 + 3, 's' || id, 'r' || race_id, 'context', 70 FROM {held} WHERE id % 10 = 0""",
    "race_documents": "SELECT id, race_id, at_ AS published_at, at_ AS created_at, id % 50 AS document_number, 'Document ' || id AS title, CASE WHEN id % 3 = 0 THEN 'x' || id END AS external_id FROM {held} WHERE id % 4 = 0",
    "race_document_entities": """SELECT id AS race_document_id, driver_entity_id AS entity_id, 'a' AS matched_alias, 'exact' AS match_method, 90 AS confidence FROM {held} WHERE id % 4 = 0
        UNION ALL SELECT id, team_entity_id, 'b', 'alias', 80 FROM {held} WHERE id % 8 = 0""",
    "publications": "SELECT 'p' || id AS id, at_ AS published_at, at_ AS updated_at, at_ AS created_at, 'Headline ' || id AS headline, 'pub-' || id AS slug FROM {held} WHERE id % 10 = 0",
    "publication_stories": "SELECT 'p' || id AS publication_id, 's' || id AS story_id FROM {held} WHERE id % 10 = 0",
    "evidence": """SELECT id, race_id * 10 + 3 AS session_id, race_id, driver_entity_id, team_entity_id, CASE WHEN order_id % 5 = 0 THEN 's' || order_id END AS story_id, CASE WHEN id % 3 = 0 THEN at_ END AS source_timestamp,
        CASE WHEN id % 2 = 0 THEN at_ + INTERVAL 1 DAY END AS published_at, CASE WHEN id % 11 <> 0 THEN at_ + INTERVAL 2 DAY END AS captured_at, at_ AS created_at, CASE WHEN id % 2 = 0 THEN 'Claim ' || id END AS normalized_claim,
        CASE WHEN id % 3 = 0 THEN 'Excerpt ' || id END AS raw_excerpt_or_reference, 'Source' AS source_name FROM {lines} WHERE n = 3""",
    "roster": "SELECT driver_entity_id, team_entity_id, CASE WHEN id % 3 = 0 THEN 'principal' ELSE 'driver' END AS role FROM {held} WHERE id % 7 = 0",
}


#: tables that others are made of
_ROOTS = ("held", "lines", "races")


def tables_of(*given: DataFrame, kept: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The tables; of those that the ``kept`` ones are made of, the roots are written once and read back, so that a query of many
    parts doesn't compute them in each, and knows which of them are small."""
    out = dict(zip(GIVEN, given, strict=True))
    spark = given[0].sparkSession
    written = _made_of(kept) & set(_ROOTS)
    for name, sql in WORLD.items():
        out[name] = spark.sql(sql, **{t: out[t] for t in set(re.findall(r"\{(\w+)\}", sql))})
        if name in written:
            out[name] = durable(out[name])
    return out


def _made_of(needed: Iterable[str]) -> set[str]:
    """The needed tables and what they are made of."""
    wanted, open_ = set(), list(needed)
    while open_:
        name = open_.pop()
        if name in WORLD and name not in wanted:
            wanted.add(name)
            open_ += re.findall(r"\{(\w+)\}", WORLD[name])
    return wanted


def _read_by(specs: Iterable[facets.Facet]) -> set[str]:
    """The tables that specifications read."""
    return {name for spec in specs for name in (spec.table, *(facets.LOOKUPS[hop].table for hop in spec.lookups))}


def with_tables(needed: Iterable[str]) -> str:
    """The WITH clause that defines the needed tables and what they are made of."""
    wanted = _made_of(needed)
    return "WITH " + ",\n".join(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', sql)})" for name, sql in WORLD.items() if name in wanted)


# SQL from the declarations

_KEYWORDS = frozenset("if null concat replace coalesce cast as string is".split())
_PLACES = {"-": "DESC NULLS LAST", "^": "DESC NULLS FIRST"}
_MOMENT = "coalesce(b.source_timestamp, b.published_at, b.captured_at)"


class _Select:
    """The joins of a specification and where its columns come from."""

    def __init__(self, spec: facets.Facet) -> None:
        self.spec, self.place, self.tables = spec, {}, {spec.table}
        self.source = f"{spec.table} b"
        for k, hop in enumerate(spec.lookups):
            look = facets.LOOKUPS[hop]
            self.tables.add(look.table)
            self.source += f" {look.how.upper()} JOIN {look.table} j{k} ON {self.column(look.local)} = j{k}.{look.remote}"
            self.place |= {new: f"j{k}.{old}" for new, old in look.columns}

    def column(self, name: str) -> str:
        return self.place.get(name, f"b.{name}")

    def expression(self, text: str) -> str:
        parts = re.split(r"('[^']*')", text)
        return "".join(p if p.startswith("'") else re.sub(r"\b[a-z_]+\b", lambda m: m.group() if m.group() in _KEYWORDS else self.column(m.group()), p) for p in parts)

    def keyed(self, values: str) -> str:
        """Rows with their target as ``k``; a row of two different targets counts for both."""
        first, *more = map(self.column, self.spec.scope)
        sql = f"SELECT {'DISTINCT ' if self.spec.distinct else ''}{first} AS k, {values} FROM {self.source} WHERE {first} IS NOT NULL"
        for other in more:
            sql += f" UNION ALL SELECT {other} AS k, {values} FROM {self.source} WHERE {other} IS NOT NULL AND {other} IS DISTINCT FROM {first}"
        return sql


def _facet_sql(target: str) -> str:
    parts, tables = [], set()
    for (kind, name), spec in facets.FACETS.items():
        if kind != target:
            continue
        made = _Select(spec)
        tables |= made.tables
        terms = [(_MOMENT if t.endswith("_moment") else made.column(t.lstrip("-^")), _PLACES.get(t[0], "ASC NULLS LAST")) for t in spec.order]
        values = ", ".join(["b.id AS id", *(f"{e} AS o{k}" for k, (e, _) in enumerate(terms))])
        order = ", ".join([*(f"o{k} {p}" for k, (_, p) in enumerate(terms)), "id"])
        parts.append(f"SELECT '{name}' AS facet, CAST(k AS VARCHAR) AS target, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= {FIRST}) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS r FROM ({made.keyed(values)})) GROUP BY k")
    return f"{with_tables(tables)}\n" + "\nUNION ALL ".join(parts)


def _timeline_sql(target: str) -> str:
    parts, tables = [], {"races"}
    for branch in context.TIMELINES[target]:
        made = _Select(branch.rows)
        tables |= made.tables
        at, place = [], made.column
        if branch.race:
            made.source += " JOIN races w ON b.race_id = w.id"
            made.place |= {"_start": "w.start_at", "_end": "w.weekend_end_date"}
        at = f"coalesce({', '.join(map(place, branch.at))})"
        values = f"CAST(b.id AS VARCHAR) AS event_id, {at} AS occurred_at, {made.expression(branch.label)} AS label, CAST({made.expression(branch.leads_to[0])} AS VARCHAR) AS target_type, CAST({made.expression(branch.leads_to[1])} AS VARCHAR) AS target_key"
        if branch.kind == "race_result" and target == "team":
            values = values.replace("CAST(b.id AS VARCHAR) AS event_id", "'team-race:' || b.race_id AS event_id, b.finish_position AS p, b.id AS i")
            rows = f"SELECT k, event_id, occurred_at, label, target_type, target_key FROM ({made.keyed(values)}) QUALIFY row_number() OVER (PARTITION BY k, event_id ORDER BY p NULLS LAST, i) = 1"
        else:
            rows = made.keyed(values)
        parts.append(f"SELECT '{branch.kind}' AS event_type, * FROM ({rows}) WHERE occurred_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY occurred_at DESC, event_id) <= {context.PER_TYPE}")
    union = "\nUNION ALL ".join(parts)
    return f"{with_tables(tables)}\nSELECT CAST(k AS VARCHAR) AS target, event_type, event_id, occurred_at, label, target_type, target_key FROM ({union}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY occurred_at DESC, event_type, event_id) <= {context.TOTAL}"


FIRST = 3


def _register(target: str) -> None:
    @query(*GIVEN, sql=_facet_sql(target), name=f"facets_of_every_{target}")
    def all_facets(*given):
        tables = tables_of(*given, kept=_read_by(spec for (kind, _), spec in facets.FACETS.items() if kind == target))
        return facets.first_rows(tables, target, FIRST)

    all_facets.__doc__ = f"DM29, DM25: size and first rows of every facet of every {target}."

    @query(*GIVEN, sql=_timeline_sql(target), name=f"timeline_of_every_{target}")
    def all_timelines(*given):
        tables = tables_of(*given, kept=_read_by(b.rows for b in context.TIMELINES[target]) | {"races"})
        return context.timelines(tables, target).withColumn("target", F.col("target").cast("string"))

    all_timelines.__doc__ = f"DM27: the newest twelve events of a kind, thirty in all, of every {target} (the limits are the feature)."


for _target in context.TIMELINES:
    _register(_target)


@query(*GIVEN, sql=with_tables(["roster", "session_entries", "race_sessions"]) + """,
seen AS (SELECT driver_entity_id AS d, team_entity_id AS t, count(DISTINCT session_id) AS sessions, min(starts_at) AS first_at, max(starts_at) AS last_at FROM session_entries e JOIN race_sessions s ON s.id = e.session_id WHERE driver_entity_id IS NOT NULL AND team_entity_id IS NOT NULL GROUP BY 1, 2),
known AS (SELECT DISTINCT driver_entity_id AS d, team_entity_id AS t, role FROM roster WHERE driver_entity_id IS NOT NULL AND team_entity_id IS NOT NULL)
SELECT d AS entity_id, t AS related_id, 'participated_for' AS relation, sessions, first_at, last_at FROM seen UNION ALL SELECT t, d, 'fielded_driver', sessions, first_at, last_at FROM seen
UNION ALL SELECT DISTINCT d, t, 'roster_driver_for', NULL, NULL::TIMESTAMP, NULL::TIMESTAMP FROM known UNION ALL SELECT DISTINCT t, d, CASE role WHEN 'driver' THEN 'has_roster_driver' ELSE 'has_team_member' END, NULL, NULL, NULL FROM known""")
def relations_of_all(*given):
    """DM24: declared and observed relations of every driver and team."""
    tables = tables_of(*given)
    return context.relations(tables, "driver").unionByName(context.relations(tables, "team")).select("entity_id", "related_id", "relation", "sessions", "first_at", "last_at")


@query(*GIVEN, sql=with_tables(["races", "race_sessions"]) + """,
placed AS (SELECT s.id, s.race_id, r.season, strftime(s.starts_at, '%Y-%m-%d %H:%M:%S') AS p FROM race_sessions s JOIN races r ON r.id = s.race_id)
SELECT 'race:' || id AS source, 'part_of_season' AS relation, 'season:' || season AS target, round::VARCHAR AS position FROM races UNION ALL SELECT 'season:' || season, 'has_race', 'race:' || id, round::VARCHAR FROM races
UNION ALL SELECT 'race:' || race_id, 'has_session', 'session:' || id, p FROM placed UNION ALL SELECT 'session:' || id, 'part_of_race', 'race:' || race_id, p FROM placed UNION ALL SELECT 'session:' || id, 'part_of_season', 'season:' || season, p FROM placed""")
def structure_of_all(*given):
    """DM24, DX02: the fixed relations of seasons, races and sessions."""
    return context.structure(tables_of(*given))


_COORDINATE = "w.season, w.race_key, w.session_code"
_DRILL = """,
w AS (SELECT s.id AS session_id, s.race_id, s.session_code, s.session_name, s.starts_at, r.season, r.slug AS race_key FROM race_sessions s JOIN races r ON r.id = s.race_id),
e AS ({events})
SELECT scope, event_id, event_type, label, timeline_at, precision, season::INTEGER AS season, race_key, session_code, who AS drivers, driver_key, stint::INTEGER AS stint_number, lap::INTEGER AS lap_number, place FROM (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY timeline_at NULLS LAST, coalesce(lap, 0), coalesce(stint, 0), event_id) AS place FROM e) WHERE place <= 20"""
_NONE = "'' AS who, NULL AS driver_key, NULL::INTEGER AS stint, NULL::INTEGER AS lap"
_LEVELS = {
    "season": (["races", "race_sessions"], f"SELECT season::VARCHAR AS scope, 'race:' || id AS event_id, 'race' AS event_type, official_name AS label, start_at AS timeline_at, 'race' AS precision, season, slug AS race_key, NULL AS session_code, {_NONE} FROM races"),
    "race": (["races", "race_sessions"], f"SELECT race_id::VARCHAR AS scope, 'session:' || session_id AS event_id, 'session' AS event_type, session_name AS label, starts_at AS timeline_at, 'session' AS precision, {_COORDINATE}, {_NONE} FROM w"),
    "session": (["races", "race_sessions", "entities", "session_race_control_events", "session_pit_stops", "session_overtakes"], f"""
  SELECT b.session_id::VARCHAR AS scope, 'race-control:' || b.id AS event_id, 'race_control' AS event_type, message AS label, observed_at AS timeline_at, CASE WHEN lap_number IS NULL THEN 'timestamp' ELSE 'lap' END AS precision, {_COORDINATE},
    coalesce(driver_entity_id, '') AS who, d.slug AS driver_key, NULL::INTEGER AS stint, lap_number AS lap FROM session_race_control_events b JOIN w USING (session_id) LEFT JOIN entities d ON d.id = driver_entity_id
  UNION ALL SELECT b.session_id::VARCHAR, 'pit-stop:' || b.id, 'pit_stop', coalesce(d.display_name, 'Driver ' || provider_driver_number) || ' pit stop', observed_at, 'lap', {_COORDINATE}, coalesce(driver_entity_id, ''), d.slug, NULL, lap_number
    FROM session_pit_stops b JOIN w USING (session_id) LEFT JOIN entities d ON d.id = driver_entity_id
  UNION ALL SELECT b.session_id::VARCHAR, 'overtake:' || b.id, 'overtake', coalesce(d.display_name, 'Driver ' || overtaking_driver_number) || ' overtook ' || coalesce(o.display_name, 'Driver ' || overtaken_driver_number), observed_at, 'timestamp', {_COORDINATE},
    CASE WHEN overtaken_driver_entity_id IS DISTINCT FROM overtaking_driver_entity_id THEN concat_ws('|', overtaking_driver_entity_id, overtaken_driver_entity_id) ELSE coalesce(overtaking_driver_entity_id, '') END, d.slug, NULL, NULL
    FROM session_overtakes b JOIN w USING (session_id) LEFT JOIN entities d ON d.id = overtaking_driver_entity_id LEFT JOIN entities o ON o.id = overtaken_driver_entity_id"""),
    "driver": (["races", "race_sessions", "entities", "session_laps", "session_stints"], f"""
  SELECT b.session_id || '/' || driver_entity_id AS scope, 'lap:' || b.id AS event_id, 'lap' AS event_type, d.display_name || ' · lap ' || lap_number AS label, started_at AS timeline_at, 'lap' AS precision, {_COORDINATE}, driver_entity_id AS who, d.slug AS driver_key, NULL::INTEGER AS stint, lap_number AS lap
    FROM session_laps b JOIN w USING (session_id) JOIN entities d ON d.id = driver_entity_id
  UNION ALL SELECT b.session_id || '/' || b.driver_entity_id, 'stint:' || b.id, 'stint', d.display_name || ' · stint ' || stint_number,
    coalesce((SELECT min(started_at) FROM session_laps l WHERE l.session_id = b.session_id AND l.driver_entity_id = b.driver_entity_id AND l.lap_number = b.lap_start), w.starts_at), 'stint', {_COORDINATE}, b.driver_entity_id, d.slug, stint_number, lap_start
    FROM session_stints b JOIN w USING (session_id) JOIN entities d ON d.id = b.driver_entity_id"""),
}


def _register_level(level: str) -> None:
    needed, events = _LEVELS[level]

    @query(*GIVEN, sql=with_tables(needed) + _DRILL.format(events=events), name=f"drilldown_{level}")
    def drill(*given):
        rows = drilldown.first_of_scope(drilldown.LEVELS[level](tables_of(*given)), 20)
        return rows.withColumn("drivers", F.array_join("drivers", "|"))

    drill.__doc__ = f"DM31, DX06-DX09: the first twenty events of every {level} in the timeline's total order (the limit is the feature)."


for _level in _LEVELS:
    _register_level(_level)


# sessions of one day each, timed by events

TIMING = {
    "samples": "SELECT user_id % 20 AS driver_number, year(ts) * 10000 + month(ts) * 100 + day(ts) AS session_id, ts AS observed_at, event_id AS id, value FROM {events}",
    "instants": "SELECT session_id, max(observed_at) - INTERVAL 2 HOUR AS at_ FROM {samples} GROUP BY session_id",
    "entries": "SELECT DISTINCT session_id, driver_number FROM {samples}",
    "positions": "SELECT session_id, driver_number, observed_at, id % 20 + 1 AS position FROM {samples} WHERE id % 5 = 0",
    "intervals": "SELECT session_id, driver_number, observed_at, CASE WHEN id % 3 <> 0 THEN value END AS gap_seconds, CASE WHEN id % 3 = 0 THEN '+1 LAP' END AS gap_text, value AS interval_seconds FROM {samples} WHERE id % 5 = 1",
    "laps": "SELECT session_id, driver_number, id % 50 + 1 AS lap_number, CASE WHEN id % 4 <> 0 THEN observed_at END AS started_at, CASE WHEN id % 7 <> 0 THEN value * 100 END AS lap_seconds, id % 3 = 0 AS is_pit_out_lap FROM {samples} WHERE id % 5 = 2",
    "locations": "SELECT session_id, driver_number, observed_at, value AS x, id % 97 AS y, id % 13 AS z FROM {samples}",
    "stops": "SELECT session_id, driver_number, observed_at FROM {samples} WHERE id % 5 = 4",
    "stints": """SELECT session_id, driver_number, 1 AS stint_number, 1 AS lap_start, 20 AS lap_end, 'SOFT' AS compound, driver_number % 4 AS tyre_age_at_start FROM {entries}
        UNION ALL SELECT session_id, driver_number, 2, 21, CASE WHEN driver_number % 3 = 0 THEN 30 END, 'hard ', 0 FROM {entries} UNION ALL SELECT session_id, driver_number, 3, 29, NULL, 'odd', 5 FROM {entries} WHERE driver_number % 2 = 0""",
}


def _timing(events: DataFrame) -> dict[str, DataFrame]:
    out = {"events": events}
    for name, sql in TIMING.items():
        out[name] = events.sparkSession.sql(sql, **{t: out[t] for t in set(re.findall(r"\{(\w+)\}", sql))})
    out["instants"] = out["instants"].withColumnRenamed("at_", "at")
    return out


_TIMING_SQL = "WITH " + ",\n".join(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', sql)})" for name, sql in TIMING.items())


@query("events", sql=_TIMING_SQL + """,
p AS (SELECT session_id, driver_number, arg_max(position, (observed_at, position)) AS position FROM positions JOIN instants USING (session_id) WHERE observed_at <= at_ GROUP BY 1, 2),
i AS (SELECT session_id, driver_number, gap_seconds, gap_text, interval_seconds FROM intervals JOIN instants USING (session_id) WHERE observed_at <= at_ QUALIFY row_number() OVER (PARTITION BY session_id, driver_number ORDER BY observed_at DESC, gap_seconds DESC NULLS LAST, gap_text DESC NULLS LAST, interval_seconds DESC) = 1),
l AS (SELECT session_id, driver_number, lap_number, lap_seconds FROM laps JOIN instants USING (session_id) WHERE started_at <= at_ QUALIFY row_number() OVER (PARTITION BY session_id, driver_number ORDER BY lap_number DESC, started_at DESC, lap_seconds DESC NULLS LAST) = 1),
s AS (SELECT s.*, s.tyre_age_at_start + l.lap_number - s.lap_start AS tyre_age FROM stints s JOIN l USING (session_id, driver_number) WHERE lap_start <= lap_number AND lap_number <= coalesce(lap_end, 999) QUALIFY row_number() OVER (PARTITION BY session_id, driver_number ORDER BY stint_number DESC) = 1),
c AS (SELECT session_id, driver_number, count(*) AS n FROM stops JOIN instants USING (session_id) WHERE observed_at <= at_ GROUP BY 1, 2)
SELECT session_id, driver_number, position, CASE WHEN position = 1 THEN 'LEADER' ELSE coalesce(gap_text, printf('%.3f', gap_seconds)) END AS gap, interval_seconds, lap_number, lap_seconds AS last_lap_seconds, stint_number, compound,
  CASE upper(trim(compound)) WHEN 'SOFT' THEN 'tyre-soft' WHEN 'HARD' THEN 'tyre-hard' END AS tyre, tyre_age, coalesce(n, 0) AS pit_stops
FROM entries LEFT JOIN p USING (session_id, driver_number) LEFT JOIN i USING (session_id, driver_number) LEFT JOIN l USING (session_id, driver_number) LEFT JOIN s USING (session_id, driver_number) LEFT JOIN c USING (session_id, driver_number)""")
def towers_of_sessions(events):
    """DM15, JN05, JN07: the tower of every session two hours before its end."""
    t = _timing(events)
    return towers.tower(t["entries"], t["instants"], t["positions"], t["intervals"], t["laps"], t["stints"], t["stops"])


@query("events", sql=_TIMING_SQL + """,
ends AS (SELECT session_id, max(observed_at) AS at_ FROM samples GROUP BY 1),
h AS (SELECT session_id, driver_number, observed_at, x, y, z FROM locations JOIN ends USING (session_id) WHERE observed_at <= at_ AND observed_at >= at_ - INTERVAL 3 SECOND QUALIFY row_number() OVER (PARTITION BY session_id, driver_number ORDER BY observed_at DESC, x DESC, y DESC, z DESC) = 1),
p AS (SELECT session_id, driver_number, arg_max(position, (observed_at, position)) AS position FROM positions JOIN ends USING (session_id) WHERE observed_at <= at_ GROUP BY 1, 2),
l AS (SELECT session_id, driver_number, max(lap_number) AS lap_number FROM laps JOIN ends USING (session_id) WHERE started_at <= at_ GROUP BY 1, 2),
b AS (SELECT session_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM locations GROUP BY 1)
SELECT h.*, position, lap_number, min_x, max_x, min_y, max_y, min_z, max_z FROM h LEFT JOIN p USING (session_id, driver_number) LEFT JOIN l USING (session_id, driver_number) JOIN b USING (session_id)""")
def track_maps_of_sessions(events):
    """DM16, AG15: cars with a location of the last three seconds at the end of every session, with the session's bounds."""
    t = _timing(events)
    ends = t["samples"].groupBy("session_id").agg(F.max("observed_at").alias("at"))
    return towers.track_map(t["entries"], ends, t["locations"], t["positions"], t["laps"])


@query("events", sql=_TIMING_SQL + """,
best AS (SELECT * FROM laps WHERE started_at IS NOT NULL AND lap_seconds IS NOT NULL AND NOT is_pit_out_lap QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY lap_seconds, driver_number, lap_number, started_at) = 1)
SELECT session_id, driver_number, b.lap_number, o.observed_at, x, y, z FROM locations o JOIN best b USING (session_id, driver_number) WHERE o.observed_at >= b.started_at AND o.observed_at <= b.started_at + to_microseconds((b.lap_seconds * 1000000)::BIGINT)""")
def reference_paths_of_sessions(events):
    """DM16, JN12: the path of the fastest lap of every session."""
    t = _timing(events)
    return towers.reference_paths(t["laps"], t["locations"])


@query(*GIVEN, sql=with_tables(["race_sessions", "session_results", "session_entries", "session_laps"]) + """,
seen AS (SELECT session_id, driver_entity_id FROM session_entries UNION ALL SELECT session_id, driver_entity_id FROM session_laps)
SELECT race_id, s.id AS session_id, session_code, row_number() OVER (PARTITION BY race_id ORDER BY starts_at, s.id) AS place, (SELECT count(*) FROM session_results r WHERE r.session_id = s.id) AS results,
  (SELECT count(DISTINCT driver_entity_id) FROM seen WHERE seen.session_id = s.id) AS drivers, EXISTS (SELECT 1 FROM session_laps l WHERE l.session_id = s.id) AS loaded FROM race_sessions s""")
def session_choices(*given):
    """DX02, DX12, DX15: the sessions of every race with their results, drivers and whether laps are there."""
    return drilldown.session_choices(tables_of(*given))


@query(*GIVEN, sql=with_tables(["entities", "session_entries", "session_laps"]) + """,
l AS (SELECT session_id, driver_entity_id, count(*) AS laps FROM session_laps GROUP BY 1, 2),
d AS (SELECT session_id, driver_entity_id FROM session_entries UNION SELECT session_id, driver_entity_id FROM l)
SELECT d.session_id, d.driver_entity_id, e.slug AS driver_key, display_name AS driver_name, coalesce(laps, 0) AS laps FROM d JOIN entities e ON e.id = d.driver_entity_id LEFT JOIN l ON l.session_id = d.session_id AND l.driver_entity_id = d.driver_entity_id""")
def session_driver_choices(*given):
    """DX12: the drivers of every session."""
    return drilldown.session_drivers(tables_of(*given))


_PLACEMENTS = """SELECT 's' || id AS story_id, race_id * 10 + 3 AS session_id, CASE WHEN id % 15 <> 0 THEN driver_entity_id END AS driver_entity_id, CASE WHEN id % 4 < 3 THEN id % 7 + 1 END AS lap_number,
  CASE WHEN id % 3 = 0 THEN 1 + id % 2 END AS stint_number, at_ AS fallback FROM {held} WHERE id % 5 = 0"""


@query(*GIVEN, sql=with_tables(["held", "session_stints", "session_laps"]) + f""",
p AS ({re.sub(r"[{](\w+)[}]", r"\1", _PLACEMENTS)}),
b AS (SELECT session_id, driver_entity_id, stint_number, lap_start FROM session_stints QUALIFY row_number() OVER (PARTITION BY session_id, driver_entity_id, stint_number ORDER BY fetched_at DESC NULLS FIRST, lap_start NULLS LAST) = 1),
q AS (SELECT p.*, coalesce(nullif(b.lap_start, 0), p.lap_number) AS lap FROM p LEFT JOIN b ON b.session_id = p.session_id AND b.driver_entity_id = p.driver_entity_id AND b.stint_number = p.stint_number)
SELECT story_id, session_id, driver_entity_id, lap_number, stint_number, fallback, coalesce((SELECT min(started_at) FROM session_laps l WHERE l.session_id = q.session_id AND l.lap_number = q.lap AND (q.driver_entity_id IS NULL OR l.driver_entity_id = q.driver_entity_id)), fallback) AS anchor_at FROM q""")
def deep_anchors_of_stints(*given):
    """DM45, DX09: when the lap or the first lap of the stint that a story speaks of began, for its driver or the first of all."""
    tables = tables_of(*given)
    placements = given[0].sparkSession.sql(_PLACEMENTS, held=tables["held"])
    return deep_anchor(placements, tables["session_stints"], tables["session_laps"])
