"""Timelines and relations of every target on small tables."""

import datetime as dt

import pytest
from test_facets import DDL

from stintlake.plans import context

EXTRA = {"start_at": "timestamp_ntz", "weekend_end_date": "timestamp_ntz", "fetched_at": "timestamp_ntz", "created_at": "timestamp_ntz", "message": "string", "slug": "string", "title": "string", "external_id": "string", "normalized_claim": "string", "raw_excerpt_or_reference": "string", "source_name": "string", "provider_driver_number": "int", "overtaking_driver_number": "int", "overtaken_driver_number": "int"}
TIMES = {"updated_at", "published_at", "observed_at", "source_timestamp", "captured_at", "starts_at", "start_at"}


@pytest.fixture(scope="module")
def tables(spark):
    """The facet tables with real times: a letter stands for a day of May 2024."""
    from pyspark.sql import functions as F

    out = {}
    for name, (ddl, rows) in DDL.items():
        df = spark.createDataFrame(rows, ddl)
        for c in TIMES & set(df.columns):
            day = F.ascii(F.substring(F.col(c).cast("string"), -1, 1))
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.make_timestamp_ntz(F.lit(2024), F.lit(5), day % 28 + 1, F.lit(0), F.lit(0), F.lit(0))))
        for c, kind in EXTRA.items():
            if c not in df.columns:
                value = F.lit("text") if kind == "string" else F.lit(7 if kind == "int" else None)
                df = df.withColumn(c, value.cast(kind))
        if name == "session_pit_stops":
            df = df.withColumn("observed_at", F.lit(dt.datetime(2024, 5, 2)).cast("timestamp_ntz"))
        out[name] = df
    out["roster"] = spark.createDataFrame([("d1", "t1", "driver"), ("d9", "t1", "principal"), ("d1", "t1", "driver")], "driver_entity_id string, team_entity_id string, role string")
    return out


@pytest.mark.parametrize(
    "target,key,kinds",
    [
        ("driver", "d1", {"race_result", "race_control", "story", "evidence"}),
        ("team", "t1", {"race_result", "story", "evidence"}),
        ("race", 1, {"session", "document", "story", "race_control"}),
        ("session", 10, {"session_start", "race_control", "pit_stop", "overtake", "evidence"}),
        ("season", 2024, {"race", "story", "document"}),
        ("story", "s1", {"evidence", "publication"}),
    ],
)
def test_timeline_has_all_its_branches_in_order(tables, target, key, kinds):
    rows = context.timeline(tables, target, key).collect()
    assert {r.event_type for r in rows} == kinds
    assert [r.occurred_at for r in rows] == sorted((r.occurred_at for r in rows), reverse=True)
    assert context.timeline(tables, target, key.__class__(0)).count() == 0


def test_limits_labels_and_team_races(tables):
    assert len(context.timeline(tables, "session", 10, per_type=1, total=3).collect()) == 3
    team = {r.event_id: r.label for r in context.timeline(tables, "team", "t1").where("event_type = 'race_result'").collect()}
    assert team == {"team-race:1": "Bahrain GP · best P2", "team-race:2": "Monza GP · best P1"}
    stop = context.timeline(tables, "session", 10).where("event_type = 'pit_stop'").orderBy("event_id").first()
    assert (stop.label, stop.target_key) == ("Ann pit stop · lap 2", "ann")
    start = context.timeline(tables, "session", 10).where("event_type = 'session_start'").first()
    assert (start.label, start.target_key) == ("Race started", "bahrain-race")


def test_relations(tables):
    got = {(r.entity_id, r.related_id, r.relation, r.sessions) for r in context.relations(tables, "team").collect()}
    assert got == {("t1", "d1", "has_roster_driver", None), ("t1", "d9", "has_team_member", None), ("t1", "d1", "fielded_driver", 1), ("t1", "d2", "fielded_driver", 1)}
    assert {(r.entity_id, r.relation) for r in context.relations(tables, "driver").collect()} == {("d1", "roster_driver_for"), ("d9", "roster_driver_for"), ("d1", "participated_for"), ("d2", "participated_for")}
    edges = {(r.source, r.relation, r.target) for r in context.structure(tables).collect()}
    assert ("race:1", "has_session", "session:11") in edges and ("session:20", "part_of_season", "season:2023") in edges and len(edges) == 2 * 2 + 3 * 3
