"""Every facet on small tables: it resolves, selects only its target's rows and pages in order."""

from collections import Counter

import pytest

from stintlake.plans.facets import FACETS, facet, facet_rows

DDL = {
    "races": ("id int, season int, round int, slug string, official_name string, entity_id string, start_at string", [(1, 2024, 1, "bahrain", "Bahrain GP", "e-r1", "a"), (2, 2023, 1, "monza", "Monza GP", "e-r2", "b")]),
    "race_sessions": ("id int, race_id int, session_code string, session_name string, starts_at string, sequence int", [(10, 1, "race", "Race", "t1", 2), (11, 1, "quali", "Quali", "t0", 1), (20, 2, "race", "Race", "t2", 1)]),
    "entities": ("id string, slug string, display_name string, entity_type string, metadata string", [("d1", "ann", "Ann", "person", None), ("d2", "bob", "Bob", "person", None), ("t1", "red", "Red", "team", None), ("e-r1", "bahrain", "Bahrain", "race", None)]),
    "session_entries": ("id int, session_id int, driver_entity_id string, team_entity_id string, driver_number int, team_name string", [(1, 10, "d1", "t1", 4, "Red F1"), (2, 10, None, None, 1, "X"), (3, 20, "d2", "t1", 9, "Y")]),
    "session_results": ("id int, session_id int, driver_entity_id string, team_entity_id string, position int, driver_number int", [(1, 10, "d1", "t1", None, 4), (2, 10, "d2", "t1", 1, 9), (3, 20, "d1", "t1", 1, 4)]),
    "session_starting_grid": ("id int, session_id int, driver_entity_id string, team_entity_id string, position int", [(1, 10, "d1", "t1", 1), (2, 20, "d2", "t1", 1)]),
    "session_overtakes": ("id int, session_id int, overtaking_driver_entity_id string, overtaken_driver_entity_id string, observed_at string", [(1, 10, "d1", "d2", "a"), (2, 10, "d2", "d3", None), (3, 20, "d2", "d1", "c")]),
    "session_race_control_events": ("id int, session_id int, driver_entity_id string, observed_at string", [(1, 10, None, "a"), (2, 20, "d1", "b")]),
    "session_weather": ("id int, session_id int, observed_at string", [(1, 10, "a"), (2, 20, "b")]),
    "race_results": ("id int, race_id int, driver_entity_id string, team_entity_id string, finish_position int", [(1, 1, "d1", "t1", 2), (2, 1, "d2", "t1", None), (3, 2, "d1", "t1", 1)]),
    "qualifying_results": ("id int, race_id int, driver_entity_id string, team_entity_id string, position int", [(1, 1, "d1", "t1", 2), (2, 2, "d2", "t1", 1)]),
    "driver_standing_rows": ("id int, snapshot_id int, driver_entity_id string", [(1, 1, "d1"), (2, 2, "d1"), (3, 2, "d2")]),
    "constructor_standing_rows": ("id int, snapshot_id int, team_entity_id string", [(1, 1, "t1")]),
    "stories": ("id string, title string, updated_at string", [("s1", "One", "b"), ("s2", "Two", None)]),
    "story_entities": ("story_id string, entity_id string, relation_type string, confidence int", [("s1", "d1", "subject", 90), ("s1", "e-r1", "context", 80), ("s1", "t1", "mentioned", 70), ("s2", "d1", "mentioned", 50)]),
    "race_documents": ("id int, race_id int, published_at string, document_number int", [(1, 1, "a", 1), (2, 1, None, 2), (3, 2, "c", 1)]),
    "race_document_entities": ("race_document_id int, entity_id string, matched_alias string, match_method string, confidence int", [(1, "d1", "ann", "alias", 90), (3, "t1", "red", "alias", 80)]),
    "evidence": ("id int, session_id int, race_id int, driver_entity_id string, team_entity_id string, story_id string, source_timestamp string, published_at string, captured_at string", [(1, 10, 1, "d1", "t1", "s1", None, "b", "z"), (2, 10, 1, "d1", "t1", "s1", "c", None, None), (3, 20, 2, None, None, None, None, None, None)]),
    "publications": ("id int, headline string, published_at string, updated_at string", [(1, "H", "a", "b")]),
    "publication_stories": ("publication_id int, story_id string", [(1, "s1")]),
}
SNAPSHOT = ("id int, season int, after_round int, fetched_at string, source_url string", [(1, 2023, 5, "a", "u"), (2, 2024, 1, "b", "u")])
DDL |= {"driver_standings_snapshots": SNAPSHOT, "constructor_standings_snapshots": SNAPSHOT}
for _name, _col in (("laps", "lap_number int"), ("stints", "stint_number int"), ("positions", "observed_at int"), ("intervals", "observed_at int"), ("pit_stops", "lap_number int")):
    DDL[f"session_{_name}"] = (f"id int, session_id int, driver_entity_id string, {_col}", [(1, 10, "d1", 2), (2, 10, "d2", 1), (3, 20, "d1", 7)])
KEYS = {"session": 10, "race": 1, "driver": "d1", "team": "t1", "season": 2024, "story": "s1"}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.createDataFrame(rows, ddl) for name, (ddl, rows) in DDL.items()}


def test_all_facets_are_there():
    assert Counter(t for t, _ in FACETS) == {"session": 12, "race": 16, "driver": 14, "team": 9, "season": 7, "story": 3}


def test_every_facet_resolves_and_has_rows(tables):
    for (target, name), spec in FACETS.items():
        rows = facet(tables, target, name, KEYS[target])
        assert len(set(rows.columns)) == len(rows.columns), (target, name)
        assert not [c for c in rows.columns if c.startswith("_")], (target, name)
        assert rows.count() > 0, (target, name)
        assert facet(tables, target, name, KEYS[target].__class__(0)).count() == 0, (target, name)
        assert spec.table in tables


def ids(df):
    return [r.id for r in df.collect()]


def test_orders_scopes_and_pages(tables):
    assert ids(facet_rows(tables, "session", "results", 10)) == [2, 1]  # no position goes last
    assert ids(facet_rows(tables, "session", "laps", 10)) == [2, 1]
    assert ids(facet_rows(tables, "driver", "overtakes", "d1")) == [1, 3]  # either side
    assert ids(facet_rows(tables, "driver", "standings", "d1")) == [2, 1]
    assert ids(facet_rows(tables, "driver", "stories", "d1")) == ["s2", "s1"]  # unknown time first when falling
    assert ids(facet_rows(tables, "race", "evidence", 1)) == [2, 1]
    assert ids(facet_rows(tables, "race", "sessions", 1)) == [11, 10]
    assert ids(facet_rows(tables, "season", "stories", 2024)) == ["s1"]
    page = facet_rows(tables, "race", "documents", 1, 0, 1).collect()
    assert [(r.id, r.total, r.next_offset) for r in page] == [(1, 2, 1)]


def test_looked_up_names(tables):
    row = facet(tables, "session", "entries", 10).where("id = 1").first()
    assert (row.driver_key, row.team_name, row.team_name_canonical) == ("ann", "Red F1", "Red")
    assert facet(tables, "session", "entries", 10).where("id = 2").first().driver_name is None
    assert facet(tables, "story", "entities", "s1").where("entity_id = 'd1'").first().entity_key == "ann"
