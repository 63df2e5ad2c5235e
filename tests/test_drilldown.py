"""Scopes, coordinates and the total order of the unified timeline on small tables."""

import datetime as dt

import pytest

from stintlake.operators import drilldown as D

T = dt.datetime(2024, 5, 1)


def at(minutes):
    return None if minutes is None else T + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "races": make([(1, 2024, "monza", "Monza GP", at(0)), (2, 2024, "spa", "Spa GP", None)], "id int, season int, slug string, official_name string, start_at timestamp_ntz"),
        "race_sessions": make([(10, 1, "race", "Race", at(5), False), (11, 1, "quali", "Quali", at(1), None), (12, 1, "warm", "Warm-up", at(0), True)], "id int, race_id int, session_code string, session_name string, starts_at timestamp_ntz, is_cancelled boolean"),
        "entities": make([("a", "ann", "Ann"), ("b", "bob", "Bob")], "id string, slug string, display_name string"),
        "session_race_control_events": make([(1, 10, None, at(9), "Flag", None), (2, 10, "a", at(9), "Note", 2), (3, 10, None, None, "No time", 1)], "id int, session_id int, driver_entity_id string, observed_at timestamp_ntz, message string, lap_number int"),
        "session_pit_stops": make([(1, 10, "b", 2, at(9), 44), (2, 10, None, 2, at(7), 9)], "id int, session_id int, driver_entity_id string, lap_number int, observed_at timestamp_ntz, provider_driver_number int"),
        "session_overtakes": make([(1, 10, "a", "b", at(6), 1, 2), (2, 10, "a", None, at(6), 1, 7)], "id int, session_id int, overtaking_driver_entity_id string, overtaken_driver_entity_id string, observed_at timestamp_ntz, overtaking_driver_number int, overtaken_driver_number int"),
        "session_laps": make([(1, 10, "a", 1, at(5)), (2, 10, "a", 2, at(8)), (3, 10, "a", 2, at(7)), (4, 10, None, 1, at(5)), (5, 10, "z", 1, at(5))], "id int, session_id int, driver_entity_id string, lap_number int, started_at timestamp_ntz"),
        "session_stints": make([(1, 10, "a", 1, 1, 1), (2, 10, "a", 2, 2, 4), (3, 10, "a", 3, 9, None)], "id int, session_id int, driver_entity_id string, stint_number int, lap_start int, lap_end int"),
    }


def ids(events):
    return [r.event_id for r in events.orderBy("scope", "place").collect()]


def test_levels_in_total_order(tables):
    first = lambda level: D.first_of_scope(D.LEVELS[level](tables))
    assert ids(first("season")) == ["race:1", "race:2"]
    assert ids(first("race")) == ["session:11", "session:10"]
    session = first("session")
    assert ids(session) == ["overtake:1", "overtake:2", "pit-stop:2", "race-control:1", "pit-stop:1", "race-control:2", "race-control:3"]
    labels = {r.event_id: (r.label, r.precision, r.driver_key, r.season, r.race_key, r.session_code) for r in session.collect()}
    assert labels["overtake:2"] == ("Ann overtook Driver 7", "timestamp", "ann", 2024, "monza", "race")
    assert labels["pit-stop:2"][0] == "Driver 9 pit stop" and labels["race-control:2"][1] == "lap"
    assert len(ids(D.first_of_scope(D.session_events(tables), 3))) == 3


def test_driver_and_lap_scopes(tables):
    events = D.session_events(tables)
    assert {r.event_id for r in D.of_driver(events, "b").collect()} == {"overtake:1", "pit-stop:1"}
    assert {r.event_id for r in D.of_lap(events, 2).collect()} == {"race-control:2", "pit-stop:1", "pit-stop:2"}
    driver = D.driver_events(tables)
    assert ids(D.first_of_scope(driver)) == ["lap:1", "stint:1", "stint:3", "lap:3", "stint:2", "lap:2"]  # an unknown first lap: the session's start
    at_ = {r.event_id: r.timeline_at for r in driver.collect()}
    assert at_["stint:2"] == at(7) and at_["stint:3"] == at(5)
    assert {r.event_id for r in D.of_lap(driver, 3, tables["session_stints"]).collect()} == {"stint:2"}
    assert {r.event_id for r in D.of_lap(driver, 1, tables["session_stints"]).collect()} == {"lap:1", "stint:1"}
