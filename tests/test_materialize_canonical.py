"""Stories, media, canonical races, anchors and charts on cases with known answers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stintlake.operators import canonical, materialize, media
from stintlake.plans import charts

T0 = dt.datetime(2024, 5, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(200, 260)] + [(5, 999), (7, 7)]
    root = {k: k for k in range(300)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b < 300:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    nodes = spark.range(300).union(spark.createDataFrame([(None,)], "id long"))
    got = {r.id: r.root for r in materialize.components(nodes, spark.createDataFrame(edges, "left_id long, right_id long")).collect()}
    assert got == {k: find(k) for k in range(300)}
    empty = spark.createDataFrame([], "left_id long, right_id long")
    assert {(r.id, r.root) for r in materialize.components(spark.range(2), empty).collect()} == {(0, 0), (1, 1)}
    assert materialize.components(spark.range(0), empty).count() == 0


def test_story_groups_follow_accepted_pairs_and_fingerprints(spark):
    items = spark.createDataFrame([("a", None), ("b", ""), ("c", "f"), ("d", "f"), ("e", None), ("g", None)], "id string, fingerprint string")
    rows = [("a", "b", 94, "title", "candidate"), ("b", "c", 90, "title", "candidate"), ("d", "e", 88, "event_fingerprint_v3", "candidate"), ("e", "g", 99, "title", "rejected"), ("a", "g", 10, "title", "accepted")]
    groups = materialize.story_groups(items, spark.createDataFrame(rows, "left_id string, right_id string, score int, method string, status string"))
    assert {r.id: r.story_id for r in groups.collect()} == {"a": "a", "b": "a", "g": "a", "c": "c", "d": "c", "e": "c"}
    audit = materialize.group_audit(groups).first()
    assert (audit["items"], audit.stories, audit.attached, audit.corroborated) == (6, 2, 4, 2)


def test_story_aggregate(spark):
    long1, long2, long3 = "The team confirmed the new front wing.", "The team confirmed the new front wing today.", "Engineers expect a gain of two tenths a lap."
    rows = [
        (1, 1, "community_signal", "wing rumour", None, long2, at(1), at(2), "rumour"),
        (1, 2, "first_party_team", "Team confirms wing", None, long1, at(3), at(4), "technical"),
        (1, 3, "independent_editorial", "Wing explained", long3, None, None, at(5), None),
        (2, 4, None, "Watch the start", None, "Short.", None, at(6), None),
    ]
    df = spark.createDataFrame(rows, "story_id int, id int, source_class string, title string, standfirst string, summary string, published_at timestamp_ntz, fetched_at timestamp_ntz, taxonomy string")
    one, two = materialize.story_aggregates(df).orderBy("story_id").collect()
    assert (one.primary_id, one.taxonomy, one.source_count, one.confidence) == (2, "technical", 3, "corroborated")
    assert one.summary == f"{long1} {long3}" and one.first_published_at == at(1) and one.last_published_at == at(3) and one.last_observed_at == at(5)
    assert (two.primary_id, two.confidence, two.summary, two.first_published_at) == (4, "tentative", None, None)
    mentions = spark.createDataFrame([(1, "x", "mentioned", 99, "alias", "a"), (1, "x", "subject", 50, None, "b"), (1, "y", "subject", 90, "source_context", "c")], "story_id int, entity_id string, relation_type string, confidence int, match_method string, matched_alias string")
    assert [(r.entity_id, r.relation_type) for r in materialize.story_entities(mentions).collect()] == [("x", "subject")]


def test_media_scores(spark):
    df = spark.createDataFrame
    assets = df([(1, "winner"), (2, "portrait")], "id int, content_role string")
    asset_entities = df([(1, "r"), (1, "p"), (2, "p"), (2, "t")], "asset_id int, entity_id string")
    stories = df([("s1", "Ann wins at  Monza", at(1), None), ("s2", "Ann and Red", at(2), None), ("s3", "Old", at(3), "s1"), ("s4", "Only Ann", at(4), None)], "id string, title string, updated_at timestamp_ntz, merged_into string")
    story_entities = df([("s1", "r"), ("s1", "p"), ("s2", "p"), ("s2", "t"), ("s3", "r"), ("s4", "p")], "story_id string, entity_id string")
    entities = df([("r", "race"), ("p", "person"), ("t", "team")], "id string, entity_type string")
    got = {(r.asset_id, r.story_id): (r.story_role, r.match_reason, r.confidence) for r in media.media_story_scores(assets, asset_entities, story_entities, stories, entities).collect()}
    assert got == {(1, "s1"): ("hero", "exact_event", 95), (2, "s2"): ("supporting", "entity_match", 80)}
    items = df([(1, "p", "u", "t", None, at(9), "i1"), (2, "p", "u", "t", at(1), at(1), "i2"), (3, "p", "u", "t", at(1), at(1), "")], "id int, provider string, source_url string, title string, published_at timestamp_ntz, fetched_at timestamp_ntz, image_url string")
    linked = media.source_media(df([("s", 1, "corroborating"), ("s", 2, "primary"), ("s", 3, "primary")], "story_id string, item_id int, relation_type string"), items)
    assert [(r.image_url, r.confidence) for r in linked.orderBy("n").collect()] == [("i2", 90), ("i1", 80)]


def test_calendar(spark):
    df = spark.createDataFrame
    calendar = df([(1, 2024, "Italian GP", "monza", "Monza", None), (2, 2024, "Spa GP", "spa", "Spa", "Stavelot"), (3, 2024, "New GP", "new", "Newtown", ""), (4, 2024, "Twin GP", "twin", "Twin", None), (5, 2024, "Tie GP", "tie", "Tie", None), (6, 2024, "Old GP", "old", "Old", None)], "race_id int, season int, name string, circuit_id string, circuit_name string, locality string")
    known = df([(2024, "monza", 100), (2024, "twin", 101), (2024, "twin", 102)], "season int, circuit_id string, entity_id int")
    entities = df([(200, "spa", "2024 Spa GP", None, None), (201, "spa-2", "Other", 2020, None), (202, "t1", "x", None, None), (203, "t2", "y", None, None), (204, "old", "z", None, 2020)], "id int, slug string, display_name string, active_from int, active_to int")
    aliases = df([(201, " spa gp", "race_name", 99, True), (201, "SPA GP", "race_name", 99, True), (202, "Tie", "venue", 80, True), (203, "tie", "venue", 80, True), (204, "Old", "venue", 90, True), (200, "New GP", "race_name", 90, False)], "entity_id int, alias string, alias_type string, confidence int, enabled boolean")
    got = {r.race_id: (r.method, r.entity_id, r.slug) for r in canonical.resolve_calendar(calendar, known, entities, aliases).collect()}
    assert got == {1: ("circuit", 100, None), 2: ("alias", 200, None), 3: ("create", None, "2024-new-gp"), 4: ("ambiguous_circuit", None, None), 5: ("ambiguous_alias", None, None), 6: ("create", None, "2024-old-gp")}
    docs = canonical.match_documents(df([(1, "São  Paulo GP"), (2, None), (3, "?")], "d int, event_name string"), df([(7, "Sao Paulo GP"), (8, "sao paulo gp"), (9, "!")], "race_id int, alias string"))
    assert {r.d: r.race_id for r in docs.collect()} == {1: 7, 2: None, 3: None}


def test_driver_repair(spark):
    df = spark.createDataFrame
    entries = df([(1, 4, " ANN Lee", None), (1, 5, "Bob", "old"), (1, 6, "Twin", None), (1, 7, None, None)], "session_id int, driver_number int, full_name string, driver_entity_id string")
    fixed = canonical.repair_entries(entries, df([("a", "Ann Lee"), ("a", "ann lee"), ("b", "Bob"), ("x", "twin"), ("y", "Twin")], "entity_id string, name string"))
    assert {r.driver_number: r.driver_entity_id for r in fixed.collect()} == {4: "a", 5: "old", 6: None, 7: None}
    laps = df([(1, 4, None, 1), (1, 9, None, 1), (1, 5, "keep", 2)], "session_id int, driver_number int, driver_entity_id string, lap int")
    assert {r.driver_number: r.driver_entity_id for r in canonical.fill_drivers(laps, fixed).collect()} == {4: "a", 9: None, 5: "keep"}


def test_story_anchor(spark):
    row = "story_id int, text string, title string, reported_at timestamp_ntz, race_id int, season int, round int, anchor_at timestamp_ntz, alias_type string, matched_alias string, detected_in array<string>, confidence int"

    def case(story, title, *races):
        return [(story, title, title, at(0), *r) for r in races]

    rows = (
        case(1, "Preview: what to expect in Monza", (1, 2024, 3, at(-5), "race_name", "Italian GP", ["title"], 99), (2, 2024, 4, at(9), "race_name", "Spa GP", ["summary"], 50))
        + case(2, "Spa GP report", (1, 2024, 3, at(-5), "race_name", "Italian GP", ["title"], 99), (2, 2024, 4, at(-2), "canonical", "Spa GP", ["summary"], 50))
        + case(3, "A stroll in Monza", (1, 2024, 3, at(-5), "venue", "Monza", ["title"], 99))
        + case(4, "On this day in 2020 Gasly won", (1, 2024, 3, at(-5), "race_name", "Italian GP", ["title"], 99), (8, 2020, 8, at(-99), "race_name", "Italian GP", ["title"], 9))
        + case(5, "F2 news", (1, 2024, 3, at(-5), "race_name", "Italian GP", ["title"], 99))
        + case(6, "Team talk", (1, 2024, 3, at(-5), "race_name", "Italian GP", ["body"], 99))
        + case(7, "Pole in Monza", (1, 2024, 3, None, "venue", "Monza", ["title"], None))
    )
    got = {r.story_id: r.race_id for r in canonical.story_anchor(spark.createDataFrame(rows, row)).collect()}
    assert got == {1: 2, 2: 2, 4: 8, 7: 1}


def test_deep_anchor(spark):
    df = spark.createDataFrame
    where = df([(1, 10, "a", 5, None, at(0)), (2, 10, "a", None, 2, at(0)), (3, 10, None, 5, None, at(0)), (4, 10, "z", 5, None, at(0)), (5, None, None, None, None, None)], "story_id int, session_id int, driver_entity_id string, lap_number int, stint_number int, fallback timestamp_ntz")
    stints = df([(10, "a", 2, 9, at(1)), (10, "a", 2, 7, at(2))], "session_id int, driver_entity_id string, stint_number int, lap_start int, fetched_at timestamp_ntz")
    laps = df([(10, "a", 5, at(6)), (10, "b", 5, at(5)), (10, "a", 7, at(7))], "session_id int, driver_entity_id string, lap_number int, started_at timestamp_ntz")
    assert {r.story_id: r.anchor_at for r in canonical.deep_anchor(where, stints, laps).collect()} == {1: at(6), 2: at(7), 3: at(5), 4: at(0), 5: None}


def test_charts(spark):
    df = spark.createDataFrame
    weather = df([(1, at(0), 90, 20.5, None, 40.0, 1000.0, 1.0, False)], "session_id int, observed_at timestamp_ntz, wind_direction_degrees int, air_temperature_c double, track_temperature_c double, humidity_percent double, pressure_mbar double, wind_speed_mps double, rainfall boolean")
    got = {r.panel: r.value for r in charts.weather_chart(weather).collect()}
    assert got == {"air_temperature_c": 20.5, "humidity_percent": 40.0, "pressure_mbar": 1000.0, "wind_speed_mps": 1.0, "rainfall": 0.0}
    entities = df([("a", "ann", "Ann"), ("b", "bob", "Bob"), ("t", "red", "Red")], "id string, slug string, display_name string")
    entries = df([(1, 4, "a", "t", "Ann L", "Red F1", "ANN", "ff0000"), (2, 4, "a", "t", "Ann L", "Red F1", "AN2", "00ff00")], "session_id int, driver_number int, driver_entity_id string, team_entity_id string, full_name string, team_name string, name_acronym string, team_colour string")
    passes = charts.overtake_chart(df([(1, 4, "a", "b", 3), (1, 5, None, "b", 4)], "session_id int, overtaking_driver_number int, overtaking_driver_entity_id string, overtaken_driver_entity_id string, position int"), entities, entries)
    assert [(r.overtaker_key, r.overtaken_label, r.name_acronym, r.color) for r in passes.orderBy("position").collect()] == [("ann", "Bob", "ANN", "#FF0000"), (None, "Bob", None, None)]
    results = df([(7, "a", "t", 1, 1), (7, "b", None, 2, 2), (8, "a", "t", 1, None)], "race_id int, driver_entity_id string, team_entity_id string, finish_position int, fastest_lap_rank int")
    sessions = df([(1, 7, at(0)), (2, 7, at(5))], "id int, race_id int, starts_at timestamp_ntz")
    codes = df([("a", "AAA", "driver_code", 50, True), ("b", "BBB", "driver_code", 50, True), ("b", "BOB", "driver_code", 90, True), ("b", "BBX", "driver_code", 99, False)], "entity_id string, alias string, alias_type string, confidence int, enabled boolean")
    rows = {(r.race_id, r.driver_key): (r.driver_acronym, r.color, r.fastest_lap_token) for r in charts.classification_chart(results, entities, sessions, entries, codes).collect()}
    assert rows == {(7, "ann"): ("AN2", "#00FF00", "timing-purple"), (7, "bob"): ("BOB", None, None), (8, "ann"): ("AAA", None, None)}


def test_flags(spark):
    from stintlake.functions.results import flag_token

    cases = [("CHEQUERED", None, None, "flag-chequered"), ("BLACK AND WHITE", None, None, "flag-black-white"), ("BLACK AND ORANGE", None, None, "flag-black"), ("DOUBLE YELLOW", None, "vsc", "flag-yellow"), (None, "Drs", None, "drs"), (None, "SafetyCar", "VSC ending", "virtual-safety-car"), ("CLEAR", "Flag", "track clear", None)]
    df = spark.createDataFrame(cases, "f string, c string, l string, want string")
    assert df.where(~F.expr("want").eqNullSafe(flag_token(F.col("f"), F.col("c"), F.col("l")))).count() == 0
