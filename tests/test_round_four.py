"""Findings of round three on queries of the given tables."""

from __future__ import annotations

import pytest

from stintlake.operators import media, routing
from stintlake.operators.shared import durable
from stintlake.plans import entities, payloads
from stintlake.sources import galleries
from stintlake.sources import payloads as P

PART = "p_partkey long, p_brand string, p_name string, p_size int, p_type string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_passes_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    assert durable(spark.range(50).mapInPandas(count, "id long")).count() == 50
    assert seen.value == 50


def test_candidates_are_pairs_of_items_and_equal_titles_meet_once(spark):
    rows = [(1, "A", "x y", 1, "t"), (1, "A", "x y", 1, "t"), (2, "B", "x y", 1, "t"), (3, "B", "y z", 1, "t"), (4, "A", "y z", 2, "t"), (5, None, "x y", 1, "t")]
    got = entities.blocked_candidates(spark.createDataFrame(rows, PART)).collect()
    # SQL joins rows, so an item that is there twice is in two pairs
    assert sorted(map(tuple, got)) == [(1, 2, "exact_title"), (1, 2, "exact_title"), (1, 3, "shared"), (1, 3, "shared")]


def test_token_pairs_of_copies(spark):
    rows = [(k, "A", "red car" if k % 2 else "car, RED", 1, "t") for k in range(6)] + [(9, "A", "red bus", 1, "t"), (10, "A", "the", 1, "t"), (11, "A", "the", 1, "t")]
    got = entities.token_jaccard_pairs(spark.createDataFrame(rows, PART))
    want = [(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)] + [(a, 9, 0.333333) for a in range(6)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "RepartitionByExpression" in plan(got)


@pytest.mark.parametrize("common", [0, 1, 2, 1000])
def test_pictures_meet_stories_whatever_counts_as_common(spark, monkeypatch, common):
    monkeypatch.setattr(media, "COMMON", common)
    table = spark.createDataFrame
    kinds = table([(1, "race"), (2, "person"), (3, "person"), (4, "team"), (5, None)], "id long, entity_type string")
    bags = {1: [1, 2], 2: [2, 3], 3: [3, 4, 5], 4: [2], 5: [4, 5]}
    shown = {1: [1, 2, 3], 2: [2, 3, 4, 5], 3: [3]}
    rows = lambda d, key: table([(k, e) for k, es in d.items() for e in es + es[:1]], f"{key} long, entity_id long")
    stories = table([(k, "Quiet", None, 1 if k == 4 else None) for k in bags], "id long, title string, updated_at timestamp, merged_into long")
    got = media.media_story_scores(table([(k, "portrait") for k in shown], "id long, content_role string"), rows(shown, "asset_id"), rows(bags, "story_id"), stories, kinds)
    want = {(a, s, len(set(x) & set(y))) for a, x in shown.items() for s, y in bags.items() if s != 4 and (1 in set(x) & set(y) or len(set(x) & set(y)) > 1)}
    assert {(r.asset_id, r.story_id, r.shared) for r in got.collect()} == want


def test_a_payload_of_standings_is_bounded(spark, monkeypatch):
    customers = spark.createDataFrame([(k, 1, float(k)) for k in range(1_200)], "c_custkey long, c_nationkey int, c_acctbal double")
    suppliers = spark.createDataFrame([(7, 1), (5, 1)], "s_suppkey long, s_nationkey int")
    sizes, before = [], P.driver_standings

    def standings(lists):
        sizes.extend(r.payload.count("driverId") for r in lists.collect())
        return before(lists)

    monkeypatch.setattr(P, "driver_standings", standings)
    got = payloads.payload_standings(customers, suppliers).collect()
    assert len(got) == 1_200 and {(r.teams, r.pairs) for r in got} == {("t5,t7", 2)}
    assert sum(sizes) == 1_200 and max(sizes) <= 500


def test_routed_texts_are_spread(spark):
    table = spark.createDataFrame
    items, rules = table([(1, "Formula 1: red", ["x"])], "id long, title string, categories array<string>"), table([("s", 1)], "story_id string, min_score int")
    got = routing.route_items(items, rules, table([("s", "red", 2)], "story_id string, term string, weight int"), table([], "story_id string, value string"))
    assert "RepartitionByExpression" in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, "matched", "s", 2)]


def test_gallery_attributes_are_read_once_a_picture(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", "<figure><img data-full-url='/x.jpg'></figure>")], "id long, url string, html string")
    got = galleries.gallery_pictures(pages, "id", "url", "html")
    assert plan(got).count("data-full-url") == 1
    assert [r.image_url for r in got.collect()] == ["https://a.b/x.jpg"]


def test_feeds_and_pages_are_parsed_once(spark):
    from stintlake.sources.decisions import decision_documents
    from stintlake.sources.feeds import feed_entries, feed_states

    xml = "<rss><channel><item>\n<title> \u000a A </title><link>l</link><guid> </guid></item><item/></channel><item><title> </title></item></rss>"
    feeds = spark.createDataFrame([(1, xml), (2, xml[:-3]), (3, " "), (4, None), (5, "<rss><channel><item></item></channel></rss>")], "f int, xml string")
    assert {r.f: (r.state, r["items"]) for r in feed_states(feeds, "f").collect()} == {1: ("read", 3), 2: ("malformed", 0), 3: ("empty", 0), 4: ("empty", 0), 5: ("read", 1)}
    entries = feed_entries(feeds, "f")
    assert [(r.f, r.title, len(r.external_id)) for r in entries.collect()] == [(1, "A", 64)]
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    page = "<h3>Cup</h3><a href='/x'>Recalled - Doc 3 - Entry List Published on 01.02.24 10:00 CET</a>"
    docs = decision_documents(spark.createDataFrame([(1, page)], "page_id int, html string"), spark.createDataFrame([("Cup",)], "name string"))
    one = docs.first()
    assert (one.document_number, one.title, one.document_type, one.recalled, str(one.published_at)) == (3, "Entry List", "entry_list", True, "2024-02-01 09:00:00")
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 20


def test_facets_of_all_read_their_roots_from_written_tables(spark):
    from stintlake import plans

    for name in ("facets_of_every_session", "timeline_of_every_race"):
        files = plans.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_rules_are_looked_up_by_first_words(spark):
    from pyspark.sql import functions as F

    from stintlake.functions import taxonomy

    rules = spark.createDataFrame([(1, "x", "red car", False), (2, "y", "red", False), (2, "y", "blue", True), (3, "z", "car red car", False), (0, "w", "", False)], "place int, class string, phrase string, excludes boolean")
    texts = {1: "a red car", 2: "Red blue", 3: "CAR, red; car", 4: "redcar", 5: None, 6: "", 7: "red red red"}
    out = taxonomy.classify_by_terms(spark.createDataFrame(list(texts.items()), "id int, t string"), rules, F.col("t"), "id", "none")
    assert {r.id: (r["class"], r.phrase) for r in out.collect()} == {1: ("x", "red car"), 2: ("none", None), 3: ("x", "red car"), 4: ("none", None), 5: ("none", None), 6: ("w", ""), 7: ("y", "red")}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert taxonomy.classify_by_terms(spark.createDataFrame([(1, "a")], "id int, t string"), rules.limit(0), F.col("t"), "id", "none").first()["class"] == "none"


def test_cars_meet_overtakes_by_session_alone(spark):
    from stintlake.plans import charts

    passes = spark.createDataFrame([(1, 4, "a", "b"), (1, 5, None, "b"), (2, 4, "a", None), (3, None, "a", "b")], "session_id int, overtaking_driver_number int, overtaking_driver_entity_id string, overtaken_driver_entity_id string")
    entries = spark.createDataFrame([(1, 4, "AAA", "ff8000"), (1, 4, "AAB", "x"), (1, 6, "CCC", None), (3, None, "NNN", None)], "session_id int, driver_number int, name_acronym string, team_colour string")
    chart = charts.overtake_chart(passes, spark.createDataFrame([("a", "s-a", "A"), ("b", "s-b", "B")], "id string, slug string, display_name string"), entries)
    got = {(r.session_id, r.overtaking_driver_number, r.overtaker_label, r.overtaken_label, r.name_acronym, r.color) for r in chart.collect()}
    assert got == {(1, 4, "A", "B", "AAA", "#FF8000"), (1, 4, "A", "B", "AAB", None), (1, 5, None, "B", None, None), (2, 4, "A", None, None, None), (3, None, "A", "B", None, None)}
    joins = [x for x in chart._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 3 and not [x for x in joins if "number" in x]
