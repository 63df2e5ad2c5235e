"""Entities and relations of news items: known answers."""

import pytest
from pyspark.sql import functions as F

from stintlake.operators.mentions import classify_items

ITEM = "item_id int, title string, standfirst string, summary string, body_excerpt string, season int, race_season int, source_context_team_slug string"
ALIAS = "entity_id int, entity_type string, slug string, display_name string, alias string, alias_type string, confidence int, valid_from_season int, valid_to_season int"
ALIASES = [
    (1, "person", "ada", "Ada Lund", "Lund", None, 95, 2020, None),
    (1, "person", "ada", "Ada Lund", "Ada Lund", None, 90, None, None),
    (1, "person", "ada", "Ada Lund", "FOR", "driver_code", 88, None, None),
    (2, "person", "bo", "Bo Éclair", "Éclair", None, 95, None, None),
    (3, "team", "red", "Red Hill", "Red Hill", None, 97, None, None),
    (4, "race", "h25", "Harbour 2025", "Harbour Grand Prix", None, 99, 2025, 2025),
    (5, "race", "h26", "Harbour 2026", "Harbour Grand Prix", None, 99, 2026, 2026),
]
CASES = {
    1: ("Lund leads at the Harbour Grand Prix", None, None, None, 2026, None, None),
    2: ("Eclair speaks after Ada Lund setback?", None, None, None, 2026, None, None),
    3: ("ECLAIR plan: Lund after all", None, None, None, 2026, None, None),
    4: ("Red Hill driver's luck", None, "For all FOR sale", "lund", 2026, None, None),
    5: ("Quiet", "Red Hill", "Red Hill", None, 2026, None, None),
    6: ("Harbour Grand Prix 2025 review", None, None, None, 2026, None, "red"),
    7: ("Quiet", None, None, "Harbour Grand Prix", 2019, 2026, "red"),
    8: (None, "", None, "Lund", 2019, None, None),
    9: ("Like Red Hill, Lund waits", None, None, None, None, None, "red"),
}
WANT = {
    (1, 1): ("subject", 100, "Lund", "title"),
    (1, 5): ("context", 100, "Harbour Grand Prix", "title"),
    (2, 2): ("subject", 100, "Éclair", "title"),
    (2, 1): ("mentioned", 95, "Ada Lund", "title"),
    (3, 2): ("subject", 100, "Éclair", "title"),
    (3, 1): ("subject", 100, "Lund", "title"),
    (4, 3): ("directly_involved", 100, "Red Hill", "title"),
    (4, 1): ("directly_involved", 88, "FOR", "summary,body_excerpt"),
    (5, 3): ("directly_involved", 97, "Red Hill", "standfirst,summary"),
    (6, 4): ("context", 100, "Harbour Grand Prix", "title"),
    (6, 3): ("context", 100, "Red Hill", "source"),
    (7, 5): ("mentioned", 90, "Harbour Grand Prix", "body_excerpt"),
    (7, 3): ("context", 100, "Red Hill", "source"),
    (9, 3): ("mentioned", 100, "Red Hill", "title"),
    (9, 1): ("subject", 100, "Lund", "title"),
}


@pytest.mark.parametrize("copies", [1, 2])
def test_relations(spark, copies):
    items = spark.createDataFrame([(k, *v) for k, v in CASES.items()], ITEM)
    aliases = spark.createDataFrame(ALIASES * copies, ALIAS)
    got = classify_items(items, aliases).withColumn("detected_in", F.array_join("detected_in", ",")).collect()
    assert len(got) == len(WANT)
    assert {(r.item_id, r.entity_id): (r.relation_type, r.confidence, r.matched_alias, r.detected_in) for r in got} == WANT


def test_nothing_to_name(spark):
    items, aliases = spark.createDataFrame([(1, *CASES[1])], ITEM), spark.createDataFrame(ALIASES, ALIAS)
    assert classify_items(items.limit(0), aliases).isEmpty()
    assert classify_items(items, aliases.limit(0)).isEmpty()
