import datetime as dt

from pyspark.sql import functions as F

from stintlake.functions import results as R
from stintlake.operators.stories import event_fingerprint, same_story_pairs


def test_status_and_tokens(spark):
    rows = [("Finished", "classified"), (" +1  Lap", "classified"), ("Lapped", "classified"), ("Did  not START", "dns"), ("Withdrew injured", "dns"), ("Disqualified", "dsq"), ("Engine", "dnf"), (None, "dnf"), ("", "dnf")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert df.where(R.status_class(F.col("s")) != F.col("want")).count() == 0
    one = spark.createDataFrame([([2049, None, 7],), (None,)], "c array<int>").select(R.segment_tokens(F.col("c")).alias("c")).collect()
    assert [(x["index"], x.code, x.token) for x in one[0].c] == [(1, 2049, "timing-green"), (2, None, "segment-unavailable"), (3, 7, "segment-unknown")] and one[1].c == []
    tyres = spark.createDataFrame([(" soft ",), ("x",), (None,)], "t string").select(R.tyre_token(F.col("t")).alias("t")).collect()
    assert [r.t for r in tyres] == ["tyre-soft", None, None]


def test_event_fingerprints(spark):
    rows = [("Formula 1 reveals 2026 calendar", "calendar_announcement:2026"), ("Max vs 100 karters", "exhibition_event:max_vs_100"), ("Aston Martin hires new technical chief", "personnel_appointment:aston_martin:technical_leadership"), ("Calendar talk", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(~event_fingerprint(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_same_story_rules(spark):
    t = dt.datetime(2025, 5, 1)
    day = lambda n: t + dt.timedelta(days=n)
    rows = [
        (1, "a", "Ferrari brings major floor upgrade", t, ["f", "h"], ["m"]),
        (2, "b", "Ferrari brings major floor upgrade", day(30), [], []),  # equal title
        (3, "b", "Ferrari floor upgrade for Monaco", day(1), ["f", "h"], ["m"]),  # several entities
        (4, "a", "Ferrari floor upgrade explained today", day(2), ["f"], []),
        (5, "c", "Ferrari floor upgrade explained again", day(9), ["f"], []),  # too far apart
        (6, "c", "Something else entirely", t, ["f"], []),
        (7, "c", "F1 2026 calendar out", day(50), [], []),
        (8, "a", "The Formula One calendar of 2026", None, None, None),
        (9, "c", None, t, ["f"], []),
    ]
    got = {(r.left_id, r.right_id): (r.score, r.method) for r in same_story_pairs(spark.createDataFrame(rows, "id int, provider string, title string, published_at timestamp, strong array<string>, races array<string>")).collect()}
    assert got[1, 2] == (100, "exact_title") and got[7, 8] == (96, "event_fingerprint")
    assert got[1, 3] == (97, "multi_entity_title")  # 88 + 4 + 2 + round((3/6 - 0.2) * 10)
    assert got[3, 4][1] == "single_entity_title" and (4, 5) not in got and not any(6 in k or 9 in k for k in got)


def test_equal_titles_are_paired_from_titles_alone(spark):
    from stintlake.operators import stories

    rows = [(k, f"p{k % 2}", "Aston Martin hires technical chief", None, ["e"], ["r"]) for k in range(6)] + [(k, "p0", "Only one provider has this", None, [], []) for k in range(10, 14)]
    rows += [(20, "p0", "Short", None, ["e"], []), (21, "p1", "Short", None, ["e"], [])]
    items = spark.createDataFrame(rows, "id int, provider string, title string, published_at timestamp_ntz, strong array<string>, races array<string>")
    got = {(r.left_id, r.right_id): (r.score, r.method, r.similarity) for r in stories.same_story_pairs(items).collect()}
    want = {(a, b): (100, "exact_title", 1.0) for a in range(6) for b in range(a + 1, 6) if (a - b) % 2}
    assert {k: v for k, v in got.items() if k[0] < 10} == want and set(got) - set(want) == {(20, 21)}
    base = items.selectExpr("id", "provider", "lower(title) as norm", "array('w') as words")
    assert {(r.left_id, r.right_id) for r in stories._equal_titles(base.where("id < 20")).collect()} == set(want)
