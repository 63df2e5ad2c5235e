import datetime as dt

from pyspark.sql import functions as F

from stintlake.functions import editorial as E
from stintlake.functions import placement as P


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(v,) for v in value], f"v {kind}").select(column(F.col("v")).alias("x")).toPandas()["x"].tolist()


def none(values):
    return [None if v is None or v != v else v for v in values]


def test_clean_up(spark):
    assert none(one(spark, ["a &amp;amp; b", "<p>x</p>  y", " ", None, "it&rsquo;s"], E.clean_text)) == ["a & b", "x y", None, None, "it’s"]
    assert none(one(spark, ["Fast car. Keep reading at x", "One - read also: Two", "KEEP READING", "Plain.", None], E.clean_summary)) == ["Fast car", "One", None, "Plain.", None]
    got = spark.createDataFrame([("team_haas", "Haas F1 Team | Monday"), ("team_racing_bulls", "Day | VCARB | Visa Cash App RB"), ("other", "Haas F1 Team | Monday"), ("team_haas", "Haas F1 Team |"), ("x", None)], "s string, t string")
    assert [r.x for r in got.select(E.title_without_chrome(F.col("s"), F.col("t")).alias("x")).collect()] == ["Monday", "Day", "Haas F1 Team | Monday", "Haas F1 Team |", "Untitled Formula 1 story"]
    assert one(spark, ["ica-2024-01-02 and ICA-2023-05, ica-2023-05", ""], lambda c: F.array_join(E.reference_ids(c), ",")) == ["ICA-2023-05,ICA-2024-01-02", ""]
    assert one(spark, ["The F1 car", "formula   one", "gulf1"], E.is_relevant) == [True, True, False]
    df = spark.createDataFrame([("Published 06.04.25 07:30 CEST",), ("06.01.25 07:30 CET",), ("none",)], "v string").select(E.local_moment(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == [dt.datetime(2025, 4, 6, 5, 30), dt.datetime(2025, 1, 6, 6, 30), None]


def test_summary(spark):
    a, b = "The team brings a new floor to the race this weekend. More follows here for the reader.", "The team brings a new floor to the race this weekend! Rivals wait for their own upgrades."
    rows = [[a, b], [a], ["short."], [], [a, a.split(". ")[0] + "."]]
    got = none(one(spark, rows, E.extractive_summary, "array<string>"))
    first = "The team brings a new floor to the race this weekend."
    assert got == [first + " Rivals wait for their own upgrades.", first, None, None, first]


def test_cues(spark):
    assert none(one(spark, ["The 2026 F1 season", "F2 in 2026 season", "Sold in 2024", "Formula 1 and its 2027 car", "rules for 2030", None], P.stated_season)) == [2026, None, None, 2027, 2030, None]
    assert none(one(spark, ["On this day in 2012", "2019 Italian GP", "2019"], P.historical_year)) == [2012, 2019, None]
    assert none(one(spark, ["Sprint", "sprint shootout result", "FP2 notes", "Quali", "Race  Recap", "x", None], P.session_cue)) == ["sprint", "sprint_qualifying", "practice_2", "qualifying", "race", None, None]
    assert none(one(spark, ["lap 12", "Lap #0", "overlap 3", "lap number 7"], P.lap_cue)) == [12, None, None, 7]
    assert none(one(spark, ["stint 2", "his third stint", "stint 0 first stint", "none"], P.stint_cue)) == [2, 3, None, None]


def test_placement(spark):
    t, later = dt.datetime(2025, 5, 1), dt.datetime(2025, 6, 1)
    rows = [
        (0, "New rules for 2027", "regulation", t, None, None),
        (1, "Pit stop on lap 12", None, t, 2025, t),
        (2, "Out in Q2", None, t, 2025, t),
        (3, "Race preview", None, t, 2025, later),
        (4, "A chat", None, t, 2025, None),
        (5, "A chat", None, None, None, None),
        (6, "2026 F1 season thoughts", "technical", t, None, None),
        (7, "2024 F1 season thoughts", None, t, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, v string, tax string, at timestamp, season int, race timestamp")
    got = [tuple(r.p) for r in df.select("id", P.placement(*[F.col(c) for c in ("v", "tax", "at", "season", "race")], 2030).alias("p")).orderBy("id").collect()]
    assert got[0] == (2027, "effective_from", "season", None, None, None, None, 96, "explicit_future_effective_season")
    assert got[1] == (2025, "occurred_at", "lap", "race", None, 12, None, 98, "explicit_lap_reference")
    assert got[2] == (2025, "occurred_at", "segment", "qualifying", "q2", None, None, 98, "explicit_qualifying_segment_reference")
    assert got[3][:3] == (2025, "scheduled_for", "race") and got[4][1:3] == ("applies_to", "race") and got[5][:3] == (2030, "reported_at", "timestamp")
    assert got[6][:3] == (2026, "scheduled_for", "season") and got[7][:3] == (2024, "reported_at", "season")


def test_long_expressions_are_computed_once(spark):
    from stintlake.functions import placement, taxonomy, text
    from stintlake.operators import stories

    rows = spark.createDataFrame([("The 2026 F1 season opens",), ("In 2023 nothing",), (None,)], "t string")
    t = F.col("t")
    out = rows.select(placement.stated_season(t).alias("s"), stories.event_fingerprint(t).alias("e"), taxonomy.document_class(t).alias("c"), text.bound(F.upper(t), lambda x: F.concat(x, x)).alias("b"))
    assert [(r.s, r.e, r.c) for r in out.collect()] == [(2026, None, "other"), (None, None, "other"), (None, None, "other")]
    assert out.first().b == "THE 2026 F1 SEASON OPENS" * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2 and plan.count("lower(") <= 3 and plan.count("upper(") == 1
