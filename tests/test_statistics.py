"""The 26 measures against plain counting."""

import random

from stintlake.operators.statistics import COUNTS, POINTS, RATES, driver_statistics

STATUSES = ["Finished", " finished ", "+2 Laps", "Lapped", "classified", "Engine", None, "", "Did not qualify", "WITHDREW", "Disqualified", "excluded", "Not classified"]


def kind(status):
    s = " ".join((status or "").casefold().split())
    if s.startswith(("did not start", "did not qualify", "did not prequalify", "withdrawn", "withdrew")):
        return "dns"
    if s.startswith(("disqualified", "excluded")):
        return "dsq"
    return "classified" if s in ("finished", "classified", "lapped") or s.startswith("+") else "dnf"


def plain(races, quali, sprints, standings):
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    last = {}
    for _, season, after, position, points, done in standings:
        if season not in last or (after, -position) > (last[season][0], -last[season][1]):
            last[season] = (after, position, points, bool(done))
    started = [r for r in races if kind(r[6]) != "dns"]
    won = [(r[1], r[2], r[5]) for r in races] + [(s[1], s[2], s[4]) for s in sprints]
    points = sum(x[2] for x in last.values()) + sum(p for s, n, p in won if s not in last or n > last[s][0])
    of = lambda k: sum(kind(r[6]) == k for r in races)
    race_points, sprint_points = sum(r[5] for r in races), sum(s[4] for s in sprints)
    wins, podiums = sum(r[3] == 1 for r in races), sum(r[3] is not None and r[3] <= 3 for r in races)
    return {
        "race_entries": len(races), "starts": len(started), "wins": wins, "podiums": podiums, "poles": len({r[1:3] for r in races if r[4] == 1}), "qualifying_p1s": len({q[1:3] for q in quali if q[3] == 1}),
        "fastest_laps": sum(r[7] == 1 for r in races), "points": points, "race_points": race_points, "sprint_points": sprint_points, "points_adjustment": points - race_points - sprint_points,
        "classified_finishes": of("classified"), "dnfs": of("dnf"), "dns": of("dns"), "dsqs": of("dsq"), "sprint_entries": len(sprints), "sprint_starts": sum(kind(s[5]) != "dns" for s in sprints),
        "sprint_wins": sum(s[3] == 1 for s in sprints), "sprint_top3s": sum(s[3] is not None and s[3] <= 3 for s in sprints), "average_grid": mean([r[4] for r in started if r[4]]),
        "average_finish": mean([r[3] for r in races if kind(r[6]) == "classified" and r[3] is not None]), "average_classification_position": mean([r[3] for r in started if r[3] is not None]),
        "win_rate": wins / len(started) if started else None, "podium_rate": podiums / len(started) if started else None,
        "positions_gained": sum(r[4] - r[3] for r in started if r[4] and r[3] is not None), "championships": sum(x[1] == 1 and x[3] for x in last.values()),
    }


def test_measures_equal_plain_counting(spark):
    rng = random.Random(7)
    pick = lambda: (rng.choice("abc"), rng.choice([2023, 2024]), rng.randint(1, 6))
    races = [(*pick(), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 0, 1, 2, 12]), rng.randint(0, 25), rng.choice(STATUSES), rng.choice([None, 1, 2])) for _ in range(80)]
    quali = [(*pick(), rng.choice([None, 1, 2])) for _ in range(40)] + [("only-quali", 2024, 1, 1)]
    sprints = [(*pick(), rng.choice([None, 1, 3, 4]), rng.randint(0, 8), rng.choice(STATUSES)) for _ in range(20)]
    standings = [("a", 2023, 3, 1, 100, True), ("a", 2023, 4, 2, 120, True), ("b", 2023, 6, 1, 90, True), ("b", 2024, 2, 1, 10, False), ("only-standing", 2020, 9, 1, 5, None)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    inputs = (
        frame(races, "driver string, season int, round int, finish_position int, grid_position int, points long, status string, fastest_lap_rank int"), frame(quali, "driver string, season int, round int, position int"),
        frame(sprints, "driver string, season int, round int, finish_position int, points long, status string"), frame(standings, "driver string, season int, after_round int, position int, points long, season_complete boolean"),
    )
    assert len({*COUNTS, *POINTS, *RATES}) == 26
    of = lambda rows, d, s=None: [r for r in rows if r[0] == d and s in (None, r[1])]
    got = {r.driver: r for r in driver_statistics(*inputs).collect()}
    assert set(got) == {"a", "b", "c", "only-quali", "only-standing"}
    for d, row in got.items():
        want = plain(*(of(rows, d) for rows in (races, quali, sprints, standings)))
        assert {k: row[k] for k in want} == {k: v for k, v in want.items()}, d
    for row in driver_statistics(*inputs, by_season=True).collect():
        want = plain(*(of(rows, row.driver, row.season) for rows in (races, quali, sprints, standings)))
        assert {k: row[k] for k in want} == want
        assert row.season_complete == ((row.driver, row.season) in {("a", 2023), ("b", 2023)})
    empty = [df.limit(0) for df in inputs]
    assert driver_statistics(*empty).count() == 0
