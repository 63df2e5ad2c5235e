"""Chunked scans, gates, inboxes, stories under change and reconciliation against brute force."""

import collections
import datetime as dt
import random

import pytest

from stintlake.functions import taxonomy
from stintlake.operators import reconcile as R
from stintlake.operators.downsample import greedy_downsample
from stintlake.operators.range_scan import chunked_downsample
from stintlake.operators.story_upkeep import ACTIONS, Change, Stories, apply_change, story_counts
from stintlake.sources.decisions import decision_documents
from stintlake.streaming import gate, ledger

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# sections


PAGE = """
<h2>WEC</h2><a href="/wec.pdf">Doc 1 - Entry List</a> Published on 01.01.26 10:00 CET
<h3>Austrian Grand Prix</h3>
<a href="/a/14.pdf">Doc 14 - Car Presentation Submissions Published on 26.06.26 11:00 CEST</a>
<a href="b.pdf">recalled - doc 15 - <b>Decision</b> - Car 4</a> <p>Published <i>on</i> 26.06.26</p> <p>12:30 CET</p> Published on 27.06.26 09:00 CET
<a href="/c.pdf">Doc 16 - R&amp;D</a> <a href="/x">not a document</a> Published on 27.06.26 09:00 CET
<h3>Unknown Prix</h3><a>Doc 17 - no address</a><a href="/d.pdf">Doc 18 - Stays in the section</a>
<script>Published on 27.06.26 09:00 CET</script>
<h3> SPANISH  grand-prix </h3> Published on 27.06.26 09:00 CET <a href='/e.pdf'>Doc 99999999999 - Too large</a><a href=/f.pdf>Doc 2 - Open to the end"""


def test_sections_follow_what_stood_before(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<a href='/z'>Doc 1 - no event</a>")], "page_id int, html string")
    events = spark.createDataFrame([("Austrian Grand Prix",), ("Spanish Grand Prix",), ("spanish grand prix",), ("",), (None,)], "name string")
    got = decision_documents(pages, events, base="https://x").collect()
    rows = {(r.event_name, r.title): (r.document_number, r.document_type, r.document_url, r.published_at, r.recalled) for r in got}
    assert {r.page_id for r in got} == {1} and len(rows) == len(got) == 6
    assert rows["Austrian Grand Prix", "Car Presentation Submissions"] == (14, "car_presentation", "https://x/a/14.pdf", dt.datetime(2026, 6, 26, 9), False)
    assert rows["Austrian Grand Prix", "Decision - Car 4"] == (15, "stewards", "b.pdf", dt.datetime(2026, 6, 26, 11, 30), True)
    assert rows["Austrian Grand Prix", "R&D"][3] is None and rows["Austrian Grand Prix", "Stays in the section"][0] == 18
    assert rows["Spanish Grand Prix", "Too large"][0] is None and rows["Spanish Grand Prix", "Open to the end"][2] == "https://x/f.pdf"


def test_taxonomies_by_rule_order(spark):
    titles = ["Junior Team penalty", "VSC rules", "Team hires sponsor", "New floor livery", "Creator at the sprint", "Qualifying", "nothing", "", None, "Carbon floored"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "id int, t string")
    got = [r.c for r in df.select(taxonomy.story_class(df["t"]).alias("c"), "id").orderBy("id").collect()]
    assert got == ["academy_feeder", "regulation", "team_business", "technical", "media_marketing", "sporting", "general", "general", "general", "technical"]
    rules = spark.createDataFrame([(2, "b", "floor", False), (1, "a", "new floor livery", False), (1, "a", "hires", False), (1, "a", "sponsor", True), (3, "c", "sprint", False)], "place int, class string, phrase string, excludes boolean")
    got = {r.id: (r["class"], r.phrase) for r in taxonomy.classify_by_terms(df, rules, df["t"], "id", "none").collect()}
    assert got[3] == ("a", "new floor livery") and got[2] == ("none", None) and got[4] == ("c", "sprint") and got[9] == ("none", None) and got[8] == ("none", None)
    assert {r["class"] for r in taxonomy.classify_by_terms(df, rules.limit(0), df["t"], "id", "none").collect()} == {"none"}


# chunked scans


@pytest.mark.parametrize("seed,chunk", [(1, 1), (2, 40), (3, 5_000)])
def test_chunked_scan_equals_the_single_pass(spark, seed, chunk):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", None):
        t = rng.randint(-50, 50)
        for k in range(150 if key == "a" else 30):
            rows.append((key, at(t), k))
            t += rng.choice([0, 0, 1, 1, 2, 3, 9, 10, 11, 400])
    rows += [("c", None, 1), ("d", at(7), 1)]
    df = spark.createDataFrame(rows, "driver string, ts timestamp_ntz, k long").repartition(3)
    want = sorted(map(str, greedy_downsample(df.where("ts is not null"), ["driver"], "ts", "k", 10).collect()))
    assert sorted(map(str, chunked_downsample(df, ["driver"], "ts", "k", 10, chunk).collect())) == want


def test_chunked_scan_without_gap_or_rows(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(0), 2)], "driver string, ts timestamp_ntz, k long")
    assert chunked_downsample(df, ["driver"], "ts", "k", 0).count() == 2
    assert chunked_downsample(df.limit(0), ["driver"], "ts", "k", 5).count() == 0


# streams


def test_gate_releases_once_and_corrects_once_over_two_runs(spark, tmp_path):
    schema = "session_id string, ends_at timestamp, at timestamp, value double"

    def arrive(n, *rows):
        spark.createDataFrame([(s, at(e), at(t), v) for s, e, t, v in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return {(r.session_id, r.version): (r.n, r.total, r.late) for r in gate.run_gate(stream, f"{tmp_path}/out", dt.timedelta(minutes=30), dt.timedelta(hours=10)).collect()}

    hour = 3600
    arrive(0, ("a", hour, 60, 1.0), ("b", 5 * hour, 90, 2.0))
    assert run() == {}
    arrive(1, ("b", 5 * hour, 2 * hour, 3.0))  # stream time passes the end of a by an hour
    assert run() == {("a", 1): (1, 1.0, 0)}
    arrive(2, ("a", hour, 30 * 60, 5.0), ("a", hour, 31 * 60, 6.0), ("b", 5 * hour, 5 * hour, 1.0))
    assert run() == {("a", 1): (1, 1.0, 0)}
    arrive(3, ("c", 40 * hour, 20 * hour, 1.0))  # past the lateness of all, b had no late rows
    got = run()
    assert got == {("a", 1): (1, 1.0, 0), ("a", 2): (3, 12.0, 2), ("b", 1): (3, 6.0, 0)}
    arrive(4, ("a", hour, 60, 9.0))  # too late for the watermark
    assert run() == got


def test_gate_runs_no_code_for_single_sessions(spark, tmp_path):
    rows = [(f"s{k}", at(3600), at(60), None if k else 1.5) for k in range(500)]
    spark.createDataFrame(rows, "session_id string, ends_at timestamp, at timestamp, value double").write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([("z", at(9000), at(8000), 1.0)], "session_id string, ends_at timestamp, at timestamp, value double").write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema("session_id string, ends_at timestamp, at timestamp, value double").parquet(f"{tmp_path}/in/*")
    versions = gate.run_gate(stream, f"{tmp_path}/out", dt.timedelta(minutes=30))
    got = {r.session_id: (r.n, r.total, r.late, r.version) for r in versions.collect()}
    assert len(got) == 500 and got["s0"] == (1, 1.5, 0, 1) and got["s7"] == (1, None, 0, 1)
    assert not [f for f in (tmp_path / "out").rglob("*") if f.name == "state"]  # no state store, which calls Python for each session
    # a batch that comes again is passed over
    gate._take(spark, f"{tmp_path}/out", spark.createDataFrame(rows, stream.schema), 0, gate.HOLD, gate.LATENESS)
    assert gate._clock(spark, f"{tmp_path}/out")[0] == 1


def test_inbox_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    schema = "k int, v string, n int"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    for n in range(4):
        put(f"f{n}", [(k, f"{n}-{k}", n) for k in range(n, n + 3)])
    spark.range(1).coalesce(1).selectExpr("'x' as value").write.text(f"{tmp_path}/in/g")
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in/h")
    inbox = ledger.Inbox(f"{tmp_path}/in/*", f"{tmp_path}/out", spark.createDataFrame([], schema).schema, ("k",), "n", files=2, buckets=4)
    assert ledger.loaded(spark, inbox).count() == 0
    ledger.run_inbox(spark, inbox, batches=1)
    assert ledger.ledger(spark, inbox).count() == 2
    # the next run dies after its rows and before its ledger
    whole = ledger.keyed_merge
    monkeypatch.setattr(ledger, "keyed_merge", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        ledger.run_inbox(spark, inbox)
    monkeypatch.setattr(ledger, "keyed_merge", whole)
    half = ledger.ledger(spark, inbox)
    assert half.count() == 2
    table = {r.k: r.v for r in ledger.run_inbox(spark, inbox).collect()}
    assert table == {k: f"{min(k, 3)}-{k}" for k in range(6)}
    notes = {r.source.split("/in/")[1][:1] + str(r.batch): (r.state, r.rows) for r in ledger.ledger(spark, inbox).collect()}
    assert len(notes) >= 4 and collections.Counter(s for s, _ in notes.values())["failed"] >= 1
    states = [(r.state, r.error) for r in ledger.ledger(spark, inbox).collect()]
    assert len(states) == 6 and sum(s == "failed" for s, _ in states) == 2 and "missing columns: k, n, v" in {e for _, e in states}
    put("late", [(0, "new", 9), (1, "old", -1)])
    table = {r.k: r.v for r in ledger.run_inbox(spark, inbox).collect()}
    assert table[0] == "new" and table[1] == "1-1"
    ledger.load_batch(spark, inbox, [], 0)  # a finished batch is left alone
    assert {r.k: r.v for r in ledger.loaded(spark, inbox).collect()} == table


# stories


def scratch(items, pairs):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {frozenset(i for i in items if find(i) == r) for r in set(map(find, items))}


def test_changed_stories_equal_stories_from_scratch(spark):
    rng = random.Random(6)
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    state, items, pairs, before = Stories.none(spark), set(), set(), {}
    for _ in range(4):
        come = {rng.randrange(40) for _ in range(15)}
        gone = {rng.randrange(40) for _ in range(4)}
        new = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(12)}
        cut = set(rng.sample(sorted(pairs | new), min(3, len(pairs | new))))
        state, audit = apply_change(state, Change(frame([(x,) for x in come], "id"), frame([(x,) for x in gone], "id"), frame([p[::-1] for p in new] + [(1, 1)], "left_id right_id"), frame(list(cut), "left_id right_id")))
        items, pairs = (items | come) - gone, (pairs | new) - cut
        stories = collections.defaultdict(set)
        for r in state.members.collect():
            stories[r.story_id].add(r.id)
        assert set(map(frozenset, stories.values())) == scratch(items, pairs) and sum(map(len, stories.values())) == len(items)
        # an id goes on with most of its members, unless a smaller one took them in
        into = {r.story_id: r.into for r in state.redirects.collect()}
        assert not set(into) & set(stories) and set(into.values()) <= set(stories)
        for story, old in before.items():
            parts = sorted(((len(old & now), -min(now), s) for s, now in stories.items() if old & now), reverse=True)
            if parts:
                assert into.get(story, story) == parts[0][2]
            else:
                assert story not in stories
        counts = {r.action: r.n for r in audit.collect()}
        assert set(counts) == set(ACTIONS)
        assert counts["created"] == len(set(stories) - set(before)) and counts["detached"] == len(gone & set().union(*before.values(), set()))
        assert counts["ended"] + counts["merged"] == len(set(before) - set(stories))
        summary = story_counts(state.members).first()
        assert summary.stories == len(stories) and summary.multi + summary.single == len(stories)
        before = stories
    unchanged, audit = apply_change(state, Change())
    assert sorted(map(tuple, unchanged.members.collect())) == sorted(map(tuple, state.members.collect())) and not any(r.n for r in audit.collect())


# reconciliation


def one_by_one(identities, mappings, candidates):
    """The stages, an identity at a time, in order of season and provider id."""
    known = [(k, e, s, "".join(c for c in n.lower() if c.isalnum()), b) for k, e, s, n, b in candidates]
    maps, out = {(k, p): (e, a, b) for k, p, e, a, b in mappings}, {}
    unsure = set()
    for kind, pid, name, born, season in sorted(identities, key=lambda r: (r[4], r[1])):
        if (kind, pid) in maps:
            e, low, high = maps[kind, pid]
            ok = (low is None or low <= season) and (high is None or high >= season)
            out[kind, pid, season] = (e, "exact_provider_id" if ok else "provider_validity_extension")
            continue
        if (kind, pid) in unsure:
            out[kind, pid, season] = (None, "ambiguous")
            continue
        key = "".join(c for c in name.lower() if c.isalnum())
        found = [c for c in known if c[0] == kind and c[3] == key and key]
        if len(found) > 1 or found and kind == "driver" and born is not None and found[0][4] is not None and born != found[0][4]:
            unsure.add((kind, pid))
            out[kind, pid, season] = (None, "ambiguous")
        elif found:
            out[kind, pid, season] = (found[0][1], "exact_identity")
            maps[kind, pid] = (found[0][1], 99999, season)
        else:
            taken = {c[2] for c in known if c[0] == kind}
            base = "-".join("".join(c if c.isalnum() else " " for c in name.lower()).split()) or "historical-entity"
            slug = base if base not in taken else f"{base}-{pid}"
            out[kind, pid, season] = (f"{kind}:{slug}", "auto_created")
            known.append((kind, f"{kind}:{slug}", slug, key, born))
            maps[kind, pid] = (f"{kind}:{slug}", 99999, season)
    return out


def test_reconciliation_in_stages_equals_one_by_one(spark):
    rng = random.Random(12)
    kinds, day = ("driver", "constructor"), lambda: rng.choice([None, dt.date(1990, 1, 1), dt.date(1991, 1, 1)])
    candidates = [(rng.choice(kinds), f"e{k}", f"known-{k % 9}" if k % 2 else f"k{k}", f"Known {rng.randrange(9)}", day()) for k in range(12)]
    candidates = list({(c[0], c[2]): c for c in candidates}.values())
    identities = {(k, p): (k, p, rng.choice([f"known-{rng.randrange(9)}", f"NEW  {rng.randrange(6)}", f"Alone {p}"]), day()) for k in kinds for p in (f"p{n}" for n in range(40))}
    rows = [(*r, season) for r in identities.values() for season in sorted(rng.sample(range(2000, 2006), rng.randint(1, 3)))]
    mappings = [(k, p, f"m-{p}", rng.choice([None, 2002]), rng.choice([None, 2003])) for k, p in rng.sample(sorted(identities), 15)]
    got = R.reconcile(
        spark.createDataFrame(rows, "kind string, provider_id string, name string, birth_date date, season int").repartition(3),
        spark.createDataFrame(mappings, "kind string, provider_id string, entity_id string, valid_from int, valid_to int"),
        spark.createDataFrame(candidates, "kind string, entity_id string, slug string, display_name string, birth_date date"),
    ).collect()
    want = one_by_one(rows, mappings, candidates)
    # a created name's rows may be taken in another season order by the plain pass, never another entity or stage
    assert len(got) == len(rows) == len(want)
    assert {(r.kind, r.provider_id, r.season): (r.entity_id, r.method) for r in got} == want
    assert {r.method for r in got} == {"exact_provider_id", "provider_validity_extension", "ambiguous", "exact_identity", "auto_created"}
    assert all(r.review_required == (r.method == "ambiguous") == (r.entity_id is None) == (r.reason is not None) for r in got)
    made = [(r.kind, r.slug) for r in got if r.slug]
    assert len(made) == len(set(made)) and not set(made) & {(c[0], c[2]) for c in candidates}


def test_slugs_meet_neither_old_nor_new_ones(spark):
    rng = random.Random(3)
    bases = ["a", "a-2", "a-2-2", "b", "a-02", "a-1", "c-10"]
    taken = {"a", "a-3", "a-2-2", "b-2", "b-3", "b-4", "c-10-2", "a-1"}
    new = [("x", k, rng.choice(bases)) for k in range(60)]
    tf = spark.createDataFrame([("x", s) for s in taken] + [("y", "b")], "kind string, slug string")
    got = [R.allocate_slugs(spark.createDataFrame(new, "kind string, id long, base string").repartition(n), tf, "id", "base", ["kind"]).collect() for n in (1, 4)]
    rows = [sorted((r.id, r.slug) for r in g) for g in got]
    assert rows[0] == rows[1] and len({s for _, s in rows[0]}) == 60 and not {s for _, s in rows[0]} & taken
    slugs = dict(rows[0])
    named = {b: [slugs[k] for _, k, x in new if x == b] for b in bases}
    assert named["b"][:3] == ["b", "b-5", "b-6"] and named["c-10"][:2] == ["c-10", "c-10-3"] and named["a"][0] == "a-4"


def test_ranges_are_merged_and_extended(spark):
    ranges = [("a", 2000, 2003), ("a", 2004, 2005), ("a", 2007, 2008), ("a", 2001, 2002), ("b", None, 2000), ("b", 1990, None), ("c", 2005, 2001), ("d", None, None)]
    df = spark.createDataFrame(ranges, "k string, valid_from int, valid_to int")
    assert sorted(map(str, map(tuple, R.merged_ranges(df, ["k"]).collect()))) == sorted(map(str, [("a", 2000, 2005), ("a", 2007, 2008), ("b", None, None), ("d", None, None)]))
    one = spark.createDataFrame([("a", 2000, 2003), ("b", None, 2003), ("c", 2000, None), ("e", 2000, 2001)], "k string, valid_from int, valid_to int")
    met = spark.createDataFrame([("a", 1999), ("a", 2005), ("b", 2010), ("c", 1990), ("d", 7), ("d", 9)], "k string, season int")
    got = {r.k: (r.valid_from, r.valid_to) for r in R.extended(one, met, ["k"]).collect()}
    assert got == {"a": (1999, 2005), "b": (None, 2010), "c": (1990, None), "d": (7, 9), "e": (2000, 2001)}


def test_roster_links_need_both_ends(spark):
    standings = spark.createDataFrame([(2024, "d1", ["c1", "c2"]), (2024, "d1", ["c1"]), (2024, "d2", ["c1"]), (2024, "d3", None)], "season int, driver_id string, constructor_ids array<string>")
    resolved = spark.createDataFrame([("driver", "d1", 2024, "D"), ("constructor", "c1", 2024, "C"), ("constructor", "c2", 2024, None), ("driver", "d2", 2023, "E")], "kind string, provider_id string, season int, entity_id string")
    assert [tuple(r) for r in R.roster_links(standings, resolved).collect()] == [(2024, "D", "C")]
