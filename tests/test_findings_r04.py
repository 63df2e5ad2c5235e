"""Findings of round four on queries of the given tables."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from stintlake.functions.text import REFERENCES
from stintlake.operators import materialize
from stintlake.plans import payloads, stories
from stintlake.sources import galleries
from stintlake.sources import payloads as P

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def reached(rows):
    """The smallest name that each name reaches over pairs of rows, as the SQL has it."""
    root = {r[1]: r[1] for r in rows if r[1] is not None}
    pairs = [(a[1], b[1]) for a in rows for b in rows if None not in a + b and a[2] == b[2] and a[4] == b[4] and a[0] != b[0] and abs(a[3] - b[3]) <= 100]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved = moved or root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_stories_of_near_customers_as_all_pairs_give_them(spark):
    for seed in range(2):
        dice = random.Random(seed)
        odd = [None, float("nan"), float("inf"), float("-inf")]
        pick = lambda of: None if dice.random() < 0.03 else dice.choice(of)
        # few keys and names, so that keys repeat under several names and names in several blocks
        rows = [(pick(range(12 + 60 * (seed % 2))), pick([f"n{k:03}" for k in range(150)]), pick([1, 2]), dice.choice(odd) if dice.random() < 0.06 else round(dice.uniform(-999, 6_000), 2), pick(["A", "B"])) for _ in range(160)]
        rows += rows[:9] + [(1, "x", 9, 0.0, "A"), (2, "y", 9, 100.0, "A"), (3, "z", 9, 200.01, "A"), (4, "u", 8, 10.0, "A"), (4, "v", 8, 20.0, "A"), (5, "w", 8, 115.0, "A"), (6, "q", 7, 10.0, "A"), (6, "r", 7, 20.0, "A"), (7, "s", 7, -85.0, "A")]
        got = stories.story_components(spark.createDataFrame(rows, CUSTOMER)).collect()
        assert len(got) == len({r.id for r in got}) and {r.id: r.story_id for r in got} == reached(rows)


def test_links_of_a_dense_block_grow_with_its_rows(spark, monkeypatch):
    seen, before = [], materialize.story_groups

    def groups(items, pairs):
        seen.append(pairs.count())
        return before(items, pairs)

    monkeypatch.setattr(materialize, "story_groups", groups)
    got = stories.story_components(spark.createDataFrame([(k, f"n{k:03}", 1, float(k % 50), "A") for k in range(600)], CUSTOMER)).collect()
    assert {r.story_id for r in got} == {"n000"} and len(got) == 600 and seen == [599]


def test_standings_spell_the_constructors_of_a_nation_once(spark, monkeypatch):
    customers = spark.createDataFrame([(k, k % 2 if k % 7 else None, None if k == 5 else k / 4) for k in range(300)], "c_custkey long, c_nationkey int, c_acctbal double")
    suppliers = spark.createDataFrame([(k, 1) for k in (11, 9, 100)] + [(7, 2), (8, None), (None, 1)], "s_suppkey long, s_nationkey int")
    spelt, before = [], P.driver_standings

    def standings(lists):
        spelt.extend(r.payload.count("constructorId") for r in lists.collect())
        return before(lists)

    monkeypatch.setattr(P, "driver_standings", standings)
    got = payloads.payload_standings(customers, suppliers)
    assert dict(got.dtypes)["pairs"] == "bigint"
    nation = lambda k: k % 2 if k % 7 else None
    want = {(nation(k), k, None if k == 5 else round(k / 4, 2), f"d{k}", *(("t9,t11,t100", 3) if nation(k) == 1 else ("", 0))) for k in range(300)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 300 and {r[:2] + r[3:] for r in rows} == {r[:2] + r[3:] for r in want} and all(r[2] is None if r[1] == 5 else abs(r[2] - r[1] / 4) < 0.006 for r in rows)
    assert sum(spelt) == 4
    # no list is shuffled with the drivers
    heads = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(heads) == 2 and "driver_id" not in heads[0]


def test_pages_of_galleries_are_cleaned_and_titled_once(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", "<!-- <img src='/wp-content/uploads/n.jpg'> --><h1>&nbsp;</h1><h1>One\n <b>day</b></h1>" + "<figure><img src='/x.jpg' alt=''></figure><IMG src=/wp-content/uploads/&amp;.png alt=' Pit  stop'>" * 2)], "id long, url string, html string")
    got = galleries.gallery_pictures(pages, "id", "url", "html")
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum(line.count("<h1") for line in lines) == 1 and sum(line.count("!--") for line in lines) == 1
    # below the pieces, so not for each of them
    where = lambda words: next(k for k, line in enumerate(lines) if words in line)
    assert where("posexplode(") < where("<h1") < where("!--")
    rows = [tuple(r) for r in got.select("n", "image_url", "gallery_title", "caption", "alt_text", "content_role").collect()]
    assert rows == [(1, "https://a.b/x.jpg", "One day", "", "", "generic"), (2, "https://a.b/wp-content/uploads/&.png", "One day", " Pit  stop", " Pit  stop", "pit_stop")]


def test_attributes_and_texts_of_galleries_as_plain_patterns_read_them(spark):
    dice = random.Random(4)
    parts = [" src", " SRC ", "=", "= ", '"', "'", " ", "\n", "\t", "a.jpg", "&amp;", "&lt;", ">", "<b>", " data-src", " alt", "\xa0"]
    tags = ["<img" + "".join(dice.choice(parts) for _ in range(dice.randint(1, 14))) for _ in range(1_500)]
    tags += ["<img src=\"a'\" alt='\"'", "<img src=\"\" alt=\"\"", "<img src='a", "<img alt=", "<img data-src = x src=y"]

    def decoded(text):
        for reference, char in REFERENCES:
            text = text.replace(reference, char)
        return text

    def plain(tag, name):
        found = re.search(rf"""(?isa)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag)
        return found and decoded(next(g for g in found.groups() if g is not None))

    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in tags], "t string").select("t", galleries._filled(t, "src").alias("src"), galleries._attribute(t, "alt").alias("alt"), galleries._spaced(t).alias("said")).collect()
    assert [(r.src, r.alt, r.said) for r in got] == [(plain(x, "src") or "", plain(x, "alt"), re.sub(r"(?a)\s+", " ", decoded(re.sub("<[^>]*>", "", x))).strip(" ") or None) for x in tags]
