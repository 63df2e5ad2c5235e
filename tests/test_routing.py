"""Feed items to stories against the plain choice, and readers of feeds and galleries on odd pages."""

import random
import re

from stintlake.operators.routing import route_items
from stintlake.sources.feeds import feed_entries, feed_states
from stintlake.sources.galleries import gallery_pictures


def choose(item, rules, terms, identifiers):
    text = " ".join(x for x in (item[1], *(item[2] or [])) if x is not None)
    ids = {x.upper() for x in re.findall(r"(?i)\bICA-\d{4}(?:-\d{2})+\b", text)}
    own = {s for s, v in identifiers if v.upper() in ids and s in dict(rules)}
    if own:
        return ("matched", own.pop(), 100) if len(own) == 1 else ("ambiguous", None, 100)
    if not re.search(r"(?i)\bformula\s+one\b|\bformula\s*1\b|\bf1\b", text):
        return "filtered", None, 0
    scores = {s: sum(w for x, t, w in terms if x == s and t.lower() in text.lower()) for s, _ in rules}
    good = sorted(((scores[s], s) for s, least in rules if scores[s] >= least), reverse=True)
    if not good:
        return "unmatched", None, 0
    if len(good) > 1 and good[1][0] == good[0][0]:
        return "ambiguous", None, good[0][0]
    return "matched", good[0][1], good[0][0]


def test_routing_equals_the_plain_choice(spark):
    rng = random.Random(5)
    words = ["Car", "f1", "Formula One", "wing", "ICA-2024-01", "ica-2024-01-02", "É", "a", "pit stop", "%", "."]
    items = [(k, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 7)))]), rng.choice([None, [], ["F1"], ["F1", None, "Wing"]])) for k in range(150)]
    for free in ([], [("z", 0)], [("z", 0), ("y", -1)]):
        rules = [("s", 2), ("t", 2), ("u", 4), *free]
        terms = [("s", "wing", 2), ("s", "CAR", 1), ("t", "pit", 2), ("t", "stop pit", 1), ("u", "é", 4), ("u", "", 1), ("t", ".", 1), ("gone", "f1", 9)]
        identifiers = [("s", "ica-2024-01"), ("t", "ICA-2024-01-02"), ("u", "ICA-2024-01-02"), ("gone", "ICA-2024-01")]
        frames = [spark.createDataFrame(r, d) for r, d in ((items, "id long, title string, categories array<string>"), (rules, "story_id string, min_score int"), (terms, "story_id string, term string, weight int"), (identifiers, "story_id string, value string"))]
        got = {r.id: (r.status, r.story_id, r.score) for r in route_items(*frames).collect()}
        assert got == {i[0]: choose(i, rules, terms, identifiers) for i in items}
    assert route_items(frames[0].limit(0), *frames[1:]).count() == 0
    assert {r.status for r in route_items(frames[0], *(f.limit(0) for f in frames[1:])).collect()} <= {"filtered", "unmatched"}


def test_feeds_of_all_kinds(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title> A </title><link href=''/><link href='https://a/b/?q=1'/><updated>2024-05-01T10:00:00Z</updated><content type='image/png' url='i.png'/></entry><entry><title>no link</title></entry></feed>"
    rdf = "<r:RDF xmlns:r='http://r' xmlns='http://p' xmlns:dc='http://d'><channel><title>t</title></channel><item><title>R</title><link>https://r/x</link><dc:date>never</dc:date><dc:creator>Me</dc:creator></item></r:RDF>"
    rows = [(1, atom), (2, rdf), (3, "<rss><channel><item>"), (4, None), (5, "  "), (6, "<rss><channel/></rss>"), (7, "no xml")]
    feeds = spark.createDataFrame(rows, "id int, xml string")
    assert {r.id: (r.state, r["items"]) for r in feed_states(feeds, "id").collect()} == {1: ("read", 2), 2: ("read", 1), 3: ("malformed", 0), 4: ("empty", 0), 5: ("empty", 0), 6: ("empty", 0), 7: ("malformed", 0)}
    got = {r.id: r for r in feed_entries(feeds, "id").collect()}
    assert set(got) == {1, 2} and (got[1].title, got[1].url, got[1].canonical_url, got[1].image_url) == ("A", "https://a/b/?q=1", "https://a/b", "https://a/i.png")
    assert (got[2].author, got[2].published_at, got[2].summary) == ("Me", None, None)
    assert got[1].published_at.isoformat() == "2024-05-01T10:00:00" and len(got[1].external_id) == 64


def test_gallery_pages(spark):
    page = """<h1> One <b>day</b></h1><figure><a href='../x.jpg'><img src='/t.jpg' alt='A'></a><figcaption>Cap (Photo by J  D/DPPI) </figcaption></figure>
    <img src='/wp-content/uploads/x.jpg?s=1' alt="B &amp; C"><img src='/wp-content/uploads/x.jpg?s=1' alt='again'><figure>nothing</figure><figure><img data-src='y.gif' src='y.jpg'></figure><figure><img src='z.png'><figcaption> </figcaption>"""
    rows = spark.createDataFrame([(1, "https://g/a/b", page), (2, "https://g", None), (3, "https://g", "")], "id int, url string, html string")
    got = gallery_pictures(rows, "id", "url", "html").orderBy("id", "n").collect()
    assert [(r.id, r.n, r.image_url, r.caption, r.photographer, r.agency, r.origin_provider) for r in got] == [
        (1, 1, "https://g/a/../x.jpg", "Cap (Photo by J D/DPPI)", "J D", "DPPI", "dppi"), (1, 2, "https://g/wp-content/uploads/x.jpg?s=1", "B & C", None, None, None),
    ]
    assert {r.gallery_title for r in got} == {"One day"}
