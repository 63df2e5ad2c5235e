import collections
import hashlib
import random
import re

import pytest

from stintlake.llm import components, html_text, near_dedup, queries, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, id string, n int, f long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [None, "", " \t\n ", "one", "One two", "one\x0btwo", "spam " * 3000, "x" * 5000]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 160))) for _ in range(12)]
    passage = " ".join(rng.choice(vocab) for _ in range(150))
    for b in base:
        texts += [b] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 6)):
            words = b.split(" ")
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words).replace(" ", "\n", 3))
        texts.append(" ".join(rng.sample(vocab, 9)) + " " + passage + " " + " ".join(rng.sample(vocab, 7)))
    rng.shuffle(texts)
    return spark.createDataFrame([(3 * k + 1, t, "x", 1, 2) for k, t in enumerate(texts)], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


def words_of(text, lower=False):
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_groups(rows, width, percent):
    sets = {}
    for d, text in rows:
        w = words_of(text, True)
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(odd, empty, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "SMALL", 2)  # take the way of large buckets too
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = near_dedup.near_groups(odd, width=width, percent=percent, rounds=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(pairs_of(odd), width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = near_dedup.drop_near_duplicates(odd, width=width, percent=percent).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.kept}
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_with_null_ids(spark):
    words = [f"w{k}" for k in range(100)]
    one, near, other = " ".join(words), " ".join([*words[:99], "end"]), " ".join(f"v{k}" for k in range(50))
    rows = [(4, one), (7, one), (None, one), (9, near), (None, near + " more"), (None, other), (12, other + " x"), (None, "lone text here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()), key=str)
    want = [(4, 4, True), (7, 4, False), (None, 4, False), (9, 4, False), (None, 4, False), (None, 12, False), (12, 12, True), (None, None, True), (None, None, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(4, one), (12, other + " x"), (None, "lone text here"), (None, None)], key=str)


def test_sequential_test_keeps_similar_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    fewest = near_dedup.least_matches(85)
    a = rng.integers(0, 1 << 32, (4000, near_dedup.VALUES), dtype=np.uint64).astype(np.uint32)
    for share, low, high in ((0.87, 0.999, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < share, a, a + np.uint32(1))
        assert low <= near_dedup.prune(a, b, fewest).mean() <= high


def test_stars_find_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.hi: r.lo for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}


def brute_repeats(rows, length):
    """A mask of the bytes in strings that start twice, for each text."""
    count = collections.Counter()
    for _, t in rows:
        b = t.encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    masks = []
    for _, t in rows:
        b = t.encode()
        mask = [0] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                mask[k : k + length] = [1] * length
        masks.append(mask)
    return masks


def brute_suffix(rows, length, short):
    want = []
    for (d, t), mask, less in zip(rows, brute_repeats(rows, length), brute_repeats(rows, short), strict=True):
        spans = sum(m and not p for m, p in zip(mask, [0, *mask], strict=False))
        kept = bytes(x for x, m in zip(t.encode(), mask, strict=True) if not m)
        want.append((d, len(mask), sum(mask), spans, hashlib.sha256(kept).hexdigest(), sum(less)))
    return sorted(want, key=str)


def suffix_rows(docs, **how):
    rows = suffix_dedup.remove_repeats(docs, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in rows), key=str)


@pytest.mark.parametrize(("length", "short", "gram", "most"), [(400, 300, 130, 1500), (40, 40, 15, 1500), (40, 30, 10, 2)])
def test_suffix_dedup_equals_brute_force(odd, empty, length, short, gram, most):
    assert suffix_rows(odd, length=length, short=short, gram=gram, most=most) == brute_suffix(pairs_of(odd), length, short)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_splits_large_groups(spark):
    """One phrase in many surroundings, some of which agree further on one side or the other."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    middle, sides = some(34), [some(20) for _ in range(6)]
    texts = [some(10) + rng.choice(sides)[-rng.randint(1, 20) :] + middle + rng.choice(sides)[: rng.randint(1, 20)] + some(10) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert suffix_rows(docs, length=60, short=44, gram=12, most=3) == brute_suffix(list(enumerate(texts)), 60, 44)


def test_suffix_dedup_takes_rows_not_ids(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(2))
    rows = [(None, a), (5, a), (5, b), (5, "x" + b), (7, "q" * 30), (None, None), (8, b[:450]), (9, "z" * 300)]
    got = suffix_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_suffix([(d, t or "") for d, t in rows], 400, 300)


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_equals_brute_force(odd, empty, parts):
    seen, want = set(), {}
    for d, t in pairs_of(odd):
        w = words_of(t)
        mask = [0] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                mask[k : k + 20] = [1] * 20
            seen.add(key)
        want[d] = (len(w), sum(mask), hashlib.sha256(" ".join(x for x, m in zip(w, mask, strict=True) if not m).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_windows(odd, parts=parts).collect()}
    assert got == want
    assert substring_dedup.dedup_windows(empty).count() == 0


def test_substring_dedup_orders_rows_of_one_id(spark):
    shared, one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "sab")
    rows = [("b", f"{shared} {one}"), ("b", f"{shared} {two}"), ("a", one), (None, two), ("c", "too short"), ("b", f"{shared} {two}")]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_windows(spark.createDataFrame(rows, "doc_id string, text string")).collect()]
    by = collections.Counter(got)
    assert by["a", 30, 0] == by[None, 30, 0] == by["c", 2, 0] == 1
    # all rows of "b" lose what other ids hold; of its two texts one keeps the shared words
    assert sorted(n for d, _, n in got if d == "b") in ([30, 30, 60], [30, 60, 60])


def test_fingerprint_index_is_opened_again(spark, odd, tmp_path):
    want = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_windows(odd, parts=1).collect())
    spans, path = None, f"{tmp_path}/index"
    for n, (batch, so_far) in enumerate(substring_dedup.batches_by_id(odd, 3, "doc_id")):
        session = spark.newSession()
        index = substring_dedup.FingerprintIndex.open(session, path) if n else substring_dedup.FingerprintIndex(session, path)
        sure, unsure = index.add(substring_dedup.keyed(batch, "doc_id", "text"))
        more = sure.unionByName(substring_dedup.stored(index.verify(unsure, substring_dedup.keyed(so_far, "doc_id", "text"))))
        index.compact()
        assert len(index.runs) == 1
        spans = more if spans is None else spans.unionByName(more)
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_spans(odd, spans, "doc_id", "text").collect())
    assert got == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


@pytest.mark.parametrize(("parts", "tasks"), [(1, 1), (1, 6), (3, 2)])
def test_substring_dedup_keeps_rows_that_repeat_an_id(spark, parts, tasks):
    rng = random.Random(4)
    text = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for k in range(1, 9)}
    shared = " ".join(f"s{k}" for k in range(30))
    text[2], text[6] = f"{text[2]} {shared}", f"{shared} {text[6]} {shared}"
    rows = [(k, t) for k, t in text.items() for _ in range(1 + k % 2 + 2 * (k in (2, 6)))] + [(9, text[3]), (9, text[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.dedup_windows(docs, parts=parts).collect())
    unique = text[6].removeprefix(f"{shared} ").removesuffix(f" {shared}")
    assert got == sorted((k, 60, unique) if k == 6 else (k, 60, "") if k == 9 else (k, 0, t) for k, t in rows)


def test_html_layout(spark, empty):
    html = (
        "<title>x</title><style>.h{display:none}</style><h1>Head &amp; er</h1><p>One <b>two</b><p>three<div class=h>no</div>"
        "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<br>ripe<td>12</table>"
        "<pre> keep  this\n   two</pre>tail<br>more<span hidden>z</span><script>no</script>"
    )
    want = "Head & er\n\nOne two\n\nthree\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName   Qty\napple  3\nfig    12\nripe\n\n keep  this\n   two\n\ntail\nmore"
    assert html_text.extract(html) == want
    pages = spark.createDataFrame([(1, html, "t"), (2, None, "t"), (3, "", "t"), (3, "<div>" * 5000 + "deep", "t"), (4, "<p>a</b></table><td>b<!-- <", "t")], "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract_text(pages).collect()]
    assert got[:4] == [(1, want), (2, ""), (3, ""), (3, "deep")] and "a" in got[4][1]
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<style>@media print{.m{display:none}} /* .m{display:none} */</style><p class=m>seen", "seen"),
        ("<style>@media screen{.m{display:none}}@media (max-width:9px){.n{display:none}}</style><p class=m>no<p class=n>seen", "seen"),
        ("<style>@media print{a{color:red}.m{display:none}}.h{display:none}</style><p class=m>seen<p class=h>no", "seen"),
        ("<style>.m{display:none} .m{display:block}</style><p class=m>seen", "seen"),
        ("<style>p.m{display:none} .m{display:block}</style><p class=m>no", ""),
        ("<style>.m{display:none!important} #i{display:block}</style><p class=m id=i>no", ""),
        ("<style>.m{display:none}</style><p class=m style='display:block'>seen<p hidden>no", "seen"),
        ("<style>div .m{display:none} ul>li.k{display:none} a:hover{display:none}</style><p class=m>one<div><b><i class=m>no</i></b>two</div><ul><li class=k>no<li><b class=k>three</b></ul><a>four</a>", "one\n\ntwo\n\n- three\n\nfour"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>seen</b> no</div>", "seen"),
        ("<svg><title>no</title><desc>no</desc><text>drawn</text><path/></svg> after <math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>", "drawn after x="),
        ("<p>a<svg class=z /> b <svg><g/>c</svg>", "a b c"),
        ("<input value=name><input type=hidden value=no><input type=submit value=Go>", "nameGo"),
        ("<style>@font-face{font-family:x}@supports (display:grid){.m{display:none}}</style><p class=m>no<p>yes", "yes"),
    ],
)
def test_html_visibility(html, want):
    assert html_text.extract(html) == want


def test_html_tables_stay_linear():
    long = "word " * 5_000
    out = html_text.extract("<table><tr><td>" + long + "<td>x" + "<tr><td>a<td>b" * 300 + "</table>")
    assert len(out) < 120_000 and out.count("word") == 5_000 and max(map(len, out.split("\n"))) <= html_text.COLUMN + 5
    assert html_text.extract("<p>" + "y" * 3_000_000).count("y") == 3_000_000


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    src = "/root/testdata/sf0.001"
    docs = queries.read(spark, src, "documents")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, src)
        assert out.columns == docs.columns
        before, kept = pairs_of(docs), {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            first = {}
            for d, t in before:
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert kept == set(first.values())
        elif name == "near_dedup":
            assert kept == {d for d, (_, c) in brute_groups(before, 5, 80).items() if c == d}
        docs = cp.stored(out)
    pieces = cp.STAGES[-1][1](spark, docs, src)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert pieces.select("doc_id").distinct().count() == docs.count() == cp.run(spark, src).select("doc_id").distinct().count()
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, src).count() == 0
