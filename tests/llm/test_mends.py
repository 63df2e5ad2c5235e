"""Cases that once crashed, lost texts, were quadratic or unbounded, and brute force for the toxicity model and HTML."""

import math
import os
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from stintlake.llm import exact_dedup, html_text, near_dedup, pii, quality, styles, substring_dedup, toxicity
from stintlake.llm.common import labelled_sample

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _label int, y int, k int, digest string, _digest string, _text_sha256 string, id int, kept boolean, mixed string, lost_id int"


def clash(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3, "a", "b", "c", 4, True, "m", 5) for d, t in rows], CLASH)


# marked sections, cut tags, selectors, list values


@pytest.mark.parametrize("html,text", [("<![ foo>bar", "bar"), ("<p>a<![if x <![ y", "a"), ("<![<![", ""), ("x<![endif]>y", "xy"), ("a<![CDATA[b]]>c", "ac"), ("a < b <c", "a < b")])
def test_broken_marked_sections_are_comments(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<p>x</p>" + '<a b="' * 150_000, "<![" * 300_000, "<!--" * 200_000, "</a " * 200_000, "<i>" * 100_000])
def test_pages_of_broken_tags_take_linear_time(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("depth", [3, 63, 70, 500])
def test_selectors_match_at_any_depth(depth):
    page = "<style>.a .b{display:none} .a > .a .c{display:none}</style>" + "<div class=a>" * depth + "<p class=b>hidden</p><p class=c>gone</p><p>shown</p>"
    assert html_text.extract(page) == "shown"


def test_children_and_descendants_mix():
    a, b, c = html_text.Node("a"), html_text.Node("b"), html_text.Node("c")
    a.append(b), b.append(c)
    match = lambda text, node: styles._matches(styles._selector(text), node)
    assert match("a > b c", c) and match("a c", c) and match("a > b > c", c)
    assert not match("a > c", c) and not match("b > a c", c) and not match("c c", c)


def test_list_values_and_placeholders():
    assert html_text.extract("<ol><li value=7>x<li>y<li value=z>z</ol>") == "7. x\n8. y\n9. z"
    assert html_text.extract("<input placeholder='your name'> <input value=v placeholder=p> <input type=hidden placeholder=q>") == "your name v"
    assert html_text.extract("<textarea placeholder=say></textarea>") == "say"


def page_of(rng, depth=0):
    """(html, lines) of random blocks that stand one line each, with hidden parts; end tags are left out at random."""
    html, lines = "", []
    for _ in range(rng.randint(1, 4)):
        word = lambda: "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 6)))
        kind = rng.choice(["div", "hide", "inline", "list", "table", "nest"] if depth < 3 else ["div", "inline"])
        if kind == "div":
            a, b = word(), word()
            html += f"<div> {a}\n  <b>{b}</b></div>"
            lines.append(f"{a} {b}")
        elif kind == "hide":
            html += rng.choice(["<div hidden>{}</div>", "<div style='display: none'>{}</div>", "<script>'{}'</script>", "<template><p>{}</template>", "<div class=gone>{}</div>"]).format(word())
        elif kind == "inline":
            a, b, c = word(), word(), word()
            html += f"<section>{a}<i>{b}</i><span class=gone>{c}</span>&amp;</section>"
            lines.append(f"{a}{b}&")
        elif kind == "list":
            items = [word() for _ in range(rng.randint(1, 4))]
            ordered, end = rng.random() < 0.5, rng.choice(["</li>", ""])
            html += ("<ol>" if ordered else "<ul>") + "".join(f"<li>{x}{end}" for x in items) + ("</ol>" if ordered else "</ul>")
            lines += ["", *((f"{n}. " if ordered else "- ") + x for n, x in enumerate(items, 1)), ""]
        elif kind == "table":
            cells = [[word() for _ in range(3)] for _ in range(rng.randint(1, 3))]
            end = rng.choice(["</td>", ""])
            html += "<table>" + "".join("<tr>" + "".join(f"<td>{x}{end}" for x in row) for row in cells) + "</table>"
            width = [max(len(row[k]) for row in cells) for k in range(3)]
            lines += ["", *("  ".join(x.ljust(w) for x, w in zip(row, width, strict=True)).rstrip() for row in cells), ""]
        else:
            inner, more = page_of(rng, depth + 1)
            html += f"<div>{inner}</div>"
            lines += more
    return html, lines


def test_html_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        html, lines = page_of(rng)
        want = []
        for line in lines:
            if line or want and want[-1]:
                want.append(line)
        while want and not want[-1]:
            want.pop()
        assert html_text.extract("<style>.gone {display:none}</style>" + html) == "\n".join(want), html


# personal data


def test_many_spans_take_linear_time_and_agree_with_the_plain_search():
    def took(n):
        began = time.process_time()
        found = pii.find_spans("call 555-123-4567 " * n)
        assert len(found) == n
        return time.process_time() - began

    took(1_000)
    assert took(64_000) < 20 * max(took(8_000), 0.05)
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice(["call", "555-123-4567", "+1 555-123-4567", "123-45-6789", "ssn", "DE89370400440532013000", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "tel"]) for _ in range(20))
        spans = pii.find_spans(text)
        base = [s for s in spans if s[0] in pii.BASE_KINDS]
        extra = [s for s in spans if s[0] in pii.EXTRA_KINDS]
        assert not any(x[1] < y[2] and y[1] < x[2] for x in extra for y in base + [e for e in extra if e is not x])


# samples and models


def test_the_sample_is_bounded_in_rows_and_names_may_clash(spark):
    docs = clash(spark, [(1, f"good words {k}") for k in range(300)] + [(2, None), (None, "x"), (3, "bad " * 5)])
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    sample, many = labelled_sample(docs, labels, "quality", 50, {"text": F.col("text")})
    assert sample.columns == ["text", "y", "k"] and many and not labelled_sample(docs, labels, "quality", 400, {"text": F.col("text")})[1]
    seen = []
    train = quality.train
    quality.train = lambda rows, *a: seen.append(len(rows)) or train(rows, *a)
    try:
        model = quality.fit(docs, labels, fit_rows=50)
    finally:
        quality.train = train
    assert seen == [50]
    scored = quality.with_quality(docs, model)
    assert scored.count() == 303 and scored.columns == [*docs.columns, "score"]
    weights = toxicity.fit(docs, labels, fit_rows=50)
    assert docs.select(toxicity.toxicity_score(weights, F.col("text")).alias("s")).where("s between 0 and 1").count() == 303


def test_without_labels_the_score_is_one_half(spark):
    docs = clash(spark, [(1, "some words"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.with_quality(docs, quality.fit(docs, labels)).collect()} == {0.5}


def plain_ftrl(rows, epochs):
    """Per-coordinate FTRL-proximal with one dictionary entry a feature, and a bias without L1."""
    z, n, zb, nb = {}, {}, 0.0, 0.0
    rng = np.random.default_rng(toxicity.SEED)

    def weight(k):
        value = z.get(k, 0.0)
        if abs(value) <= toxicity.L1:
            return 0.0
        return -(value - math.copysign(toxicity.L1, value)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            index, y = rows[at]
            w = {k: weight(k) for k in index.tolist()}
            b = -zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for k, old in w.items():
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * old
                n[k] = n.get(k, 0.0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * b
            nb += g * g
    return {k: weight(k) for k in z if weight(k)}, -zb / ((toxicity.BETA + math.sqrt(nb)) / toxicity.ALPHA)


def test_toxicity_weights_equal_a_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 400, 12)), float(k % 3 == 0)) for k in range(200)]
    for index, y in rows:
        index[0] = 0 if y else 1
    rows = [(np.unique(i), y) for i, y in rows]
    got = toxicity.train(rows, bits=9, epochs=3)
    want, bias = plain_ftrl(rows, 3)
    assert got.slots.tolist() == sorted(want) and got.bias == pytest.approx(bias, rel=1e-6)
    assert np.allclose(got.weights, [want[k] for k in sorted(want)], rtol=1e-5)
    assert 0 < len(want) < 400  # L1 leaves few


# near and exact duplicates of rows that share an id


def test_rows_of_one_id_fare_by_their_own_text(spark):
    long, other = " ".join(f"w{k}" for k in range(100)), " ".join(f"v{k}" for k in range(80))
    rows = [(1, long), (2, long + " more"), (2, other), (3, None), (3, other + " x"), (None, long), (None, "alone and well"), (4, ""), (4, "")]
    left = near_dedup.drop_near_duplicates(clash(spark, rows), width=5, percent=80)
    assert left.columns == clash(spark, []).columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(1, long), (2, other), (3, None), (None, "alone and well"), (4, ""), (4, "")], key=key)
    small = near_dedup.drop_near_duplicates(clash(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "x y z w v u quite different")]))
    assert sorted(r.text for r in small.collect()) == ["a b c d e f", "x y z w v u quite different"]
    exact = exact_dedup.drop_exact_duplicates(clash(spark, [(1, "a"), (2, "a"), (2, "b")]))
    assert sorted(r.text for r in exact.collect()) == ["a", "b"] and exact.columns == left.columns


def test_stages_keep_rows_of_one_id_and_take_empty_tables(spark):
    docs = clash(spark, [(1, " ".join(f"w{k}" for k in range(100))), (2, " ".join(f"w{k}" for k in range(101))), (2, " ".join(f"v{k}" for k in range(80)))])
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 2
    empty = clash(spark, [])
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


# the index


def test_batches_out_of_order_are_refused(spark):
    words = " ".join(f"w{k}" for k in range(30))
    batch = lambda d: spark.createDataFrame([(d, 0, words)], "id long, k long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    index.add(batch(10))
    for late in (5, 10, None):
        with pytest.raises(ValueError, match="order of id"):
            index.add(batch(late))
    again = substring_dedup.FingerprintIndex.open(spark, index.path)
    assert again.last == 10
    with pytest.raises(ValueError, match="order of id"):
        again.add(batch(9))
    spans, _ = again.add(batch(11))
    assert spans.select("id", "k", "lo", "end").distinct().count() >= 1 and again.last == 11


def shuffled_rows(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def test_index_shuffles_a_batch_once(spark):
    """Older runs lie in buckets of the anchor: a batch meets them there, and neither is shuffled for it."""
    rng, spark = random.Random(12), spark.newSession()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shared = [f"s{k}" for k in range(40)]
    text = lambda: " ".join([f"w{rng.randrange(10**6)}" for _ in range(200)] + shared[: rng.randint(0, 40)])
    batch = lambda low: spark.createDataFrame([(d, d, text()) for d in range(low, low + 200)], "id long, k long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    index.add(batch(0))
    before = shuffled_rows(spark)
    index.add(batch(1000))
    entries = spark.read.parquet(f"{index.path}/{index.runs[-1]}").count()
    moved = sum(n for k, n in shuffled_rows(spark).items() if k not in before)
    assert entries > 3000
    assert entries <= moved <= entries + 500, (entries, moved)


def test_word_hashes_depend_on_the_word_alone():
    rng, most = random.Random(13), substring_dedup.PIECE
    vocabulary = [b"a", b"b", b"ab", b"ba", b"\0a", "\u00e9t\u00e9".encode(), b"x" * (most - 1), b"x" * most, b"y" * (most + 1), b"z" * (3 * most)] + [b"w%d" % k for k in range(300)]
    words = [rng.choice(vocabulary[10:]) for _ in range(40_000)]
    for k, w in enumerate(vocabulary[:10] * 3):
        words.insert(rng.randrange(len(words)) if k % 3 else 0, w)
    symbols, data, where = substring_dedup.word_reader()(b" ".join(words).decode())
    assert data == b" ".join(words) and [data[a : b - 1] for a, b in zip(where.tolist(), where[1:].tolist(), strict=False)] == words
    by = {}
    for w, h in zip(words, symbols.tolist(), strict=True):
        by.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)
    for nothing in (None, "", " \n\t "):
        assert [len(x) for x in substring_dedup.word_reader()(nothing)] == [0, 0, 1]


def test_substring_dedup_leaves_no_shuffle_files(spark):
    sc, key = spark.sparkContext, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: sum(p.endswith(".data") for d in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for p in names)
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, words) for k in range(6)], "doc_id long, text string")
    before, was = held(), spark.conf.get(key, None)
    out = substring_dedup.dedup_windows(docs)
    assert held() <= before and spark.conf.get(key, None) == was
    assert sorted(r.n_removed for r in out.collect()) == [0] + [60] * 5
