import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from stintlake.llm import collocations, filter_audit, packing, queries, vector_packing

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, id int, part string, mask string, f long, words string"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", "y", 7, "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op11_collocations", "op13_filter_audit"])
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


# op11


def phrases_by_hand(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                count.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: n for p, n in count.items() if n >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(q[0] == lang and len(q) > len(w) + 1 and n >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, n in often.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def spoken(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "b", "B", "çé", "İx", "k m", "q\x1fz", "the", "of"]
    odd = [None, "", " \t ", ".,;", "a a a a a a a a", "a b\x0bA B\ta  b.a\nb", "x" * 30_000, "the of " * 4_000]
    texts = odd + [rng.choice(" .\t").join(rng.choices(vocab, k=rng.randint(1, 40))) + rng.choice(["", ". ", "!?", "\r\n"]) for _ in range(n)]
    return [(k // 2 if k % 9 == 0 else k, t, rng.choice(["en", "en", "en", None, "und", ""]), "s") for k, t in enumerate(texts)]


@pytest.mark.parametrize("size,bits", [(1 << 21, 1 << 27), (64, 1 << 15), (700, 1 << 15)])
def test_collocations_equal_brute_force(spark, size, bits):
    rows = spoken(size, 150)
    got = collocations.collocations(docs_of(spark, rows).repartition(3), least=4, top=25, size=size, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 4, 25)


def test_filters_that_are_full_cost_no_result(spark, monkeypatch):
    rows = spoken(3, 80)
    monkeypatch.setattr(collocations, "hash_filter", lambda frequent, bits: np.full(4096, 255, np.uint8))
    got = collocations.collocations(docs_of(spark, rows), least=3, top=40)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 3, 40)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_037_000_499_977
    frequent = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 99_999_999_999_989)], "lang string, n long")
    row = collocations.scored(frequent, totals).first()
    assert row.score == 1000 * (big - 1) * 99_999_999_999_989 // (big * (big + 2))


def test_bitmaps_shift_across_bytes_and_stop_at_blanks():
    at = np.array([0, 6, 7, 8, 15, 63, 64])
    moved = collocations.Bits.of(np.zeros(len(at), np.int64), at).shifted()
    assert sorted(int(a) * 8 + b for a, x in zip(moved.at, moved.byte, strict=True) for b in range(8) if x >> b & 1) == [x + 1 for x in at]
    ids = collocations.Ids({b"\n": 0})
    assert collocations.word_ids(b"A b,c\n\td", ids).tolist() == [1, 2, 0, 3, 0, 4, 0]


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(None, None, None, None), (1, "one two", "en", "s")])).count() == 0


# op12


def checked_bins(rows, limits, padded):
    """Bins by sequence, after the checks that hold for any packing."""
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in pieces))
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and min(r.length for r in pieces) > 0
        assert ends[-1] <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
        assert padded or ends[-1] & (ends[-1] - 1) == 0
    return bins


def test_every_id_of_the_documents_is_packed_once_without_padding(spark):
    path = queries.tokenizer_path()
    rng = random.Random(5)
    texts = [None, "", " ", "word", "Ünïcode ΣΑΣ <|endoftext|> 12", "deep water " * 6_000, *(" ".join(rng.choices(["alpha", "beta,", "gamma!", "Delta"], k=rng.randint(1, 900))) for _ in range(120))]
    rows = [(k // 2, t, "en", "s") for k, t in enumerate(texts)]
    got = vector_packing.pack_documents(docs_of(spark, rows).repartition(3), path).collect()
    checked_bins(got, vector_packing.Limits(), False)
    assert got[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    tokenizer = packing._words(path).tokenizer
    want = collections.defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(want)
    for d, documents in want.items():
        left = sorted(pieces[d])
        for ids in documents:  # two documents may share an id
            at = 0
            while at < len(ids):
                piece = next(p for p in left if p[0] == len(ids) and p[1] == at and p[3] == zlib.crc32(np.array(ids[at : at + p[2]], "<u4").tobytes()))
                left.remove(piece)
                at += piece[2]
            assert at == len(ids)
        assert not left


def test_ids_of_unseen_words_equal_the_tokenizers():
    rng = random.Random(21)
    words = packing.WordTokens(queries.tokenizer_path(), limit=40)
    letters = "abcXYZéÉßİΣσς12.,!-_#'<|> \t\n\x1c\u00a0日本"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert vector_packing.text_ids(words, text) == words.encode(text)
    assert len(words) - words.forms <= 40 + 60


def test_limits_on_segments_and_loss_hold_for_instruction_data(spark):
    rng = random.Random(8)
    say = lambda a, b: " ".join(rng.choices(["yes", "no", "why", "because"], k=rng.randint(a, b)))
    rows = [(k, [(say(1, 90), False), (say(0, 30), True)] * rng.randint(1, 3)) for k in range(160)] + [(900, []), (901, None), (902, [(None, None)]), (903, [None])]
    examples = spark.createDataFrame(rows, "doc_id long, parts array<struct<text string, loss boolean>>").repartition(2)
    for cut in (True, False):
        limits = vector_packing.Limits(256, 5, 90)
        got = vector_packing.packed_examples(examples, queries.tokenizer_path(), limits, cut).collect()
        bins = checked_bins(got, limits, not cut)
        assert {r.doc_id for r in got} == {k for k, _ in rows}
        total = sum(r.doc_tokens for r in got if r.start == 0)
        assert sum(r.length for r in got) == total
        if not cut:
            whole = [r for r in got if r.length == r.doc_tokens]
            assert len(whole) > 0.6 * len(rows) and total / (256 * len(bins)) > 0.5


def test_the_scarce_limit_steers_the_choice():
    def piece(k, n, loss):
        return vector_packing.Piece(k, 0, np.zeros(n, "<u4"), np.arange(n) < loss, n)

    packer = vector_packing.Packer(vector_packing.Limits(100, 10, 20), False)
    for k in range(6):
        list(packer.add(piece(k, 50, 20 if k % 2 else 0)))
    bins = list(packer.finish())
    assert len(bins) == 3 and all(sorted(p.loss for p in b) == [0, 20] for b in bins)
    with pytest.raises(ValueError):
        vector_packing.Packer(vector_packing.Limits(loss=0), True)


def test_memory_of_the_packer_is_bounded():
    packer = vector_packing.Packer(vector_packing.Limits(64, 8, 64), True, waiting=10, waiting_tokens=300)
    rng, bins = random.Random(1), []
    for k in range(500):
        bins += packer.add(vector_packing.Piece(k, 0, np.zeros(rng.randint(1, 200), "<u4"), None, 0))
        assert packer._count() <= 10 and packer.held <= 300
    bins += packer.finish()
    assert all(sum(len(p.ids) for p in b) in (1, 2, 4, 8, 16, 32, 64) for b in bins)


def test_packing_of_no_rows(spark):
    assert vector_packing.pack_documents(docs_of(spark, []), queries.tokenizer_path()).count() == 0


# op13


def audit_by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = collections.defaultdict(list)
    for d, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first.get(t, d)}
        parts[s or ""].append(({k for k, v in failed.items() if v}, d in good, d in bad))
    out = []
    for part, docs in parts.items():
        rows_, removed_by = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, k in enumerate(order, 1):
                gone = [x for x in alive if k in x[0]]
                alive = [x for x in alive if k not in x[0]]
                removed_by[k] += len(gone)
                total = sum(k in x[0] for x in docs)
                rows_.append((part, "".join(order), step, len(alive), len(gone), total - len(gone), sum(x[0] == {k} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), k))
        out += [(*r[:-1], removed_by[r[-1]]) for r in rows_]
    return sorted(out)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "A" * 40, "#", "x\x0by\x1cz", "ÄÉ ä", *(" ".join(rng.choices([f"w{k}" for k in range(rng.choice([20, 900]))] + ["UP", "$"] * rng.randint(0, 1), k=rng.choice([5, 199, 200, 450]))) for _ in range(40))]
    rows = [(rng.choice([k, k, k, 7, None]), rng.choice(texts), "en", rng.choice(["a", "a", "b", None, ""])) for k in range(160)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(120)] + [(7, 1, 0), (None, 1, 1), (3, 1, 1)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(docs_of(spark, rows).repartition(3), marks)
    assert got.schema["step"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, labels)


def test_parity_sums_invert_exactly():
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 10**12, (3, 32))
    assert (filter_audit.cells_of(cells @ filter_audit.SIGNS) == cells).all()
    with pytest.raises(ArithmeticError):
        filter_audit.cells_of(np.eye(1, 32, dtype=np.int64))


def test_filter_audit_of_no_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs_of(spark, []), marks).count() == 0
    only = filter_audit.filter_audit(docs_of(spark, [(1, "x", "en", None)]), marks).collect()
    assert len(only) == 600 and {r.part for r in only} == {""}
