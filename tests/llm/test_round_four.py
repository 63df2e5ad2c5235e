"""Findings of round three."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stintlake.llm import collocations, quality
from stintlake.llm.common import stored


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_rare_phrases_never_leave_a_shard_by_name(spark, monkeypatch):
    rows = [(k, f"a b r{k % 7} s{k % 5} a b", "en", "s") for k in range(60)]
    named, before = [], collocations.summed

    def summed(rows, least):
        named.append({bytes(r.phrase) for r in rows.select("phrase").distinct().collect()})
        return before(rows, least)

    monkeypatch.setattr(collocations, "summed", summed)
    collocations.collocations(docs_of(spark, rows), least=20, top=5).collect()
    assert {p for found in named for p in found if b" " in p} == {b"a b"}


def test_slots_come_back_from_planes_and_sum(spark):
    slots = np.array([0, 1, 255, 256, 1 << 16, (1 << 32) - 1], np.uint64)
    assert collocations.from_planes(collocations.planes(slots)).tolist() == slots.tolist()
    one, n = collocations.merged(np.array([7, 3, 7], np.uint64), np.array([1, 2, 4]))
    assert one.tolist() == [3, 7] and n.tolist() == [2, 5]


def test_large_rows_stand_in_small_row_groups(spark):
    files = stored(spark.range(0, 10, 1, 1).withColumn("x", F.lit("x")), "rows", 4).inputFiles()
    sizes = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    assert [m.row_group(k).num_rows for m in sizes for k in range(m.num_row_groups)] == [4, 4, 2]


def test_the_quality_sample_stays_numbers_of_the_table(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} and more", "en", "s") for k in range(20)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen, before = [], quality.train

    def train(rows, slots):
        seen.extend(rows)
        return before(rows, slots)

    monkeypatch.setattr(quality, "train", train)
    quality.fit(docs, labels)
    assert seen and all(index.dtype == np.int32 and not index.flags.owndata and value.dtype == np.float64 for index, value, _ in seen)


def test_a_pass_of_stars_is_two_shuffles(spark):
    """Components that are stars already take one pass: an exchange for each star, the write and one look at it."""
    from stintlake.llm import components

    edges = spark.createDataFrame([(k * 1000 + j, k * 1000) for k in range(20) for j in range(30)] * 2, "a long, b long")
    spark.sparkContext.setJobGroup("stars", "stars")
    got = components.stars(edges)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stars")
    spark.sparkContext.setJobGroup("after", "after")
    assert sorted(map(tuple, got.collect())) == [(k * 1000 + j, k * 1000) for k in range(20) for j in range(1, 30)]
    assert 1 <= len(jobs) <= 6
    assert components.stars(edges.limit(0)).count() == 0


def test_unseen_words_of_many_texts_go_to_the_tokenizer_as_one(monkeypatch):
    from stintlake.llm import packing, queries

    words = packing.WordTokens(queries.tokenizer_path())
    exact, calls = packing.WordTokens(queries.tokenizer_path()).encode, []
    texts = [f"{a}{b}x {a.upper()}{b}$$$ É{b}{a}, ǅ{b}! ßΑΣ{a} o'{b}" for a in ("qua", "zel", "日本", "ñi") for b in ("vor", "tük", "à")] + ["", " \t", "a <|endoftext|>b", "x\x1cy don'T", "İa e\u0301b 12.5%"]
    with monkeypatch.context() as m:
        m.setattr(words, "encode", lambda text: calls.append(text) or exact(text))
        assert words.ids_of(texts) == list(map(exact, texts))
    assert calls == [t for t in texts if "<|" in t or "\x1c" in t]
    few = packing.WordTokens(queries.tokenizer_path(), limit=5)
    assert few.ids_of(texts) == list(map(exact, texts)) and len(few) - few.forms <= 5
    few.ends[:] = False  # a vocabulary that does not mark ends
    assert few.ids_of(texts) == list(map(exact, texts))
