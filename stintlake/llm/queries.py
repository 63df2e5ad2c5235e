"""Registered queries of the training-data operators: thin wrappers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, filter_audit, html_text, near_dedup, packing, pii, quality, substring_dedup, suffix_dedup, toxicity, vector_packing
from .common import held_out, read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(read(spark, sf_dir, "documents"))

    def joined(kinds):
        kept = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.BASE_KINDS),
        F.sha2(joined(pii.BASE_KINDS), 256).alias("base_sha256"),
        joined(pii.BASE_KINDS + pii.EXTRA_KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_windows(read(spark, sf_dir, "documents")).drop("kept_text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenize_and_pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_quality, op3_toxicity, op4_near_dedup, op5_suffix_dedup, op6_html_text, op7_decontamination, op8_exact_dedup, op9_substring_dedup, op10_packing,
        op11_collocations, op12_vector_packing, op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
     g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.content) AS text_sha256
FROM t JOIN g USING (content)""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, f AS a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM parts)),
cutscores AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (l::HUGEINT * r))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM cutscores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND g.k > b.k AND g.f >= b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op13_filter_audit": r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marked AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM words LEFT JOIN labels USING (doc_id)),
fails AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM marked GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS x, filter_order[1 : s - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
fates AS (
  SELECT part, filter_order, step, x, n, good, bad, contains(failed, x) AS fail, failed = x AS alone,
    len(list_filter(string_split(before, ''), lambda y: y <> '' AND contains(failed, y))) > 0 AS gone
  FROM steps, fails),
summed AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fail), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND fail), 0)::BIGINT AS toxic_lost
  FROM fates GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM summed""",
}
