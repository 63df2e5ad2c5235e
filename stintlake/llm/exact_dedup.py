"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

1. Local: rows with the same digest, salt and *content* are combined before the shuffle
   (partial aggregation) and after it, so a group that holds a third of all rows is spread
   over ``salts`` tasks and shrinks to one row per map task first.
2. Global: the salt winners of a digest meet once more, again grouped by digest and content.
3. Only groups with more than one row are joined back; they are replicated once per salt so
   that the rows of a hot group are spread over ``salts`` keys.

Content is part of the grouping key in both combining steps, so two texts that share a digest
never merge. The join back uses the SHA-256, a second hash and the length of the content.

Defined results: a null text counts as empty; rows that repeat a doc_id are rows of their own
(they count in ``group_size``; all rows whose doc_id is the smallest are kept); a null doc_id
loses against any other id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, unused


def content_of(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("_id"), content_of(text_col).alias("_content")).select(
        "_id",
        "_content",
        F.sha2(F.col("_content"), 256).alias("_sha"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"),
    )
    by_salt = rows.groupBy("_sha", "_salt", "_content").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = (
        by_salt.groupBy("_sha", "_content")
        .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .where("_n > 1")
        .select("_sha", F.xxhash64("_content").alias("_h"), F.length("_content").alias("_len"), "_keep", "_n")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    )
    keys = ["_sha", "_h", "_len", "_salt"]
    marked = rows.select("_id", "_sha", F.xxhash64("_content").alias("_h"), F.length("_content").alias("_len"), "_salt")
    keep = F.coalesce("_keep", "_id")
    return marked.join(groups, keys, "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Losers are few against the
    corpus, so they are the side that is joined: by id, null or not, and digest, as another
    text of a loser's id may be clean."""
    own, lost, lost_id = unused("own_sha256", docs), unused("lost_sha256", docs), unused("lost_id", docs)
    losers = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(lost_id), F.col("text_sha256").alias(lost)).distinct()
    rows = docs.withColumn(own, F.sha2(content_of(text_col), 256))
    return rows.join(losers, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(own) == F.col(lost)), "left_anti").drop(own)
