"""Expressions on editorial text: clean-up, references, relevance, dates, sentences."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# fixed values: phrases that begin a promotional tail, title decorations by source, relevance marks, reference ids
PROMO = ("keep reading", "read also:", "watch every session", "watch all sessions", "live on sky sports")
TITLE_CHROME = {"team_haas": (r"^Haas F1 Team\s*\|\s*",), "team_racing_bulls": (r"\s*\|\s*VCARB\s*\|\s*Visa Cash App RB\s*$", r"\s*\|\s*Visa Cash App RB\s*$")}
RELEVANT = r"(?i)\bformula\s+one\b|\bformula\s*1\b|\bf1\b"
REFERENCE = r"(?i)\bICA-\d{4}(?:-\d{2})+\b"
MOST_SENTENCES, SHORT_SENTENCE, SAME_SENTENCE = 2, 24, 0.72


@F.pandas_udf(StringType())
def _unescape_twice(values: pd.Series) -> pd.Series:
    """Entities of every name, decoded twice as some feeds encode twice; no built-in knows the list."""
    return values.map(lambda v: html.unescape(html.unescape(v)), na_action="ignore")


def clean_text(value: Column) -> Column:
    """Entities decoded, tags out, white space collapsed; nothing left is null."""
    bare = F.regexp_replace(F.regexp_replace(_unescape_twice(value), "<[^>]+>", " "), r"[\s\x{A0}]+", " ")
    return F.nullif(F.trim(bare), F.lit(""))


def clean_summary(value: Column) -> Column:
    """Clean text up to the first promotional phrase and the punctuation before it."""
    tail = r"(?i)\s*(?:[.;|–—-]+\s*)?(?:" + "|".join(PROMO) + ").*$"
    return F.nullif(F.trim(F.regexp_replace(clean_text(value), tail, "")), F.lit(""))


def title_without_chrome(source: Column, title: Column) -> Column:
    """Clean title without the source's decoration; a title that is only that stays whole."""
    clean = F.coalesce(clean_text(title), F.lit("Untitled Formula 1 story"))
    out = clean
    for key, patterns in TITLE_CHROME.items():
        for pattern in patterns:
            bare = F.regexp_replace(F.regexp_replace(out, "(?i)" + pattern, ""), r"^[ |–—\-:]+|[ |–—\-:]+$", "")
            out = F.when(source == key, bare).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), clean)


def is_relevant(text: Column) -> Column:
    return text.rlike(RELEVANT)


def reference_ids(text: Column) -> Column:
    """Sorted distinct reference numbers in upper case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), F.upper)))


def local_moment(text: Column) -> Column:
    """``dd.mm.yy HH:MM CET`` or ``CEST`` within a text, in UTC (session time zone UTC)."""
    pattern = r"(\d{2}\.\d{2}\.\d{2}) (\d{2}:\d{2}) (CEST|CET)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    moment = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2)), F.lit("dd.MM.yy HH:mm"))
    return moment - F.make_dt_interval(hours=F.when(part(3) == "CEST", 2).otherwise(1))


# fixed values: phrases of titles that hold no story, for all sources and for the teams' own
NO_STORY = (
    "daily discussion thread", "ask r/formula1 anything", "featured comment", "send us your questions", "q&a", "in photos", "in pictures",
    "through our lens", "spotted in the paddock", "creator platform", "make your 2026 spanish gp predictions", "watch behind the scenes",
)
NO_TEAM_STORY = (
    "a seat at the table", "five things you can t teach", "some assembly required", "the team takes over the farmer s dog pub", "explore budapest",
    "fan designed stickers", "time pieces", "hospitality experience", "football inspired livery and kit", "hot lap car",
)
STRONG_RELATIONS = ("subject", "directly_involved")
STORY_REASONS = ("article_default_v2", "community_with_strong_entity")


def story_reason(title: Column, source_class: Column, relations: Column) -> Column:
    """Why an item makes a story or not; ``relations`` are those of the entities it names, null for none."""
    said = T.normal(F.coalesce(clean_text(title), F.lit("")))
    any_of = lambda phrases: reduce(Column.__or__, [F.contains(said, T.normal(F.lit(p))) for p in phrases])
    own = F.coalesce(source_class, F.lit("")) == "first_party_team"
    strong = F.coalesce(F.exists(relations, lambda r: r.isin(*STRONG_RELATIONS)), F.lit(False))
    rules = [
        (any_of(NO_STORY), "non_story_container"),
        (own & any_of(NO_TEAM_STORY), "first_party_evergreen_or_promo"),
        (own & said.startswith("explore "), "first_party_destination_content"),
        ((source_class == "community_signal") & ~strong, "community_without_strong_entity"),
        (source_class == "community_signal", "community_with_strong_entity"),
    ]
    return T.cascade(rules, "article_default_v2")


def is_story(reason: Column) -> Column:
    return reason.isin(*STORY_REASONS)


def sentences(text: Column) -> Column:
    """Sentences of a summary that are long enough to quote."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) >= SHORT_SENTENCE)


def extractive_summary(texts: Column) -> Column:
    """From texts in order of preference, each one's first sentence unlike those taken before: two
    in all, or one where there is a single text. Null when none is long enough."""
    words = lambda s: F.array_distinct(F.split(T.normal(s), " "))
    most = F.when(F.size(texts) >= 2, MOST_SENTENCES).otherwise(1)

    def take(chosen: Column, text: Column) -> Column:
        fresh = F.filter(sentences(text), lambda s: ~F.exists(chosen, lambda c: T.jaccard(words(s), words(c)) >= SAME_SENTENCE))
        return F.when((F.size(chosen) < most) & (F.size(fresh) > 0), F.concat(chosen, F.slice(fresh, 1, 1))).otherwise(chosen)

    chosen = F.aggregate(texts, F.array().cast("array<string>"), take)
    return F.nullif(F.array_join(chosen, " "), F.lit(""))
