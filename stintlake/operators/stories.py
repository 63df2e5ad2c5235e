"""Same-story scoring of items from different providers.

Items meet through blocks: an equal event, an equal title, or a shared entity within a window of
days. A block key is an equi-join, and the days are bucketed, so no item is tested
against all others. Of the scoring rules the first that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintlake.functions import text as T

# fixed values: words left out of title tokens, and the vocabulary of named events
STOP = ["a", "an", "and", "are", "as", "at", "for", "from", "in", "is", "of", "on", "the", "to", "with"]
TEAMS = ("alpine", "aston martin", "audi", "cadillac", "ferrari", "haas", "mclaren", "mercedes", "racing bulls", "red bull", "williams")
LEADERS = ("chief technical officer", "technical chief", "tech chief", "technical boss")
APPOINTS = ("joins", "join", "hires", "hire", "appoints", "appointed")
CALENDAR_OF = ("formula 1", "formula one", "f1")
EXHIBITION, EXHIBITION_WORDS = "max vs 100", ("verstappen", "100", "kart")
WINDOW_DAYS, CLOSE_HOURS = 14, 72


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def event_fingerprint(title: Column) -> Column:
    """The identity of a few kinds of named events, or null."""
    return T.bound(T.normal(title), _named_event)


def _named_event(v: Column) -> Column:
    season = F.nullif(F.regexp_extract(v, r"\b(20\d{2})\b", 1), F.lit(""))
    team = F.coalesce(*[F.when(F.contains(v, F.lit(t)), F.lit(t.replace(" ", "_"))) for t in TEAMS])
    all_of = F.lit(True)
    for word in EXHIBITION_WORDS:
        all_of = all_of & F.contains(v, F.lit(word))
    exhibition = F.contains(v, F.lit(EXHIBITION)) | all_of
    return (
        F.when(season.isNotNull() & F.contains(v, F.lit("calendar")) & _any(v, CALENDAR_OF), F.concat(F.lit("calendar_announcement:"), season))
        .when(exhibition, F.lit("exhibition_event:max_vs_100"))
        .when(team.isNotNull() & _any(v, APPOINTS) & _any(v, LEADERS), F.concat(F.lit("personnel_appointment:"), team, F.lit(":technical_leadership")))
    )


def same_story_pairs(items: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Scored pairs (left_id < right_id) of items (id, provider, title, published_at, strong array,
    races array): score, method, similarity. An item without a time meets others by event
    and title only. Equal titles of 12 letters or more decide a pair by themselves: such pairs are made from the titles
    that several providers have, and carry nothing else of their items."""
    base = items.select("id", "provider", "published_at", "strong", "races", T.normal(F.col("title")).alias("norm"), T.tokens(F.col("title"), STOP).alias("words"), event_fingerprint(F.col("title")).alias("event")).where("norm <> ''")
    day = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / 86400 / window_days)
    entity = F.array_union(F.coalesce("strong", F.array()), F.coalesce("races", F.array()))
    key = lambda kind, value: F.concat(F.lit(kind), value)
    long_title = lambda norm: F.length(norm) >= 12
    own = lambda shifts: F.array_compact(F.concat(F.array(key("e:", F.col("event")), F.when(~long_title("norm"), key("t:", F.col("norm")))), F.coalesce(F.flatten(F.transform(entity, lambda e: F.array(*[F.concat(F.lit("n:"), e.cast("string"), F.lit("@"), (day + k).cast("string")) for k in shifts]))), F.array().cast("array<string>"))))
    left, right = base.select("id", "provider", F.explode(own((0,))).alias("key")), base.select(F.col("id").alias("other"), F.col("provider").alias("p2"), F.explode(own((-1, 0))).alias("key"))
    # of two items in neighbouring spans the later one finds the earlier, whichever id is smaller
    met = left.join(right, "key").where("id <> other and provider <> p2").select(F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id")).distinct()
    side = lambda p: base.select(*[F.col(c).alias(f"{p}_{c}") for c in base.columns])
    both = met.join(side("left"), "left_id").join(side("right"), "right_id").where(~((F.col("left_norm") == F.col("right_norm")) & long_title("left_norm")))
    count = lambda c: F.coalesce(F.size(F.array_intersect(f"left_{c}", f"right_{c}")), F.lit(0))
    gap = F.abs(F.unix_seconds(F.col("left_published_at").cast("timestamp")) - F.unix_seconds(F.col("right_published_at").cast("timestamp")))
    both = both.withColumns({"n": count("strong"), "r": count("races"), "similarity": T.jaccard(F.col("left_words"), F.col("right_words")), "close": gap <= CLOSE_HOURS * 3600, "in_window": F.coalesce(gap <= window_days * 86400, F.lit(True))})
    scored = both.withColumn("s", _score()).where("s.score is not null").select("left_id", "right_id", "s.score", "s.method", F.bround("similarity", 3).alias("similarity"))
    return scored.unionByName(_equal_titles(base.where(long_title("norm"))))


def _equal_titles(base: DataFrame) -> DataFrame:
    several = base.groupBy("norm").agg(F.min("provider").alias("low"), F.max("provider").alias("high")).where("low <> high").select("norm")
    titled = base.select("id", "provider", "norm", (F.size("words") > 0).cast("double").alias("similarity")).join(several, "norm", "left_semi")
    other = titled.select(F.col("id").alias("right_id"), F.col("provider").alias("p2"), "norm")
    pairs = titled.join(other, "norm").where("id < right_id and provider <> p2")
    return pairs.select(F.col("id").alias("left_id"), "right_id", F.lit(100).alias("score"), F.lit("exact_title").alias("method"), "similarity")


def _score() -> Column:
    s, n, r, close = F.col("similarity"), F.col("n"), F.col("r"), F.col("close")
    event = F.col("left_event") == F.col("right_event")
    extra = lambda x, most: F.least(F.lit(most), F.greatest(F.lit(0), F.bround(x).cast("int")))
    made = lambda score, method: F.struct(score.cast("int").alias("score"), F.lit(method).alias("method"))
    threshold = F.when(F.coalesce(close, F.lit(False)), 0.20).otherwise(0.40)
    multi = 88 + F.least(F.lit(4), n * 2) + F.when(r > 0, 2).otherwise(0) + extra((s - threshold) * 10, 4)
    return (
        F.when(event, made(F.when(F.col("left_event").startswith("personnel"), 91).otherwise(96), "event_fingerprint"))
        .when(~F.coalesce(close, F.lit(True)), made(F.lit(None), "too_far_apart"))
        .when((n >= 2) & (s >= threshold), made(F.least(F.lit(98), multi), "multi_entity_title"))
        .when((n >= 1) & (s >= 0.40), made(F.least(F.lit(94), 86 + extra((s - 0.40) * 15, 6)), "single_entity_title"))
        .when((n >= 1) & (r >= 1) & F.coalesce(close, F.lit(False)) & (s >= 0.12), made(F.least(F.lit(90), 84 + extra((s - 0.12) * 20, 4)), "entity_race_title"))
        .when((s >= 0.90) & (r >= 1), made(F.lit(90), "title_race"))
    )
