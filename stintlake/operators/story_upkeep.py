"""Stories kept up to date under added and withdrawn items and pairs, by recomputing only what a change touches.

The state is which item is in which story, and the pairs that join. A change touches the stories of its items and of
its pairs' ends; their items, with the new ones, are all that the components are computed for, since a pair that joins never leaves
a story. A story may grow, meet another, fall apart or end.

Story ids are stable: where members of a story end in several components, the one with most of them (then with the smallest
item) inherits its id; of the ids that a component inherits the smallest goes on and the others redirect to it. A component
that inherits none gets the id of its smallest item and the number of the change, which no story had before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import components
from .shared import durable

MEMBERS, PAIRS, REDIRECTS = "id long, story_id string", "left_id long, right_id long", "story_id string, into string"
#: what can have happened to a story or an item
ACTIONS = ("created", "attached", "detached", "merged", "split", "ended")


@dataclass(frozen=True)
class Stories:
    """``members`` (id, story_id), ``pairs`` (left_id < right_id), ``redirects`` (story_id, into) and the number of changes so far."""

    members: DataFrame
    pairs: DataFrame
    redirects: DataFrame
    changes: int = 0

    @classmethod
    def none(cls, spark) -> Stories:
        return cls(*(spark.createDataFrame([], s) for s in (MEMBERS, PAIRS, REDIRECTS)))


@dataclass(frozen=True)
class Change:
    """Items (id) that come and go, pairs (left_id, right_id) that are accepted and rejected. Withdrawn wins over added."""

    items: DataFrame | None = None
    gone: DataFrame | None = None
    accepted: DataFrame | None = None
    rejected: DataFrame | None = None


def _ids(df: DataFrame | None, like: DataFrame) -> DataFrame:
    return like.select("id").limit(0) if df is None else df.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()


def _pairs(df: DataFrame | None, like: DataFrame) -> DataFrame:
    if df is None:
        return like.limit(0)
    a, b = F.col("left_id").cast("long"), F.col("right_id").cast("long")
    return df.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).where("left_id < right_id").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("left_id", "right_id")).alias("id"))


def apply_change(state: Stories, change: Change) -> tuple[Stories, DataFrame]:
    """The state after a change, and its audit (action, n), zeros included: stories created, merged into others, fallen apart
    and ended, items attached to a story that was there and items that left one. Pairs whose ends aren't items join nothing, until they are."""
    number = state.changes + 1
    coming, going = durable(_ids(change.items, state.members)), durable(_ids(change.gone, state.members))
    accepted, rejected = _pairs(change.accepted, state.pairs), durable(_pairs(change.rejected, state.pairs))
    pairs = durable(state.pairs.unionByName(accepted).distinct().join(rejected, ["left_id", "right_id"], "left_anti"))
    # what is touched: the stories of all that comes, goes, is joined or parted, and of what waits to be joined with what comes
    waiting = pairs.join(_ends_of(pairs, coming), ["left_id", "right_id"], "left_semi")
    seeds = coming.unionByName(going).unionByName(_ends(accepted)).unionByName(_ends(rejected)).unionByName(_ends(waiting)).distinct()
    stories = durable(state.members.join(seeds, "id", "left_semi").select("story_id").distinct())
    before = durable(state.members.join(stories, "story_id", "left_semi").select("id", "story_id"))
    items = durable(before.select("id").unionByName(coming).distinct().join(going, "id", "left_anti"))
    inside = pairs.join(items.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(items.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
    roots = durable(components(items, inside))

    met = before.join(roots, "id").groupBy("story_id", "root").agg(F.count(F.lit(1)).alias("n"))
    heirs = met.groupBy("story_id").agg(F.max_by("root", F.struct("n", (-F.col("root")).alias("r"))).alias("root"), F.count(F.lit(1)).alias("parts"))
    heirs = durable(heirs)
    own = heirs.groupBy("root").agg(F.min("story_id").alias("story_id"))
    named = roots.select("root").distinct().join(own, "root", "left")
    named = durable(named.select("root", F.coalesce("story_id", F.concat_ws("-", F.col("root").cast("string"), F.lit(number).cast("string"))).alias("story_id"), F.col("story_id").isNull().alias("fresh")))
    after = durable(roots.join(named, "root").select("id", "story_id"))

    moved = heirs.join(named.select("root", F.col("story_id").alias("into")), "root").where("story_id <> into").select("story_id", "into")
    moved = durable(moved)
    # redirects lead straight to the story that goes on; those to a story that ended end with it
    old = state.redirects.join(moved.select(F.col("story_id").alias("into"), F.col("into").alias("then")), "into", "left").select("story_id", F.coalesce("then", "into").alias("into"))
    ended = stories.join(heirs, "story_id", "left_anti")
    redirects = old.join(ended.withColumnRenamed("story_id", "into"), "into", "left_anti").select("story_id", "into").unionByName(moved)
    members = state.members.join(stories, "story_id", "left_anti").select("id", "story_id").unionByName(after)

    joined = after.join(before.withColumnRenamed("story_id", "was"), "id", "left")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("action"), "n")
    audit = count(named.where("fresh"), "created")
    stays = named.where("not fresh").select("story_id")
    audit = audit.unionByName(count(joined.where("was is null").join(stays, "story_id", "left_semi"), "attached"))
    audit = audit.unionByName(count(before.join(going, "id", "left_semi"), "detached")).unionByName(count(moved, "merged"))
    audit = audit.unionByName(count(heirs.where("parts > 1"), "split")).unionByName(count(ended, "ended"))
    return Stories(durable(members), pairs, durable(redirects), number), audit


def _ends_of(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs that have one of the items at an end."""
    left = pairs.join(items.withColumnRenamed("id", "left_id"), "left_id", "left_semi").select("left_id", "right_id")
    right = pairs.join(items.withColumnRenamed("id", "right_id"), "right_id", "left_semi").select("left_id", "right_id")
    return left.unionByName(right).distinct()


def story_counts(members: DataFrame) -> DataFrame:
    """One row: stories, of several items, of one item."""
    sizes = members.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("n") == 1).alias("single"))
