"""Provider identities to entities, in stages that each work on what the one before left over; slugs; seasons of validity.

A row ends in exactly one stage: its provider id is mapped already (in season, or the mapping is extended to it), one
entity has its name (and no other birth date), several have or the dates conflict (``ambiguous``, for a person to look at), or
an entity is created. Rows of one new name share the entity that the first of them creates, as they would if they came one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T

# fixed values: how sure each method is; a created or matched driver is surer than a team, as a birth date may speak against it
CONFIDENCE = {"exact_provider_id": 100, "provider_validity_extension": 100, "ambiguous": 0}
BY_KIND = {("driver", "exact_identity"): 99, ("driver", "auto_created"): 98, ("constructor", "exact_identity"): 98, ("constructor", "auto_created"): 95}
NO_NAME = "historical-entity"


def identity_key(name: Column) -> Column:
    """A name without accents, case, space and punctuation."""
    return F.regexp_replace(T.normal(name), " ", "")


def mapping_method(valid_from: Column, valid_to: Column, season: Column) -> Column:
    within = (valid_from.isNull() | (valid_from <= season)) & (valid_to.isNull() | (valid_to >= season))
    return F.when(within, "exact_provider_id").otherwise("provider_validity_extension")


def extended(ranges: DataFrame, seasons: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, valid_from, valid_to), one a key, stretched to the seasons (keys, season) that were met; an open end stays
    open. Keys without a range begin with the seasons alone."""
    met = seasons.groupBy(*keys).agg(F.min("season").alias("_low"), F.max("season").alias("_high"))
    both = ranges.withColumn("_known", F.lit(True)).join(met, keys, "full")
    end = lambda c, seen, pick: F.when(F.col("_known").isNull(), F.col(seen)).when(F.col(c).isNull(), None).otherwise(pick(c, F.coalesce(seen, c))).alias(c)
    return both.select(*keys, end("valid_from", "_low", F.least), end("valid_to", "_high", F.greatest))


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, valid_from, valid_to) as the fewest that cover the same seasons: those that overlap or adjoin become
    one. A null end is open. Ranges that end before they begin are left out."""
    least, most = F.lit(-(1 << 31)), F.lit((1 << 31) - 1)
    rows = ranges.select(*keys, F.coalesce(F.col("valid_from").cast("long"), least).alias("a"), F.coalesce(F.col("valid_to").cast("long"), most).alias("b")).where("a <= b")
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (reach.isNull() | (F.col("a") > reach + 1)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    closed = lambda c, open_end, name: F.when(F.col(c) != open_end, F.col(c)).cast("int").alias(name)
    return out.select(*keys, closed("a", least, "valid_from"), closed("b", most, "valid_to"))


def allocate_slugs(new: DataFrame, taken: DataFrame, id_col: str, base_col: str, scope: list[str]) -> DataFrame:
    """(scope, id, slug) of new rows (scope, id, base): the base where it is free, else ``base-2``, ``base-3`` and so on,
    the free numbers in order of id. ``taken`` holds (scope, slug). A base that ends like another's numbered slug never meets it, since
    all slugs that are given out are checked against it: such a base counts as taken by the other.

    The r-th row of a base gets the r-th free number. With the taken numbers t1 < t2 < .. that is r plus how many of them have
    fewer than r free numbers before them, a running count over the two merged; no row waits for another."""
    numbered = r"^(.*)-([2-9]|[1-9][0-9]{1,8})$"
    base = F.col(base_col)
    rows = new.select(*scope, F.col(id_col).alias("id"), base.alias("base"))
    # each slug that is there or is a new row's base holds number 1 of itself, and a number of the base before its suffix
    names = taken.select(*scope, F.col("slug").alias("name"), F.lit(True).alias("old")).unionByName(rows.select(*scope, F.col("base").alias("name"), F.lit(False).alias("old"))).distinct()
    whole = names.where("old").select(*scope, F.col("name").alias("base"), F.lit(1).cast("long").alias("t"))
    suffixed = names.where(F.col("name").rlike(numbered)).select(*scope, F.regexp_extract("name", numbered, 1).alias("base"), F.regexp_extract("name", numbered, 2).cast("long").alias("t"))
    held = whole.unionByName(suffixed).distinct().join(rows.select(*scope, "base").distinct(), [*scope, "base"], "left_semi")
    key = [*scope, "base"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("t"))
    held = held.select(*key, (F.col("t") - place).alias("free_before"), F.lit(0).alias("side"), F.lit(1).alias("one"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).select(*key, "id", F.col("r").cast("long").alias("r"))
    both = ranked.select(*key, "id", "r", F.col("r").alias("at"), F.lit(0).alias("one"), F.lit(0).alias("side")).unionByName(held.select(*key, F.lit(None).alias("id"), F.lit(None).alias("r"), F.col("free_before").alias("at"), "one", F.lit(1).alias("side")))
    # taken numbers with fewer than r free ones before them come first; those with r or more come after
    before = F.sum("one").over(Window.partitionBy(*key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    number = both.withColumn("k", F.col("r") + before).where("side = 0")
    return number.select(*scope, "id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))


def reconcile(identities: DataFrame, mappings: DataFrame, candidates: DataFrame) -> DataFrame:
    """identities (kind, provider_id, name, birth_date, season), one a (kind, provider_id, season), by mappings (kind, provider_id,
    entity_id, valid_from, valid_to) and candidates (kind, entity_id, slug, display_name, birth_date) to rows (kind, provider_id, season,
    entity_id, method, confidence, review_required, reason, slug). ``kind`` is driver or constructor; ids are strings.

    A created entity's id is its kind and slug. Its rows of later seasons, and others of its name, follow the first
    in order of (season, provider_id). A name without letters or digits never matches and is created under a name of its own."""
    key = identity_key(F.col("name"))
    rows = identities.select("kind", "provider_id", "name", "birth_date", "season", key.alias("key"))
    mapped = rows.join(mappings.select("kind", "provider_id", F.col("entity_id").alias("mapped"), "valid_from", "valid_to"), ["kind", "provider_id"], "left")
    hit = mapped.where("mapped is not null").select("kind", "provider_id", "season", F.col("mapped").alias("entity_id"), mapping_method(F.col("valid_from"), F.col("valid_to"), F.col("season")).alias("method"))

    # of an unmapped provider id the first season decides, and maps it for the seasons after
    left = mapped.where("mapped is null").drop("mapped", "valid_from", "valid_to")
    order = F.row_number().over(Window.partitionBy("kind", "provider_id").orderBy("season"))
    left = left.withColumn("nth", order)
    first = left.where("nth = 1")
    known = candidates.select("kind", identity_key(F.col("display_name")).alias("key"), "entity_id", "slug", F.col("birth_date").alias("born")).where("key <> ''")
    known = known.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("found"), F.min_by(F.struct("entity_id", "born"), "entity_id").alias("one"), F.array_join(F.array_sort(F.collect_list("slug")), ", ").alias("slugs"))
    seen = first.join(known, ["kind", "key"], "left")
    conflict = lambda born: F.coalesce((F.col("kind") == "driver") & (F.col("birth_date") != born), F.lit(False))
    # new names: the first row creates, the others meet what it created
    founder = Window.partitionBy("kind", F.when(F.col("key") == "", F.concat(F.lit("?"), "provider_id")).otherwise(F.col("key"))).orderBy("season", "provider_id")
    fresh = seen.where("found is null").withColumns({"leader": F.first("provider_id").over(founder), "born": F.first(F.struct("birth_date")).over(founder)["birth_date"]})
    taken = candidates.select("kind", "slug")
    created = fresh.where("leader = provider_id")
    preferred = F.coalesce(F.nullif(T.slug(F.col("name")), F.lit("")), F.lit(NO_NAME))
    bases = created.select("kind", F.col("provider_id").alias("id"), preferred.alias("base"), T.slug(F.col("provider_id")).alias("own"))
    bases = bases.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "base").orderBy("id"))).join(taken.select("kind", F.col("slug").alias("base"), F.lit(True).alias("used")).distinct(), ["kind", "base"], "left")
    bases = bases.select("kind", "id", F.when(F.col("used").isNull() & (F.col("rank") == 1), F.col("base")).otherwise(F.concat_ws("-", "base", "own")).alias("base"))
    slugs = allocate_slugs(bases, taken, "id", "base", ["kind"]).withColumnRenamed("id", "leader")
    made = fresh.join(slugs, ["kind", "leader"]).withColumn("entity_id", F.concat_ws(":", "kind", "slug"))
    method = F.when(F.col("leader") == F.col("provider_id"), "auto_created").when(conflict(F.col("born")), "ambiguous").otherwise("exact_identity")
    made = made.withColumn("method", method).select("kind", "provider_id", "method", F.when(F.col("method") != "ambiguous", F.col("entity_id")).alias("entity_id"), F.when(F.col("method") == "ambiguous", F.concat(F.lit("birth date conflict with "), "slug")).alias("reason"), F.when(F.col("method") == "auto_created", F.col("slug")).alias("slug"))
    several, other = F.col("found") > 1, conflict(F.col("one.born"))
    matched = seen.where("found is not null").withColumn("method", F.when(several | other, "ambiguous").otherwise("exact_identity"))
    reason = F.when(several, F.concat(F.lit("several entities: "), "slugs")).when(other, F.concat(F.lit("birth date conflict with "), "slugs"))
    matched = matched.select("kind", "provider_id", "method", F.when(F.col("method") != "ambiguous", F.col("one.entity_id")).alias("entity_id"), reason.alias("reason"), F.lit(None).cast("string").alias("slug"))
    decided = left.select("kind", "provider_id", "season", "nth").join(matched.unionByName(made), ["kind", "provider_id"])
    later = F.when((F.col("nth") > 1) & (F.col("method") != "ambiguous"), "provider_validity_extension").otherwise(F.col("method"))
    decided = decided.select("kind", "provider_id", "season", "entity_id", later.alias("method"), "reason", F.when(F.col("nth") == 1, F.col("slug")).alias("slug"))

    out = hit.withColumns({"reason": F.lit(None).cast("string"), "slug": F.lit(None).cast("string")}).unionByName(decided)
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair], *[F.lit(x) for (kind, name), v in BY_KIND.items() for x in (f"{kind}:{name}", v)])
    confidence = F.coalesce(F.try_element_at(sure, F.col("method")), F.try_element_at(sure, F.concat_ws(":", "kind", "method")))
    return out.select("kind", "provider_id", "season", "entity_id", "method", confidence.alias("confidence"), (F.col("method") == "ambiguous").alias("review_required"), "reason", "slug")


def roster_links(standings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(season, driver_entity_id, team_entity_id), distinct, of standings (season, driver_id, constructor_ids) whose two ends are resolved."""
    pairs = standings.select("season", "driver_id", F.explode("constructor_ids").alias("constructor_id")).distinct()
    side = lambda kind, key, name: resolved.where((F.col("kind") == kind) & F.col("entity_id").isNotNull()).select("season", F.col("provider_id").alias(key), F.col("entity_id").alias(name))
    return pairs.join(side("driver", "driver_id", "driver_entity_id"), ["season", "driver_id"]).join(side("constructor", "constructor_id", "team_entity_id"), ["season", "constructor_id"]).select("season", "driver_entity_id", "team_entity_id").distinct()
