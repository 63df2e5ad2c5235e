"""Lookups, merges, nested results and audit rows as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlake.operators import canonical
from stintlake.operators.core import follow_redirects
from stintlake.operators.lookup import by_key_or_id, by_name_or_alias, exclusive_nearest, nested_top, valid_alias, where_given
from stintlake.operators.merging import coalescing_merge, conditional_update, run_log, without_derived

from .registry import query


@query("orders", sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND (NULL IS NULL OR o_orderpriority = NULL)")
def optional_predicate(orders):
    """PF03: a predicate of which only the given part is applied."""
    return where_given(orders, {"o_orderstatus": "O", "o_orderpriority": None}).select("o_orderkey", "o_custkey")


@query("orders", "customer", sql="""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 'O' THEN o_custkey::VARCHAR ELSE 'nobody' END AS k FROM orders)
SELECT o_orderkey, k, c_custkey, c_mktsegment FROM r LEFT JOIN customer ON c_name = k OR c_custkey::VARCHAR = k""")
def key_or_id(orders, customer):
    """PF04, DM23: targets asked for by slug or by id, those without one kept as not found."""
    s = F.col("o_orderstatus")
    asked = orders.select("o_orderkey", F.when(s == "F", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(s == "O", F.col("o_custkey").cast("string")).otherwise("nobody").alias("k"))
    return by_key_or_id(asked, customer, "k", "c_name", "c_custkey").select("o_orderkey", "k", "c_custkey", "c_mktsegment")


@query("events", sql="""
SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM (SELECT event_id, user_id, ts, CASE WHEN value < 10 THEN NULL ELSE round(value / 50) END AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n = 1 OR value IS DISTINCT FROM before""")
def value_changes(events):
    """PF07: samples whose value, null or not, differs from the one before."""
    rows = events.select("event_id", "user_id", "ts", F.when(F.col("value") >= 10, F.round(F.col("value") / 50)).alias("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumns({"before": F.lag("value").over(w), "n": F.row_number().over(w)})
    return rows.where((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("before"))).select("event_id", "user_id", "value")


@query("orders", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders""")
def ordinal_places(orders):
    """PF05, SL04: a ladder of kinds, then time with nulls last, then the id, as one total order a customer."""
    p = F.col("o_orderpriority")
    ladder = F.when(p == "3-MEDIUM", 0).when(p == "1-URGENT", 1).otherwise(2)
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(ladder, at.desc_nulls_last(), "o_orderkey")).alias("place"))


@query("orders", "lineitem", sql="""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem)
SELECT o_custkey, o_orderkey, l_partkey, l_extendedprice FROM o LEFT JOIN l ON l_orderkey = o_orderkey AND m = 1""")
def nested_latest(orders, lineitem):
    """JN08, DM20: the latest order of a customer, and its dearest line."""
    inner = lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    order = [F.col("l_extendedprice").desc_nulls_last(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return nested_top(orders, inner, "o_custkey", "o_orderkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], order).select("o_custkey", "o_orderkey", "l_partkey", "l_extendedprice")


@query("customer", "orders", "supplier", sql="""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9500) AS loaded FROM customer""")
def any_loaded(customer, orders, supplier):
    """JN10, DX15: whether any of several tables holds rows of a key; each is reduced to its keys first."""
    a = orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("a")).distinct()
    b = supplier.where("s_acctbal > 9500").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("b")).distinct()
    rows = customer.join(a, "c_custkey", "left").join(b, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce(F.col("a"), F.col("b"), F.lit(False)).alias("loaded"))


@query("orders", "customer", sql="""
SELECT CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'resolved' END AS state, o_orderpriority, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey GROUP BY 1, 2""")
def dictionary_states(orders, customer):
    """JN14: provider ids that a dictionary knows, and those it doesn't, as states instead of errors."""
    known = customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("resolved").alias("state"))
    return orders.join(known, "o_custkey", "left").groupBy(F.coalesce("state", F.lit("missing")).alias("state"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("orders", "customer", sql="""
WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1996 END AS valid_from, CASE WHEN c_acctbal < 5000 THEN 1998 END AS valid_to FROM customer)
SELECT o_orderkey, c_custkey FROM orders JOIN a ON c_custkey = o_custkey AND (valid_from IS NULL OR valid_from <= year(o_orderdate)) AND (valid_to IS NULL OR year(o_orderdate) <= valid_to)""")
def seasonal_aliases(orders, customer):
    """JN15, DX24: aliases that are valid in the season of what they name; open ends are null."""
    aliases = customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, 1996).alias("valid_from"), F.when(F.col("c_acctbal") < 5000, 1998).alias("valid_to"))
    rows = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season"))
    return valid_alias(rows, aliases, "c_custkey", "season").select("o_orderkey", "c_custkey")


@query("supplier", sql="""
SELECT s_suppkey, CASE WHEN s_acctbal >= 1000 THEN s_suppkey WHEN s_acctbal >= 0 THEN (SELECT min(s_suppkey) FROM supplier t WHERE t.s_nationkey = s.s_nationkey) END AS entity_id,
       CASE WHEN s_acctbal >= 1000 THEN 0 WHEN s_acctbal >= 0 THEN 1 END AS preference FROM supplier s""")
def names_and_aliases(supplier):
    """JN16, DM51: mentions matched without case, a name before an alias, the smallest id of equals."""
    names = supplier.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit(0).alias("preference"))
    names = names.unionByName(supplier.select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Team "), F.col("s_nationkey").cast("string")).alias("name"), F.lit(1).alias("preference")))
    said = F.when(F.col("s_acctbal") >= 1000, F.concat(F.lit(" "), F.upper("s_name"))).when(F.col("s_acctbal") >= 0, F.concat(F.lit("team "), F.col("s_nationkey").cast("string"), F.lit(" ")))
    return by_name_or_alias(supplier.select("s_suppkey", said.alias("said")), names, "said").select("s_suppkey", "entity_id", "preference")


@query("lineitem", "orders", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_returnflag = 'N' THEN l_suppkey END, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS driver FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def filled_drivers(lineitem, orders):
    """JN18, DX16: rows without a driver get the one of the session's entry."""
    rows = lineitem.select(F.col("l_orderkey").alias("session_id"), F.lit(1).alias("driver_number"), "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")).alias("driver_entity_id"))
    entries = orders.select(F.col("o_orderkey").alias("session_id"), F.lit(1).alias("driver_number"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("driver_entity_id"))
    known = rows.join(entries.select("session_id"), "session_id", "left_semi")
    return canonical.fill_drivers(known, entries).select(F.col("session_id").alias("l_orderkey"), "l_linenumber", "l_partkey", F.col("driver_entity_id").alias("driver"))


@query("orders", "customer", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS race_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def document_races(orders, customer):
    """DM54, DX29: documents matched to races by the normal form of an alias."""
    aliases = customer.select(F.col("c_custkey").alias("race_id"), F.col("c_name").alias("alias"))
    name = F.concat(F.lit("customer  "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_orderstatus") == "F", " x").otherwise("!"))
    documents = orders.join(customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", name.alias("event_name"))
    return canonical.match_documents(documents, aliases).select("o_orderkey", "race_id")


@query("orders", sql=None)
def exclusive_dates(orders):
    """JN13: orders of a customer on credit each take the nearest paid order within 36 hours, one each."""
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    return exclusive_nearest(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'F'"), "o_custkey", "at", 36)


@query("orders", "lineitem", sql="""
WITH p AS (SELECT l_orderkey, l_suppkey, l_linenumber, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT l_orderkey, l_suppkey, string_agg(l_linenumber || ':' || q, ' ' ORDER BY l_linenumber) AS points, min(CASE WHEN q > 5 THEN q END) AS best FROM p GROUP BY 1, 2)
SELECT l_orderkey, string_agg(l_suppkey || '=' || points, '; ' ORDER BY best NULLS LAST, l_suppkey) AS series FROM s GROUP BY 1""")
def nested_series(orders, lineitem):
    """AG18, DX14, DM04: points of a driver in order of the lap, drivers in order of their classification, those
    without one last; one nested row a session."""
    points = lineitem.groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    text = lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["q"].cast("string"))
    one = points.groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), text), " ").alias("points"), F.min(F.when(F.col("q") > 5, F.col("q"))).alias("best"))
    order = F.struct(F.col("best").isNull().alias("last"), "best", "l_suppkey", "points")
    label = lambda x: F.concat(x["l_suppkey"].cast("string"), F.lit("="), x["points"])
    return one.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), label), "; ").alias("series"))


@query("lineitem", sql="""
WITH m AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS p FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY p, l_quantity DESC, l_linenumber, l_partkey) AS n FROM m),
s AS (SELECT l_orderkey, l_suppkey, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS scopes FROM m GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, l_returnflag, l_quantity, scopes FROM b JOIN s USING (l_orderkey, l_suppkey) WHERE n = 1""")
def strongest_with_scopes(lineitem):
    """AG22, DX34: the strongest mention of an entity by kind and confidence, with all scopes it is named in, in one aggregation."""
    p = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    best = F.min(F.struct(p.alias("p"), (-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey", "l_returnflag")).alias("b")
    rows = lineitem.groupBy("l_orderkey", "l_suppkey").agg(best, F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("scopes"))
    return rows.select("l_orderkey", "l_suppkey", "b.l_returnflag", (-F.col("b.q")).alias("l_quantity"), "scopes")


@query("customer", "orders", sql="""
SELECT DISTINCT c.* FROM customer c JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def distinct_matches(customer, orders):
    """AG12: distinct rows that have a match: a semi join, so nothing is multiplied first."""
    return customer.distinct().join(orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("customer", "orders", sql="""
WITH u AS (SELECT o_custkey, CASE WHEN max(o_totalprice) > 300000 THEN max(o_orderpriority) END AS seg, max(o_totalprice) AS bal, map_from_entries([('n', count(*)::VARCHAR), ('s', min(o_orderstatus))]) AS m FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, greatest(c_acctbal, bal) AS c_acctbal, coalesce(m['s'], 'old') AS s, CASE WHEN c_custkey IS NULL THEN NULL ELSE 'kept' END AS k, m['n'] AS n
FROM customer FULL JOIN u ON o_custkey = c_custkey""")
def merged_profiles(customer, orders):
    """SNK06, AJ03: known values stay unless a new one is known, the greater confidence stays, objects merge with the right side winning."""
    text = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    target = customer.select("c_custkey", "c_mktsegment", "c_acctbal", text(s=F.lit("old"), k=F.lit("kept")).alias("m"))
    updates = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderpriority").alias("p"), F.count(F.lit(1)).cast("string").alias("n"), F.min("o_orderstatus").alias("s"))
    updates = updates.select("c_custkey", F.when(F.col("c_acctbal") > 300000, F.col("p")).alias("c_mktsegment"), "c_acctbal", text(n=F.col("n"), s=F.col("s")).alias("m"))
    rows = coalescing_merge(target, updates, ["c_custkey"], greatest=("c_acctbal",), objects=("m",))
    return rows.select("c_custkey", "c_mktsegment", "c_acctbal", *[F.col("m")[k].alias(k) for k in "skn"])


@query("orders", "lineitem", sql="""
WITH u AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN o_orderkey IS NULL OR (l_orderkey IS NOT NULL AND o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') THEN total ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey IS NULL OR (l_orderkey IS NOT NULL AND o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') THEN 'accepted' ELSE o_orderstatus END AS o_orderstatus FROM orders FULL JOIN u ON l_orderkey = o_orderkey""")
def conditional_upsert(orders, lineitem):
    """SNK07: updates reach candidates that no one has overridden; all other rows stay."""
    target = orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    updates = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("o_totalprice")).withColumns({"o_orderstatus": F.lit("accepted"), "o_orderpriority": F.lit(None).cast("string")})
    may = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "1-URGENT")
    return conditional_update(target, updates, ["o_orderkey"], may).drop("o_orderpriority")


@query("lineitem", "orders", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def derived_cleanup(lineitem, orders):
    """SNK10: rows derived from a story go when it is merged away."""
    parents = orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return without_derived(lineitem, parents, "l_orderkey", F.col("o_orderstatus") == "P").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("events", sql="""
WITH r AS (SELECT event_type, ts::DATE AS day, count(*) AS rows_read, count(*) FILTER (value < 30) AS rows_failed FROM events GROUP BY 1, 2)
SELECT *, CASE WHEN rows_failed = 0 THEN 'success' WHEN rows_failed < rows_read THEN 'partial' ELSE 'failed' END AS status, 'raw/' || event_type || '/' || strftime(day, '%Y/%m/%d') || '/part.json' AS object_key FROM r""")
def sync_runs(events):
    """SNK08, SNK09, TS07: one audit row a source and day, with where its raw data belong; a failed source leaves the others."""
    runs = run_log(events.withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], F.col("value") < 30)
    return runs.withColumn("object_key", F.concat(F.lit("raw/"), "event_type", F.lit("/"), F.date_format("day", "yyyy/MM/dd"), F.lit("/part.json")))


@query("orders", sql="""
SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) <= 72 * 3600""")
def close_pairs(orders):
    """TS06, DT05: pairs of a key within 72 hours. Days are bucketed by the window, so a row meets its own bucket and the next."""
    step = 72 * 3600
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("left_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("a")).withColumn("slot", F.floor(F.col("a") / step))
    near = rows.select("o_custkey", F.col("left_id").alias("right_id"), F.col("a").alias("b"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    return rows.join(near, ["o_custkey", "slot"]).where(f"left_id < right_id and abs(a - b) <= {step}").select("left_id", "right_id")


@query("orders", sql="""
SELECT o_orderkey, '{"o_custkey":' || o_custkey || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE ',"p":"' || o_orderpriority || '"' END || '}' AS payload, o_orderdate + (o_custkey * INTERVAL 1 SECOND) AS at FROM orders""")
def facet_payload(orders):
    """PF09, AJ02, DT06: what a facet shows beside its columns, as JSON without nulls; a time moved by seconds."""
    rest = F.to_json(F.struct("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p")))
    return orders.select("o_orderkey", rest.alias("payload"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_custkey"))).alias("at"))


@query("orders", "lineitem", sql="""
WITH e AS (SELECT l_orderkey, count(*) AS evidence, max(l_shipdate) AS latest FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, coalesce(evidence, 0) AS evidence, latest FROM orders LEFT JOIN e ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT o_orderkey, evidence, latest, count(*) OVER () AS total FROM r ORDER BY latest DESC NULLS LAST, o_orderkey LIMIT 50""")
def story_list(orders, lineitem):
    """DM33, DX01: the first page of stories that are not merged, newest evidence first, with the evidence count and the total. The
    page is the feature: fifty rows."""
    evidence = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("evidence"), F.max("l_shipdate").alias("latest"))
    rows = orders.where("o_orderstatus <> 'P'").select("o_orderkey").join(evidence, "o_orderkey", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.col("latest").desc_nulls_last(), "o_orderkey").limit(50).crossJoin(total)


@query("orders", "lineitem", sql="""
WITH RECURSIVE link AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_orderkey // 2 END AS into_ FROM orders), walk AS (SELECT k AS start, k AS pos FROM link UNION ALL SELECT start, into_ FROM walk JOIN link ON k = pos WHERE into_ IS NOT NULL AND into_ <> pos),
fin AS (SELECT start, min(pos) AS story FROM walk GROUP BY 1), e AS (SELECT story, count(*) AS n, max(l_shipdate) AS latest FROM fin JOIN lineitem ON l_orderkey = start GROUP BY 1)
SELECT start AS o_orderkey, story, coalesce(n, 0) AS evidence, latest FROM fin LEFT JOIN e USING (story)""")
def story_detail(orders, lineitem):
    """DM33, JN19: for every story asked for, the surviving story and the evidence of all that were merged into it."""
    link = orders.select(F.col("o_orderkey").alias("k"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") > 0), F.floor(F.col("o_orderkey") / 2).cast("long")).alias("into"))
    fin = follow_redirects(link, "k", "into").select(F.col("k").alias("o_orderkey"), F.coalesce("into", "k").alias("story"))
    evidence = lineitem.join(fin, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("story").agg(F.count(F.lit(1)).alias("evidence"), F.max("l_shipdate").alias("latest"))
    return fin.join(evidence, "story", "left").select("o_orderkey", "story", F.coalesce("evidence", F.lit(0)).alias("evidence"), "latest")


@query("orders", "lineitem", sql="""
WITH f AS (SELECT l_orderkey, arg_min(l_shipdate, (l_shipdate, l_linenumber)) AS first_at, max(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS anchor FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE coalesce(anchor, first_at, o_orderdate) END AS anchor_at, CASE WHEN o_orderstatus = 'P' THEN 'manual' WHEN anchor IS NOT NULL THEN 'anchor' WHEN first_at IS NOT NULL THEN 'source' ELSE 'created' END AS how
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def placement_refresh(orders, lineitem):
    """DM46, DX05: a placement set by hand stays; otherwise the anchor, the first source, or the time of creation."""
    found = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_at"), F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("anchor"))
    manual = F.col("o_orderstatus") == "P"
    how = F.when(manual, "manual").when(F.col("anchor").isNotNull(), "anchor").when(F.col("first_at").isNotNull(), "source").otherwise("created")
    at = F.when(manual, F.col("o_orderdate")).otherwise(F.coalesce("anchor", "first_at", "o_orderdate"))
    return orders.join(found, "o_orderkey", "left").select("o_orderkey", at.alias("anchor_at"), how.alias("how"))


@query("lineitem", "orders", sql="""
WITH own AS (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_shipdate) AS at FROM lineitem GROUP BY 1, 2, 3), any_ AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS at FROM lineitem GROUP BY 1, 2),
p AS (SELECT o_orderkey, o_custkey % 7 + 1 AS lap, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey % 100 END AS driver, o_orderdate FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN driver IS NULL THEN any_.at ELSE own.at END, o_orderdate) AS anchor_at FROM p LEFT JOIN own ON own.l_orderkey = o_orderkey AND own.l_linenumber = lap AND own.l_suppkey = driver LEFT JOIN any_ ON any_.l_orderkey = o_orderkey AND any_.l_linenumber = lap""")
def deep_anchors(lineitem, orders):
    """DM45, DX09: when the lap of a placement began, for the driver or, without one, for the first of all."""
    places = orders.select(F.col("o_orderkey").alias("story_id"), F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 100).alias("driver_entity_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("lap_number"), F.lit(None).cast("int").alias("stint_number"), F.col("o_orderdate").alias("fallback"))
    laps = lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("driver_entity_id"), F.col("l_linenumber").alias("lap_number"), F.col("l_shipdate").alias("started_at"))
    stints = laps.limit(0).select("session_id", "driver_entity_id", F.lit(1).alias("stint_number"), F.lit(1).alias("lap_start"), F.col("started_at").alias("fetched_at"))
    return canonical.deep_anchor(places, stints, laps).select(F.col("story_id").alias("o_orderkey"), "anchor_at")


@query("orders", sql="""
SELECT o_orderkey, o_orderstatus = 'F' AS has_code, least(100, greatest(1, 60 + (CASE WHEN o_orderpriority = '1-URGENT' THEN 55 WHEN o_orderpriority = '5-LOW' THEN -80 ELSE 5 END)))::INT AS confidence FROM orders""")
def code_tokens(orders):
    """ST06, ST25: a driver's code as a token of its own, in its case; a confidence kept within 1 to 100."""
    text = F.when(F.col("o_orderstatus") == "F", "P1: VER.").when(F.col("o_orderstatus") == "O", "OVER and ver").otherwise("VERY")
    p = F.col("o_orderpriority")
    score = F.lit(60) + F.when(p == "1-URGENT", 55).when(p == "5-LOW", -80).otherwise(5)
    return orders.select("o_orderkey", text.rlike("(?<![A-Za-z0-9])VER(?![A-Za-z0-9])").alias("has_code"), F.least(F.lit(100), F.greatest(F.lit(1), score)).alias("confidence"))


@query("part", sql="""
WITH a AS (SELECT p_partkey, p_name AS alias FROM part UNION SELECT p_partkey, split_part(p_name, ' ', 1) || p_size FROM part), n AS (SELECT split_part(p_name, ' ', 1) || p_size AS alias, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, alias FROM a LEFT JOIN n USING (alias) WHERE n IS NULL OR n = 1""")
def alias_bags(part):
    """ST23, DX19: the aliases of an entity; a first name only where no other has it."""
    first = F.concat(F.split("p_name", " ")[0], F.col("p_size").cast("string"))
    rows = part.select("p_partkey", "p_name", first.alias("first"))
    single = rows.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(single, "first")
    return rows.select("p_partkey", F.explode(F.array_compact(F.array("p_name", F.when(F.col("n") == 1, F.col("first"))))).alias("alias")).distinct()
