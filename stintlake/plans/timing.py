"""Timing views: laps, sectors, as-of positions, timing tower, standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlake.operators.core import asof_join, last_in_interval, safe_ratio, top1_per_key, union_all, with_interval_end, with_scalar
from stintlake.operators.downsample import greedy_downsample

from .registry import query

LAPS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lap FROM events"


def laps_of(events: DataFrame) -> DataFrame:
    return events.withColumn("lap", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query("events", sql=f"""
WITH l AS ({LAPS}), c AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS clean FROM l),
     b AS (SELECT *, min(clean) OVER () AS best, min(clean) OVER (PARTITION BY user_id) AS own FROM c)
SELECT event_id, user_id, lap, value, CASE WHEN clean IS NULL THEN 'none' WHEN clean = best THEN 'purple' WHEN clean = own THEN 'green' ELSE 'yellow' END AS colour FROM b""")
def lap_colouring(events):
    """AG16, WN04, DM05: session and personal bests among clean laps."""
    laps = laps_of(events).withColumn("clean", F.when(F.col("event_type") != "error", F.col("value")))
    best = events.where("event_type <> 'error'").agg(F.min("value").alias("best"))
    laps = with_scalar(laps.withColumn("own", F.min("clean").over(Window.partitionBy("user_id"))), best)
    colour = F.when(F.col("clean").isNull(), "none").when(F.col("clean") == F.col("best"), "purple").when(F.col("clean") == F.col("own"), "green").otherwise("yellow")
    return laps.select("event_id", "user_id", "lap", "value", colour.alias("colour"))


@query("lineitem", sql="""
WITH u AS (SELECT l_suppkey, 1 AS sector, l_quantity AS v FROM lineitem UNION ALL SELECT l_suppkey, 2, l_extendedprice FROM lineitem UNION ALL SELECT l_suppkey, 3, l_tax FROM lineitem),
     b AS (SELECT *, min(v) OVER (PARTITION BY sector) AS best, min(v) OVER (PARTITION BY sector, l_suppkey) AS own FROM u)
SELECT l_suppkey, sector, count(*) FILTER (WHERE v = best) AS purple, count(*) FILTER (WHERE v = own AND v <> best) AS green, count(*) FILTER (WHERE v <> own) AS yellow FROM b GROUP BY 1, 2""")
def sector_colouring(lineitem):
    """AG17, DM07: three measures, each with its own bests. Counted per value first, so the bests
    need no second pass over the rows."""
    long = lineitem.select("l_suppkey", F.explode(F.array(*[F.struct(F.lit(k).alias("sector"), F.col(c).alias("v")) for k, c in ((1, "l_quantity"), (2, "l_extendedprice"), (3, "l_tax"))])).alias("x")).select("l_suppkey", "x.*")
    counts = long.groupBy("l_suppkey", "sector", "v").agg(F.count(F.lit(1)).alias("n"))
    best = long.groupBy("sector").agg(F.min("v").alias("best"))  # three rows
    rows = counts.withColumn("own", F.min("v").over(Window.partitionBy("l_suppkey", "sector"))).join(F.broadcast(best), "sector")
    v, own, top = F.col("v"), F.col("own"), F.col("best")
    total = lambda rule, name: F.sum(F.when(rule, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("l_suppkey", "sector").agg(total(v == top, "purple"), total((v == own) & (v != top), "green"), total(v != own, "yellow"))


@query("events", sql="""
SELECT user_id, count(*) AS laps, min(value) AS best, round(median(value), 6) AS median, round(avg(value), 6) AS mean, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def clean_lap_metrics(events):
    """AG05, DM03: exact median and the sorted distinct kinds."""
    return events.where("event_type <> 'error'").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("laps"), F.min("value").alias("best"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    )


STARTS = """WITH r AS (SELECT o_custkey AS driver, year(o_orderdate) AS season, month(o_orderdate) AS round, o_orderkey, o_orderstatus, o_totalprice,
  row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
p AS (SELECT *, CASE pos WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS points FROM r)"""
POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)


def starts_of(orders: DataFrame) -> DataFrame:
    """Orders as race entries: the month is the round, the rank by price the finish."""
    rank = F.row_number().over(Window.partitionBy("season", "round").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey"))
    rows = orders.select(F.col("o_custkey").alias("driver"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round"), "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("pos", rank)
    return rows.withColumn("points", F.coalesce(F.get(F.array(*map(F.lit, POINTS)), F.col("pos") - 1), F.lit(0)))


@query("orders", sql=STARTS + """
SELECT driver, count(*) AS entries, count(*) FILTER (WHERE pos = 1) AS wins, count(*) FILTER (WHERE pos <= 3) AS podiums, sum(points)::BIGINT AS points,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS classified, count(*) FILTER (WHERE o_orderstatus = 'O') AS dnf, count(*) FILTER (WHERE o_orderstatus = 'P') AS dns,
  count(DISTINCT season) AS seasons, round(avg(pos), 6) AS avg_finish, round(count(*) FILTER (WHERE pos <= 3) * 1.0 / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0), 6) AS podium_rate
FROM p GROUP BY driver""")
def driver_career_stats(orders):
    """AG01, AG03, AG04, DM01: one pass of conditional counts per driver."""
    rows = starts_of(orders)
    is_ = lambda s: F.col("o_orderstatus") == s
    return rows.groupBy("driver").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("pos") == 1).alias("wins"), F.count_if(F.col("pos") <= 3).alias("podiums"), F.sum("points").cast("long").alias("points"),
        F.count_if(is_("F")).alias("classified"), F.count_if(is_("O")).alias("dnf"), F.count_if(is_("P")).alias("dns"), F.countDistinct("season").alias("seasons"),
        F.round(F.avg("pos"), 6).alias("avg_finish"), F.round(safe_ratio(F.count_if(F.col("pos") <= 3), F.count_if(~is_("P"))), 6).alias("podium_rate"),
    )


@query("orders", sql=STARTS + """,
s AS (SELECT driver, season, sum(points) AS at_cut, max(round) AS cut FROM p WHERE round <= 6 GROUP BY 1, 2)
SELECT p.driver, p.season, (coalesce(max(s.at_cut), 0) + sum(CASE WHEN p.round > coalesce(s.cut, -1) THEN p.points ELSE 0 END))::BIGINT AS points FROM p LEFT JOIN s ON p.driver = s.driver AND p.season = s.season GROUP BY 1, 2""")
def season_points_override(orders):
    """AG02, DM02: a standings snapshot counts, with the rounds after it."""
    rows = starts_of(orders)
    snap = rows.where("round <= 6").groupBy("driver", "season").agg(F.sum("points").alias("at_cut"), F.max("round").alias("cut"))
    later = F.when(F.col("round") > F.coalesce("cut", F.lit(-1)), F.col("points")).otherwise(0)
    return rows.join(snap, ["driver", "season"], "left").groupBy("driver", "season").agg((F.coalesce(F.max("at_cut"), F.lit(0)) + F.sum(later)).cast("long").alias("points"))


@query("events", sql="""
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true""")
def asof_latest(events):
    """JN05: the latest click at or before each purchase."""
    return _asof(events, None)


@query("events", sql="""
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true""")
def asof_tolerance(events):
    """JN05 with a staleness bound."""
    return _asof(events, 3600)


def _asof(events, tolerance):
    cols = ["event_id", "user_id", "ts"]
    left, right = events.where("event_type = 'purchase'").select(cols), events.where("event_type = 'click'").select(cols)
    return asof_join(left, right, ["user_id"], "ts", "event_id", tolerance).withColumnsRenamed({"r_event_id": "click_id", "r_ts": "click_ts"})


@query("events", sql="""
WITH l AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'purchase')
SELECT l.event_id, l.user_id, p.event_id AS point_id FROM l JOIN LATERAL (SELECT event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = l.user_id AND e.ts >= l.ts AND (l.until IS NULL OR e.ts < l.until) ORDER BY ts DESC, event_id DESC LIMIT 1) p ON true""")
def interval_asof(events):
    """JN06, WN01: the last view within [purchase, next purchase)."""
    laps = with_interval_end(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").withColumn("start", F.col("ts"))
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    inside = last_in_interval(laps, views, ["user_id"], "start", "until", "ts", "event_id")
    last = inside.groupBy("user_id", "r_event_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("point_id"))
    return last.select(F.col("r_event_id").alias("event_id"), "user_id", "point_id")


@query("orders", sql=STARTS + """,
g AS (SELECT season, driver, min(pos) AS pos FROM p WHERE round = 1 GROUP BY 1, 2)
SELECT season, driver, 0 AS lap, pos FROM g UNION ALL SELECT season, driver, round AS lap, min(pos) AS pos FROM p GROUP BY 1, 2, 3""")
def position_trace(orders):
    """DM04, SO04: the grid as lap 0, then positions by lap."""
    rows = starts_of(orders)
    grid = rows.where("round = 1").groupBy("season", "driver").agg(F.min("pos").alias("pos")).select("season", "driver", F.lit(0).alias("lap"), "pos")
    return grid.unionByName(rows.groupBy("season", "driver", F.col("round").alias("lap")).agg(F.min("pos").alias("pos")))


@query("events", sql="""
WITH x AS (SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS last_ts, max(ts) FILTER (WHERE event_type = 'click') AS click_ts, max(ts) FILTER (WHERE event_type = 'purchase') AS purchase_ts, count(*) AS laps FROM events GROUP BY user_id),
b AS (SELECT max(last_value) AS lead FROM x)
SELECT user_id, laps, last_value, last_ts, click_ts, purchase_ts, CASE WHEN last_value = lead THEN 'LEADER' ELSE printf('+%.3f', lead - last_value) END AS gap FROM x, b""")
def timing_tower(events):
    """DM15: the latest of each kind per driver in one aggregation, and the gap to the leader."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    x = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("laps"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.max("ts").alias("last_ts"), at("click").alias("click_ts"), at("purchase").alias("purchase_ts"))
    gap = F.when(F.col("last_value") == F.col("lead"), "LEADER").otherwise(F.format_string("+%.3f", F.col("lead") - F.col("last_value")))
    return with_scalar(x, x.agg(F.max("last_value").alias("lead"))).withColumn("gap", gap).drop("lead")


@query("events", sql="""
WITH t AS (SELECT max(ts) - INTERVAL 1 DAY AS at FROM events), x AS (SELECT e.* FROM events e, t WHERE e.ts <= t.at),
f AS (SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM x GROUP BY user_id), b AS (SELECT min(value) AS low, max(value) AS high FROM x)
SELECT f.*, b.low, b.high FROM f, b""")
def track_frame(events):
    """DM16, AG15: where everyone is at an instant, with the bounding box."""
    at = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("at"))
    x = with_scalar(events, at).where("ts <= at")
    last = F.struct("ts", "event_id")
    frame = x.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", last).alias("event_id"), F.max_by("value", last).alias("value"))
    return with_scalar(frame, x.agg(F.min("value").alias("low"), F.max("value").alias("high")))


@query("events", sql="""
WITH f AS (SELECT ts AS t0, user_id AS u FROM events ORDER BY value, event_id LIMIT 1)
SELECT event_id, ts, value FROM events, f WHERE user_id = u AND ts >= t0 AND ts < t0 + INTERVAL 6 HOUR""")
def fastest_window_path(events):
    """JN12: the samples of a time range after the fastest lap."""
    first = events.orderBy("value", "event_id").limit(1).select(F.col("ts").alias("t0"), F.col("user_id").alias("u"))
    return with_scalar(events, first).where("user_id = u and ts >= t0 and ts < t0 + INTERVAL 6 HOUR").select("event_id", "ts", "value")


@query("orders", sql="""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders WHERE o_orderpriority LIKE '1%')
SELECT o.o_orderkey, arg_max(s.o_orderkey, s.o_orderkey) AS stint FROM orders o JOIN s ON o.o_custkey = s.o_custkey AND o.o_orderdate >= s.o_orderdate AND (s.until IS NULL OR o.o_orderdate < s.until) GROUP BY 1""")
def range_lookup(orders):
    """JN07: the stint that covers an order; the last is open. A stint ends where the next begins, so
    the one that covers a time is the latest begun: one sort a customer, no range join."""
    stints = orders.where("o_orderpriority like '1%'").select("o_custkey", F.col("o_orderkey").alias("stint"), "o_orderdate")
    hit = asof_join(orders.select("o_custkey", "o_orderkey", "o_orderdate"), stints, ["o_custkey"], "o_orderdate", "stint")
    return hit.where("r_stint is not null").select("o_orderkey", F.col("r_stint").alias("stint"))


@query("supplier", "lineitem", sql="""
WITH m AS (SELECT l_orderkey, l_suppkey, min(l_extendedprice) AS q1, min(CASE WHEN l_quantity > 5 THEN l_extendedprice END) AS q2, min(CASE WHEN l_quantity > 25 THEN l_extendedprice END) AS q3 FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_orderkey, l_suppkey, 'q1' AS segment, q1 AS time FROM m UNION ALL SELECT l_orderkey, l_suppkey, 'q2', q2 FROM m UNION ALL SELECT l_orderkey, l_suppkey, 'q3', q3 FROM m)
SELECT l_orderkey, s_name, segment, time, CASE WHEN time IS NOT NULL THEN dense_rank() OVER (PARTITION BY l_orderkey, segment ORDER BY time ASC NULLS LAST) END AS pos FROM u JOIN supplier ON s_suppkey = l_suppkey""")
def segment_ranking(supplier, lineitem):
    """AJ09, WN03, DM22: three segments of a session as rows, ranked where there is a time. Sessions are
    orders, so a window holds the few cars of one."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    m = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min(price).alias("q1"), F.min(F.when(qty > 5, price)).alias("q2"), F.min(F.when(qty > 25, price)).alias("q3"))
    u = m.unpivot(["l_orderkey", "l_suppkey"], ["q1", "q2", "q3"], "segment", "time")
    rank = F.dense_rank().over(Window.partitionBy("l_orderkey", "segment").orderBy(F.col("time").asc_nulls_last()))
    named = u.withColumn("pos", F.when(F.col("time").isNotNull(), rank)).join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return named.select("l_orderkey", "s_name", "segment", "time", "pos")


@query("orders", "customer", sql="""
WITH r AS (SELECT c_nationkey AS team, year(o_orderdate) AS season, month(o_orderdate) AS round, sum(o_totalprice) AS pts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pts) OVER (PARTITION BY team, season ORDER BY round) AS total FROM r)
SELECT season, round, team, round(total, 2) AS total, row_number() OVER (PARTITION BY season, round ORDER BY total DESC, team) AS pos FROM c""")
def standings_by_round(orders, customer):
    """DM20, AG11: running totals and the position after each round."""
    r = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy(F.col("c_nationkey").alias("team"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")).agg(F.sum("o_totalprice").alias("pts"))
    c = r.withColumn("total", F.sum("pts").over(Window.partitionBy("team", "season").orderBy("round")))
    return c.select("season", "round", "team", F.round("total", 2).alias("total"), F.row_number().over(Window.partitionBy("season", "round").orderBy(F.col("total").desc(), "team")).alias("pos"))


@query("orders", "lineitem", sql="""
WITH l AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
SELECT o_custkey, year(o_orderdate) AS season, count(*) AS results, coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(qty), 0)::DOUBLE AS qty FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def season_results(orders, lineitem):
    """DM21, JN02: every key's seasons, from rows with pre-aggregated facts."""
    rows = results_of(orders, lineitem).groupBy("o_custkey", F.year("o_orderdate").alias("season"))
    return rows.agg(F.count(F.lit(1)).alias("results"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))


@query("orders", "lineitem", sql="""
WITH l AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, items, qty FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def season_results_all(orders, lineitem):
    """DM21, JN02: the same for every key of the table."""
    return results_of(orders, lineitem)


def results_of(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    l = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("qty"))  # noqa: E741
    return orders.join(l, "o_orderkey", "left").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "items", "qty")


@query("events", sql="""
WITH RECURSIVE s AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, n, ts, event_id, ts AS last, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.user_id, s.n, s.ts, s.event_id, CASE WHEN s.ts >= k.last + INTERVAL 12 HOUR THEN s.ts ELSE k.last END, s.ts >= k.last + INTERVAL 12 HOUR FROM k JOIN s ON s.user_id = k.user_id AND s.n = k.n + 1)
SELECT user_id, ts, event_id FROM k WHERE kept""")
def greedy_min_gap(events):
    """TS04: keep a sample when the last kept one lies at least 12 hours back."""
    return greedy_downsample(events, ["user_id"], "ts", "event_id", 12 * 3600)


@query("customer", "orders", sql="""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def latest_per_key(customer, orders):
    """JN04, AG11: the newest row per key."""
    last = top1_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()])
    return customer.join(last, customer["c_custkey"] == last["o_custkey"], "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("orders", "lineitem", "events", sql="""
WITH u AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'ship', l_orderkey * 10 + l_linenumber, max(l_shipdate) FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT event_type, event_id, ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY u."at" DESC NULLS LAST, id) AS n FROM u)
SELECT kind, id, r."at" FROM r WHERE n <= 12 ORDER BY r."at" DESC, kind, id LIMIT 30""")
def per_type_topk_timeline(orders, lineitem, events):
    """WN02, SL02, SO01, DM27: twelve of each kind, thirty in all (the limits are the feature)."""
    ships = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at")).select(F.lit("ship").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "at")
    u = union_all(orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), ships, events.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")))
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("at").desc_nulls_last(), "id"))
    return u.withColumn("n", n).where("n <= 12").orderBy(F.col("at").desc(), "kind", "id").limit(30).select("kind", "id", "at")


@query("orders", "events", sql="""
SELECT o_custkey AS who, 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT user_id, event_type, event_id, ts FROM events WHERE event_type IN ('error', 'signup')""")
def unified_timeline(orders, events):
    """DM31, SO02: heterogeneous facts as one event schema."""
    return orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("who"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")).unionByName(events.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("who"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")))
