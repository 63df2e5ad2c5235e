"""Queries of what keeps state: sections of a page, chunked scans, gates and ledgers of streams, stories under change, reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stintlake.functions import taxonomy
from stintlake.functions import text as T
from stintlake.operators import reconcile as R
from stintlake.operators.range_scan import chunked_downsample
from stintlake.operators.shared import shared_folder
from stintlake.operators.story_upkeep import Change, Stories, apply_change
from stintlake.sources.decisions import decision_documents
from stintlake.streaming import gate
from stintlake.streaming.ledger import Inbox, ledger, run_inbox

from .entities import NORMAL
from .registry import query

_TITLES = (
    "Car Presentation Submissions", "Parts and parameters changed during Parc Fermé", "Decision - Car 4 - Pit lane", "Infringement - Car 16", "Provisional Starting Grid", "Final Race Classification",
    "Initial Scrutineering", "New PU Elements for this Competition", "Race Director's Notes V3", "Entry List", "Pirelli preview", "Appeal",
)


def _case(phrases: dict[str, tuple[str, ...]], otherwise: str, norm: str) -> str:
    test = lambda p: f"starts_with({norm}, '{p[1:]}')" if p[0] == "^" else f"contains({norm}, '{p}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(test, ps))} THEN '{name}'" for name, ps in phrases.items()) + f" ELSE '{otherwise}' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("lineitem", sql=f"""
WITH l AS (SELECT l_orderkey AS page_id, l_linenumber AS n, l_suppkey % 25 AS event, l_returnflag AS flag, l_linestatus AS status, l_partkey,
    [{", ".join(map(_quoted, _TITLES))}][1 + (l_quantity::BIGINT % 12)] AS title,
    l_shipdate + INTERVAL (l_partkey % 1440) MINUTE AS local FROM lineitem),
seen AS (SELECT *, last_value(CASE WHEN n % 2 = 1 AND event % 2 = 0 THEN 'NATION_' || event || ' Grand Prix' END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n, l_partkey, title) AS event_name FROM l),
normed AS (SELECT *, {NORMAL.format('title')} AS norm, '/doc/' || l_partkey || '.pdf?a=1&b=2' AS url FROM seen WHERE event_name IS NOT NULL)
SELECT page_id, event_name, n AS document_number, title, {_case(taxonomy.DOCUMENT_CLASSES, taxonomy.DOCUMENT_OTHERWISE, 'norm')} AS document_type, 'https://docs.example' || url AS document_url,
  CASE WHEN flag <> 'N' THEN local - CASE WHEN status = 'O' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END END AS published_at, n % 3 = 0 AS recalled,
  sha256(event_name || '|' || n || '|' || 'https://docs.example' || url) AS external_id FROM normed""")
def section_documents(lineitem):
    """SRC18: pages of orders whose lines are documents below headings; headings of odd nations are of no known event, even lines have
    none. Times stand in the link, after it in parts, or nowhere."""
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("l_quantity").cast("long") % 12).cast("int"))
    local = F.date_format(F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("l_partkey") % 1440).cast("int")), "dd.MM.yy HH:mm")
    zone = F.when(F.col("l_linestatus") == "O", "CEST").otherwise("CET")
    stamp = F.concat_ws(" ", F.lit("Published on"), local, zone)
    day, time = F.substring_index(local, " ", 1), F.substring_index(local, " ", -1)
    event = F.col("l_suppkey") % 25
    heading = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("<h3> Nation_"), event, F.lit("  Grand Prix</h3>"))).otherwise("")
    link = F.concat(
        F.lit("<li><a class='x' href='/doc/"), "l_partkey", F.lit(".pdf?a=1&amp;b=2'>"), F.when(F.col("l_linenumber") % 3 == 0, "Recalled - ").otherwise(""), F.lit("Doc "), "l_linenumber", F.lit(" - <b>"), title, F.lit("</b> "),
        F.when(F.col("l_returnflag") == "R", stamp).otherwise(""), F.lit("</a><a href='/more'>more</a>"),
    )
    # a time that follows must come before the next link, so those documents have no link beside them
    link = F.when(F.col("l_returnflag") == "A", F.concat(F.replace(link, F.lit("<a href='/more'>more</a>"), F.lit("")), F.lit("<!-- x --> Published\non <i>"), day, F.lit("</i>&nbsp;"), time, F.lit(" "), zone)).otherwise(link)
    line = F.struct("l_linenumber", "l_partkey", title.alias("t"), F.concat(heading, link, F.lit("</li>")).alias("html"))
    # an order has seven lines at most
    pages = lineitem.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<p>Doc 9 - before any event<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["html"]), "\n"), F.lit("</ul>")).alias("html"))
    events = lineitem.sparkSession.range(0, 25, 2).select(F.concat(F.lit("NATION_"), "id", F.lit(" Grand Prix")).alias("name"))
    return decision_documents(pages, events, "page_id", "html", "https://docs.example").drop("published_label")


@query("events", sql="""
WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
w AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = w.user_id AND e.ts >= w.ts + INTERVAL 6 HOUR) FROM w WHERE w.ts IS NOT NULL)
SELECT user_id, ts, event_id FROM w JOIN e USING (user_id, ts)""")
def chunked_min_gap(events):
    """SRC03: samples at least six hours apart, found in chunks of a day that are joined by doubled links."""
    return chunked_downsample(events.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 6 * 3600, 86_400)


#: in which of the arriving parts an event comes: a tenth of them come a part late
_PARTS = 4


def _arriving(events):
    """Events with their part, in order of time but for every tenth one, which comes a part later."""
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))  # one row
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.expr(f"(unix_micros(cast(ts as timestamp)) - unix_micros(cast(low as timestamp))) * {_PARTS} div (unix_micros(cast(high as timestamp)) - unix_micros(cast(low as timestamp)) + 1)")
    rows = events.crossJoin(F.broadcast(span)).withColumn("part", F.least(F.lit(_PARTS - 1), part + (F.col("event_id") % 10 == 0).cast("int")).cast("int"))
    return rows.drop("low", "high").withColumn("_at", micros("ts"))


_ARRIVING_SQL = f"""
span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
arriving AS (SELECT e.*, least({_PARTS - 1}, ((epoch_us(ts) - low) * {_PARTS}) // (high - low + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS part FROM events e, span)"""


def _part_files(events, columns: list[str], files: int = 1) -> str:
    """A folder of the parts, ``files`` files each, written one after the other; returns its path. The rows of a part are read in all tasks and
    dealt to its files in turn."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    rows = _arriving(events)
    for part in range(_PARTS):
        rows.where(F.col("part") == part).select(*columns).repartition(files).write.parquet(f"{folder}/part={part}")
    return folder


def _files_of(events) -> int:
    """Files a part, of a million rows or more: so that none is left without rows, the smallest part decides."""
    sizes = _arriving(events).groupBy("part").count().collect()  # one row a part
    return max(1, min(r["count"] for r in sizes) // 1_000_000) if len(sizes) == _PARTS else 1


@query("events", sql=f"""
WITH {_ARRIVING_SQL},
rows AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS session_id, date_trunc('day', ts) + INTERVAL 1 DAY AS ends_at, ts, value, part FROM arriving),
clock AS (SELECT p.part, (SELECT max(ts) FROM arriving a WHERE a.part < p.part) AS now FROM (SELECT DISTINCT part FROM arriving UNION SELECT {_PARTS}) p),
first AS (SELECT session_id, ends_at, min(part) AS part FROM rows GROUP BY 1, 2),
released AS (SELECT f.session_id, f.ends_at, min(c.part) AS release FROM first f JOIN clock c ON c.part >= f.part AND c.now >= f.ends_at + INTERVAL 30 MINUTE GROUP BY 1, 2)
SELECT session_id, ends_at, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (part > release) AS late, CASE WHEN count(*) FILTER (part > release) > 0 THEN 2 ELSE 1 END::BIGINT AS version
FROM released JOIN rows USING (session_id, ends_at) GROUP BY 1, 2""")
def released_sessions(events):
    """TS01: a user's day is released half an hour after its end in stream time, and corrected once when events of it come with a
    later part. Events arrive in four parts, each of them a batch."""
    spark = events.sparkSession
    end = F.date_trunc("day", F.col("ts")) + F.make_dt_interval(days=F.lit(1))
    rows = events.select("event_id", "ts", F.concat_ws("@", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), end.cast("timestamp").alias("ends_at"), F.col("ts").cast("timestamp").alias("at"), "value")
    columns = ["session_id", "ends_at", "at", "value"]
    files = _files_of(rows)
    folder = _part_files(rows, columns, files)
    stream = spark.readStream.schema(rows.select(columns).schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")
    # a part late is at most two parts of the whole time, which all state has to wait for
    lateness = gate.dt.timedelta(days=365)
    versions = gate.run_gate(stream, f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}", gate.HOLD, lateness)
    last = gate.settled(versions)
    return last.select("session_id", F.col("ends_at").cast("timestamp_ntz").alias("ends_at"), "n", F.round("total", 2).alias("total"), "late", "version")


def _inbox(events) -> Inbox:
    """Four files of events, one that isn't Parquet and one that lacks a column."""
    spark = events.sparkSession
    columns = ["event_id", "user_id", "event_type", "ts"]
    folder = _part_files(events, columns)
    spark.range(1).coalesce(1).select(F.lit("no table").alias("value")).write.text(f"{folder}/part=malformed")
    events.select("event_id", "user_id").limit(5).coalesce(1).write.parquet(f"{folder}/part=narrow")
    return Inbox(f"{folder}/*", f"{shared_folder(spark)}/inbox-{uuid.uuid4().hex}", events.select(columns).schema, ("user_id", "event_type"), "ts")


@query("events", sql="SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def inbox_table(events):
    """TS02, TS03, TS07: the latest event of each user and kind, loaded from an inbox of six files, two a batch, two of them bad."""
    return run_inbox(events.sparkSession, _inbox(events))


@query("events", sql=f"""
WITH {_ARRIVING_SQL}
SELECT 'part=' || part AS source, 'loaded' AS state, count(*) AS rows, NULL::VARCHAR AS error FROM arriving GROUP BY part
UNION ALL VALUES ('part=malformed', 'failed', 0, 'unreadable'), ('part=narrow', 'failed', 0, 'missing columns: event_type, ts')""")
def inbox_ledger(events):
    """TS07, SNK08: what became of each file of the inbox."""
    inbox = _inbox(events)
    run_inbox(events.sparkSession, inbox)
    known = F.when(F.col("error").startswith("missing"), F.col("error")).when(F.col("error").isNotNull(), "unreadable")
    return ledger(events.sparkSession, inbox).select(F.regexp_extract("source", "(part=[a-z0-9]+)", 1).alias("source"), "state", "rows", known.alias("error"))


def _order_links(orders):
    """(left_id, right_id, rejected, second): each order and its customer's next, if that comes within 60 days."""
    nxt = lambda c: F.lead(c).over(R.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = orders.select("o_orderkey", "o_orderdate", nxt("o_orderkey").alias("n"), nxt("o_orderdate").alias("at"))
    near = rows.where(F.col("at") <= F.col("o_orderdate") + F.make_dt_interval(days=F.lit(60)))
    return near.select(F.col("o_orderkey").alias("left_id"), F.col("n").alias("right_id"), (F.col("o_orderkey") % 7 == 0).alias("rejected"), (F.col("o_orderkey") % 2 == 0).alias("second"))


@query("orders", sql="""
WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, o_orderkey % 11 = 0 AS gone, lead(o_orderkey) OVER c AS n, lead(o_orderdate) OVER c AS next_at FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (SELECT *, n IS NOT NULL AND next_at <= o_orderdate + INTERVAL 60 DAY AND id % 7 <> 0 AND NOT gone AND n % 11 <> 0 AS joined FROM o),
b AS (SELECT *, coalesce(lag(joined) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id), false) AS goes_on FROM l),
i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT id, min(id) OVER (PARTITION BY o_custkey, island) AS root FROM i WHERE NOT gone""")
def story_upkeep(orders):
    """DX36, DM42: orders as items that come in two changes and partly go in a third, their pairs accepted and partly rejected
    after; the smallest item of each item's story."""
    links = _order_links(orders)
    ids = orders.select(F.col("o_orderkey").alias("id"))
    pairs = lambda where: links.where(where).select("left_id", "right_id")
    state = Stories.none(orders.sparkSession)
    for change in (
        Change(items=ids.where("id % 3 <> 0"), accepted=pairs("not second")),
        Change(items=ids.where("id % 3 = 0"), accepted=pairs("second")),
        Change(gone=ids.where("id % 11 = 0"), rejected=pairs("rejected")),
    ):
        state, _ = apply_change(state, change)
    roots = state.members.groupBy("story_id").agg(F.min("id").alias("root"))
    return state.members.join(roots, "story_id").select("id", "root")


_WORLD = """
cand AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'driver' ELSE 'constructor' END AS kind, 's' || s_suppkey AS entity_id, 'sup-' || s_suppkey AS slug, 'Supér ' || (s_suppkey % 40) AS display_name,
  CASE WHEN s_suppkey % 4 = 0 THEN DATE '1970-01-01' + s_nationkey END AS birth_date FROM supplier),
ident AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'driver' ELSE 'constructor' END AS kind, 'p' || c_custkey AS provider_id, 'SUPER-' || (c_custkey % 90) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '1970-01-01' + c_nationkey END AS birth_date, 2000 + (c_custkey % 7)::INTEGER AS season, c_custkey FROM customer)"""


@query("customer", "supplier", sql=f"""
WITH {_WORLD},
maps AS (SELECT kind, provider_id, 'm' || c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 2003 END AS valid_from, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE 2004 END AS valid_to FROM ident WHERE c_custkey % 5 = 0),
i AS (SELECT *, replace(lower(name), '-', '') AS key FROM ident),
k AS (SELECT kind, replace(replace(lower(display_name), 'é', 'e'), ' ', '') AS key, count(*) AS found, min(entity_id) AS entity_id, arg_min(birth_date, entity_id) AS first_born, max(CASE WHEN birth_date IS NULL THEN 1 ELSE 0 END) AS open FROM cand GROUP BY 1, 2),
b AS (SELECT k.*, c.birth_date AS born FROM k JOIN cand c USING (kind, entity_id)),
hit AS (SELECT i.kind, i.provider_id, i.season, m.entity_id, CASE WHEN coalesce(m.valid_from, -9999) <= i.season AND coalesce(m.valid_to, 9999) >= i.season THEN 'exact_provider_id' ELSE 'provider_validity_extension' END AS method, NULL AS slug FROM i JOIN maps m USING (kind, provider_id)),
rest AS (SELECT i.* FROM i WHERE c_custkey % 5 <> 0),
named AS (SELECT r.kind, r.provider_id, r.season, CASE WHEN found = 1 AND NOT coalesce(r.kind = 'driver' AND r.birth_date <> born, false) THEN b.entity_id END AS entity_id,
  CASE WHEN found > 1 OR coalesce(r.kind = 'driver' AND r.birth_date <> born, false) THEN 'ambiguous' ELSE 'exact_identity' END AS method, NULL AS slug FROM rest r JOIN b ON b.kind = r.kind AND b.key = r.key),
new AS (SELECT r.*, first_value(provider_id) OVER w AS leader, first_value(birth_date) OVER w AS born FROM rest r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kind = r.kind AND b.key = r.key) WINDOW w AS (PARTITION BY kind, key ORDER BY season, provider_id)),
slugs AS (SELECT kind, provider_id AS leader, CASE WHEN EXISTS (SELECT 1 FROM cand c WHERE c.kind = n.kind AND c.slug = lower(n.name)) THEN lower(name) || '-' || provider_id ELSE lower(name) END AS slug FROM new n WHERE leader = provider_id),
made AS (SELECT n.kind, n.provider_id, n.season, CASE WHEN leader <> provider_id AND coalesce(n.kind = 'driver' AND birth_date <> born, false) THEN NULL ELSE n.kind || ':' || s.slug END AS entity_id,
  CASE WHEN leader = provider_id THEN 'auto_created' WHEN coalesce(n.kind = 'driver' AND birth_date <> born, false) THEN 'ambiguous' ELSE 'exact_identity' END AS method, CASE WHEN leader = provider_id THEN s.slug END AS slug FROM new n JOIN slugs s USING (kind, leader)),
u AS (SELECT * FROM hit UNION ALL SELECT * FROM named UNION ALL SELECT * FROM made)
SELECT kind, provider_id, season, entity_id, method, CASE method WHEN 'exact_provider_id' THEN 100 WHEN 'provider_validity_extension' THEN 100 WHEN 'ambiguous' THEN 0 WHEN 'exact_identity' THEN CASE kind WHEN 'driver' THEN 99 ELSE 98 END ELSE CASE kind WHEN 'driver' THEN 98 ELSE 95 END END AS confidence,
  method = 'ambiguous' AS review_required, slug FROM u""")
def reconciled_identities(customer, supplier):
    """DM49, DX20, DX21, DX23, DX25: customers as provider identities, suppliers as the entities they may be."""
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    kind = lambda c: F.when(F.col(c) % 2 == 0, "driver").otherwise("constructor").alias("kind")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    candidates = supplier.select(kind("s_suppkey"), F.concat(F.lit("s"), s).alias("entity_id"), F.concat(F.lit("sup-"), s).alias("slug"), F.concat(F.lit("Supér "), s % 40).alias("display_name"), F.when(s % 4 == 0, day("s_nationkey")).alias("birth_date"))
    people = customer.select(kind("c_custkey"), F.concat(F.lit("p"), c).alias("provider_id"), F.concat(F.lit("SUPER-"), c % 90).alias("name"), F.when(c % 3 == 0, day("c_nationkey")).alias("birth_date"), (2000 + c % 7).cast("int").alias("season"))
    maps = customer.where(c % 5 == 0).select(kind("c_custkey"), F.concat(F.lit("p"), c).alias("provider_id"), F.concat(F.lit("m"), c).alias("entity_id"), F.when(c % 10 != 0, 2003).alias("valid_from"), F.when(c % 15 != 0, 2004).alias("valid_to"))
    return R.reconcile(people, maps, candidates).drop("reason")


_TAKEN = """
new AS (SELECT p_partkey AS id, p_type AS kind, replace(p_name, ' ', '-') AS base FROM part WHERE p_partkey % 3 <> 0),
taken AS (SELECT DISTINCT p_type AS kind, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '-' || p_size ELSE '' END AS slug FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 < 3)"""


@query("part", sql=f"""
WITH {_TAKEN},
held AS (SELECT DISTINCT n.kind, n.base, CASE WHEN t.slug = n.base THEN 1 ELSE try_cast(substr(t.slug, length(n.base) + 2) AS BIGINT) END AS t FROM (SELECT DISTINCT kind, base FROM new) n JOIN taken t ON t.kind = n.kind AND (t.slug = n.base OR (starts_with(t.slug, n.base || '-') AND regexp_matches(t.slug, '-([2-9]|[1-9][0-9]+)$')))),
sizes AS (SELECT kind, base, count(*) AS c FROM new GROUP BY 1, 2),
numbers AS (SELECT kind, base, unnest(range(1, c + 60)) AS k FROM sizes),
free AS (SELECT kind, base, k, row_number() OVER (PARTITION BY kind, base ORDER BY k) AS r FROM numbers WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.kind = numbers.kind AND h.base = numbers.base AND h.t = numbers.k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, base ORDER BY id) AS r FROM new)
SELECT kind, id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM ranked JOIN free USING (kind, base, r)""")
def unique_slugs(part):
    """DX25: slugs for many new rows of few names beside those that are taken."""
    base, kind = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_type").alias("kind")
    taken = part.where("p_partkey % 3 = 0 and p_partkey % 7 < 3").select(kind, F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", base, "p_size")).otherwise(base).alias("slug")).distinct()
    return R.allocate_slugs(part.where("p_partkey % 3 <> 0").select(kind, F.col("p_partkey").alias("id"), base.alias("base")), taken, "id", "base", ["kind"])


_RANGES = "SELECT o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE year(o_orderdate) END::INTEGER AS valid_from, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE year(o_orderdate) + (o_orderkey % 3) - 1 + (o_orderkey % 2) END::INTEGER AS valid_to FROM orders"


@query("orders", sql=f"""
WITH r AS ({_RANGES}),
x AS (SELECT o_custkey, coalesce(valid_from, -9999) AS a, coalesce(valid_to, 9999) AS b FROM r WHERE coalesce(valid_from, -9999) <= coalesce(valid_to, 9999)),
y AS (SELECT DISTINCT o_custkey, s FROM (SELECT o_custkey, unnest(range(greatest(a, 1900), least(b, 2100) + 1)) AS s FROM x)),
g AS (SELECT *, s - row_number() OVER (PARTITION BY o_custkey ORDER BY s) AS island FROM y)
SELECT o_custkey, nullif(min(s), 1900)::INTEGER AS valid_from, nullif(max(s), 2100)::INTEGER AS valid_to FROM g GROUP BY o_custkey, island""")
def merged_validity(orders):
    """DX24: seasons of validity as the fewest ranges; overlapping and adjoining ones become one, ends may be open."""
    year, k = F.year("o_orderdate"), F.col("o_orderkey")
    ranges = orders.select("o_custkey", F.when(k % 31 != 0, year).cast("int").alias("valid_from"), F.when(k % 29 != 0, year + k % 3 - 1 + k % 2).cast("int").alias("valid_to"))
    return R.merged_ranges(ranges, ["o_custkey"])


@query("customer", "orders", sql="""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1994 END AS a, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 1995 END AS b FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT o_custkey AS c_custkey, min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN r.c_custkey IS NULL THEN low WHEN a IS NULL THEN NULL ELSE least(a, low) END::INTEGER AS valid_from, CASE WHEN r.c_custkey IS NULL THEN high WHEN b IS NULL THEN NULL ELSE greatest(b, high) END::INTEGER AS valid_to
FROM r FULL JOIN s USING (c_custkey)""")
def extended_validity(customer, orders):
    """DX24: one range a key, stretched to the seasons met; an open end stays open."""
    c = F.col("c_custkey")
    ranges = customer.where(c % 5 != 0).select("c_custkey", F.when(c % 4 != 0, 1994).alias("valid_from"), F.when(c % 6 != 0, 1995).alias("valid_to"))
    return R.extended(ranges, orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season")), ["c_custkey"])


_WORDS = [p.lstrip("^") for ps in taxonomy.STORY_CLASSES.values() for p in ps]


@query("documents", sql=f"""
WITH t AS (SELECT doc_id, [{", ".join(map(_quoted, _WORDS))}][1 + (doc_id % {2 * len(_WORDS)})] || 's ' || coalesce(text, '') AS own, coalesce(text, '') AS plain FROM documents),
n AS (SELECT doc_id, {NORMAL.format("coalesce(own, plain)")} AS norm FROM t)
SELECT doc_id, {_case(taxonomy.STORY_CLASSES, taxonomy.STORY_OTHERWISE, 'norm')} AS class FROM n""")
def story_taxonomy(documents):
    """ST15: the class of each whole text, half of which begin with a phrase of the rules."""
    own = F.concat(F.get(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % (2 * len(_WORDS))).cast("int")), F.lit("s "), F.coalesce("text", F.lit("")))
    return documents.select("doc_id", taxonomy.story_class(F.coalesce(own, "text", F.lit(""))).alias("class"))


@query("documents", "benchmark", sql=f"""
WITH b AS (SELECT item_id, string_split({NORMAL.format("text")}, ' ') AS w FROM benchmark),
rules AS (SELECT item_id % 13 AS place, 'class ' || (item_id % 13) AS class, array_to_string(w[1 : 1 + (item_id % 2)], ' ') AS phrase, item_id % 6 = 0 AS excludes FROM b
  UNION ALL SELECT 20, 'late', array_to_string(w[3 : 5], ' '), false FROM b),
t AS (SELECT doc_id, ' ' || {NORMAL.format("coalesce(text, '')")} || ' ' AS norm FROM documents),
met AS (SELECT doc_id, place, class, phrase, excludes FROM t JOIN rules ON contains(norm, ' ' || phrase || ' ')),
best AS (SELECT doc_id, class, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY place, phrase) AS k FROM met m WHERE NOT excludes AND NOT EXISTS (SELECT 1 FROM met x WHERE x.doc_id = m.doc_id AND x.class = m.class AND x.excludes))
SELECT t.doc_id, coalesce(class, 'none') AS class, phrase FROM t LEFT JOIN best ON best.doc_id = t.doc_id AND k = 1""")
def phrase_taxonomy(documents, benchmark):
    """ST15: rules as a table, with phrases from benchmark items; a rule may rule its class out."""
    w, k = F.split(T.normal(F.col("text")), " "), F.col("item_id")
    rules = benchmark.select((k % 13).cast("int").alias("place"), F.concat(F.lit("class "), k % 13).alias("class"), F.array_join(F.slice(w, F.lit(1), (1 + k % 2).cast("int")), " ").alias("phrase"), (k % 6 == 0).alias("excludes"))
    late = benchmark.select(F.lit(20).alias("place"), F.lit("late").alias("class"), F.array_join(F.slice(w, 3, 3), " ").alias("phrase"), F.lit(False).alias("excludes"))
    return taxonomy.classify_by_terms(documents, rules.unionByName(late), F.coalesce("text", F.lit("")), "doc_id", "none")
