"""Feeds and galleries made of orders and their lines, read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintlake.functions import taxonomy
from stintlake.operators.routing import route_items
from stintlake.sources.feeds import feed_entries, feed_states
from stintlake.sources.galleries import gallery_pictures

from .registry import query


def _joined(*parts: str | Column) -> Column:
    """Texts and columns after each other; a null column is nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _pages(lines, piece: Column):
    """(l_orderkey, html) with the pieces of an order's lines, of which there are seven at most, in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", piece.alias("t")))), lambda x: x["t"]), "\n")
    return lines.groupBy("l_orderkey").agg(body.alias("html"))


_KIND = "l_orderkey % 4"
_FEED_SQL = """
WITH l AS (SELECT l_orderkey AS feed, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, l_orderkey % 4 AS kind, l_shipdate AS at_, l_orderkey % 13 = 5 AS broken FROM lineitem),
i AS (SELECT *, 'https://news.example/a/' || p || '/' AS link FROM l WHERE NOT broken AND kind <> 3 AND n <> 6)"""


@query("lineitem", sql=_FEED_SQL + """
SELECT feed, CASE WHEN q % 5 = 0 THEN sha256(feed || '|' || link || '?x=1') ELSE 'id-' || p || '-' || n END AS external_id, 'Line ' || n || ' & <b>part</b> ' || p AS title, link || '?x=1' AS url, 'https://news.example/a/' || p AS canonical_url,
  at_ + CASE WHEN kind = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL (-2) HOUR END AS published_at, CASE WHEN n % 2 = 0 THEN 'Says ' || s END AS summary, CASE WHEN n % 3 = 0 THEN 'Author ' || s END AS author, 'c' || (p % 3) || '|d' AS categories,
  CASE s % 4 WHEN 0 THEN 'https://img.example/' || p || '.JPG?w=1' WHEN 1 THEN 'https://news.example/i/' || p WHEN 2 THEN 'https://news.example/a/i.webp' END AS image_url FROM i""")
def feed_items_of_kinds(lineitem):
    """SRC14, SRC15: items of RSS, Atom and prefixed feeds; a thirteenth of the feeds is broken, a quarter has no items, and items
    without a title are left out."""
    return feed_entries(_feeds(lineitem), "feed").withColumn("categories", F.array_join("categories", "|")).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("lineitem", sql="""
SELECT l_orderkey AS feed, CASE WHEN l_orderkey % 13 = 5 THEN 'malformed' WHEN l_orderkey % 4 = 3 THEN 'empty' ELSE 'read' END AS state, CASE WHEN l_orderkey % 13 = 5 OR l_orderkey % 4 = 3 THEN 0 ELSE count(*) END AS items FROM lineitem GROUP BY l_orderkey""")
def feed_states_of_kinds(lineitem):
    """SRC14, TS07: what became of each feed."""
    return feed_states(_feeds(lineitem), "feed")


def _feeds(lineitem):
    kind, n, p, s = F.col("l_orderkey") % 4, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    link = _joined("https://news.example/a/", p, "/?x=1")
    has_id = F.col("l_quantity").cast("long") % 5 != 0
    ident = F.when(has_id, _joined("id-", p, "-", n))
    title = F.when(n != 6, _joined("Line ", n, " &amp; &lt;b&gt;part&lt;/b&gt; ", p))
    cdata = F.when(n != 6, _joined("<![CDATA[Line ", n, " & <b>part</b> ", p, "]]>"))
    address = F.when(s % 4 == 0, _joined("https://img.example/", p, ".JPG?w=1")).when(s % 4 == 1, _joined("/i/", p)).when(s % 4 == 2, "i.webp")
    author, summary = F.when(n % 3 == 0, _joined("Author ", s)), F.when(n % 2 == 0, _joined("Says ", s))
    tag = lambda name, value: F.when(value.isNotNull(), _joined(f"<{name}>", value, f"</{name}>"))
    media = lambda name: F.when(address.isNotNull(), _joined(f"<{name} type='image/png' url='", address, "'/>"))
    iso, rfc = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), F.date_format("l_shipdate", "EEE, d MMM yyyy HH:mm:ss '+0000'")
    rss = _joined("<item>", tag("title", cdata), tag("link", link), tag("guid", ident), tag("pubDate", rfc), tag("description", summary), tag("author", author), "<category>c", p % 3, "</category><category>d</category>", media("enclosure"), "</item>")
    atom = _joined("<entry>", tag("title", title), "<link rel='alternate' href='", link, "'/>", tag("id", ident), tag("updated", iso), tag("summary", summary), F.when(author.isNotNull(), _joined("<author><name>", author, "</name></author>")), "<category term='c", p % 3, "'/><category term='d'/>", media("media:thumbnail"), "</entry>")
    dc = _joined("<item>", tag("title", cdata), tag("link", link), tag("guid", ident), tag("dc:date", iso), tag("content:encoded", summary), tag("dc:creator", author), "<category> </category><category>c", p % 3, "</category><category>d</category>", media("media:content"), "</item>")
    lines = _pages(lineitem, F.when(kind == 0, rss).when(kind == 1, atom).otherwise(dc))
    spaces = "xmlns:media='http://m' xmlns:dc='http://d' xmlns:content='http://c'"
    body, kind = F.col("html"), F.col("l_orderkey") % 4
    whole = F.when(kind == 0, _joined("<?xml version='1.0'?><rss version='2.0'><channel><title>Feed</title>", body, "</channel></rss>")).when(kind == 1, _joined(f"<feed xmlns='http://www.w3.org/2005/Atom' {spaces}><title>Feed</title>", body, "</feed>"))
    whole = whole.when(kind == 2, _joined(f"<rss {spaces}><channel>", body, "</channel></rss>")).otherwise("<rss><channel><title>none</title></channel></rss>")
    xml = F.when(F.col("l_orderkey") % 13 == 5, F.expr("left(x, length(x) - 9)")).otherwise(F.col("x"))
    lines = lines.withColumn("x", whole)
    return lines.select(F.col("l_orderkey").alias("feed"), xml.alias("xml"))


_ROLE_WORDS = [p for ps in taxonomy.PICTURE_ROLES.values() for p in ps]
_ROLES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(caption), '{'|'.join(ps)}') THEN '{r}'" for r, ps in taxonomy.PICTURE_ROLES.items()) + " ELSE 'generic' END"


@query("lineitem", sql=f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
t AS (SELECT l_orderkey AS page, k, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN 'https://g.example/wp-content/uploads/' || l_partkey || '.jpg' WHEN l_linenumber % 4 = 1 THEN 'https://g.example/2024/full/' || l_partkey || '.png?x=1'
    WHEN l_linenumber % 4 = 2 THEN 'https://cdn.example/' || l_partkey || '.WEBP' END AS image_url,
  'Car ' || l_suppkey || ' ' || [{", ".join(f"'{w}'" for w in _ROLE_WORDS)}][1 + l_partkey % {len(_ROLE_WORDS) + 9}] || ' & more' AS words, l_suppkey, l_partkey, l_quantity::BIGINT % 6 AS q FROM l),
c AS (SELECT *, coalesce(words, 'Car ' || l_suppkey) || CASE q WHEN 0 THEN ' (Photo by Ann B./Getty Images) 1234567890' WHEN 1 THEN ' photograph by C D / LAT Images)' WHEN 2 THEN ' / Red Bull Content Pool SI202401010001 Editorial use only' WHEN 3 THEN ' (Photo by E/Sutton)' ELSE '' END AS text FROM t WHERE image_url IS NOT NULL),
p AS (SELECT *, CASE WHEN n % 4 = 1 AND q = 4 THEN NULL ELSE text END AS shown, CASE WHEN n % 4 = 2 THEN NULL WHEN n % 4 = 0 THEN text ELSE 'alt ' || l_partkey END AS alt_text FROM c QUALIFY row_number() OVER (PARTITION BY page, image_url ORDER BY k) = 1),
r AS (SELECT *, coalesce(shown, alt_text) AS caption FROM p)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) AS n, image_url, 'Gallery ' || page AS gallery_title, caption, alt_text, CASE WHEN caption = text THEN CASE q WHEN 0 THEN 'Ann B.' WHEN 1 THEN 'C D' WHEN 3 THEN 'E' END END AS photographer,
  CASE WHEN caption = text THEN CASE q WHEN 0 THEN 'Getty Images' WHEN 1 THEN 'LAT Images' WHEN 3 THEN 'Sutton' END END AS agency,
  CASE WHEN caption = text THEN CASE q WHEN 0 THEN 'getty_images' WHEN 1 THEN 'lat_images' WHEN 2 THEN 'red_bull_content_pool' WHEN 3 THEN 'sutton_images' END END AS origin_provider,
  CASE WHEN caption = text THEN CASE q WHEN 0 THEN '1234567890' WHEN 2 THEN 'SI202401010001' END END AS origin_asset_id, {_ROLES_SQL} AS content_role, CASE WHEN contains(caption, 'Editorial') THEN 'editorial use only' END AS rights_note FROM r""")
def gallery_items(lineitem):
    """SRC19, DX40: pictures of gallery pages: bare ones among the uploads, figures with a link to the full picture, figures
    with their picture alone, and pictures that don't count."""
    n, p, s, q = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long") % 6
    words = F.get(F.array(*map(F.lit, _ROLE_WORDS)), (p % (len(_ROLE_WORDS) + 9)).cast("int"))
    said = F.when(words.isNotNull(), _joined("Car ", s, " ", words, " &amp; more")).otherwise(_joined("Car ", s))
    credit = F.when(q == 0, " (Photo by Ann B./Getty Images) 1234567890").when(q == 1, " photograph by C D / LAT Images)").when(q == 2, " / Red Bull Content Pool SI202401010001 Editorial use only").when(q == 3, " (Photo by E/Sutton)").otherwise("")
    text = F.concat(said, credit)
    bare = _joined('<p><img class="x" alt="', text, '" src="/wp-content/uploads/', p, '.jpg"></p><img src="/elsewhere/', p, '.jpg"><img src="/wp-content/uploads/x.svg">')
    linked = _joined("<figure class=a><a href='full/", p, ".png?x=1'><img alt='alt ", p, "' data-src='/small/", p, ".jpg'></a><a href='/about'>x</a>", F.when(q == 4, "").otherwise(_joined("<figcaption>\n ", F.replace(text, F.lit(" / "), F.lit(" <i>/</i> ")), "</figcaption>")), "</figure>")
    alone = _joined("<FIGURE><img src=//cdn.example/", p, ".WEBP><figcaption>first</figcaption><figcaption>", text, "</figcaption></FIGURE>")
    other = _joined("<figure><a href='/page/", p, "'>none</a><figcaption>", text, "</figcaption></figure><!-- <img src='/wp-content/uploads/no.jpg'> -->")
    pages = _pages(lineitem, F.when(n % 4 == 0, bare).when(n % 4 == 1, linked).when(n % 4 == 2, alone).otherwise(other))
    pages = pages.select(F.col("l_orderkey").alias("page"), F.lit("https://g.example/2024/gallery").alias("url"), _joined("<h1> </h1><h1>Gallery <b>", F.col("l_orderkey"), "</b></h1><h1>late</h1>", F.col("html")).alias("html"))
    return gallery_pictures(pages, "page", "url", "html")


@query("part", sql=r"""
WITH i AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'News of the week' WHEN 1 THEN 'xf1 test' ELSE 'Formula  1:' END || CASE WHEN p_partkey % 17 = 0 THEN ' ica-2024-0' || (p_partkey % 5) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END || ' ' || p_name AS text FROM part),
rules AS (SELECT DISTINCT p_type AS story_id, CASE WHEN starts_with(p_type, 'E') THEN 5 ELSE 3 END AS min_score FROM part),
terms AS (SELECT story_id, story_id AS term, 3 AS weight FROM rules UNION ALL SELECT DISTINCT p_type, upper(p_name), 2 FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT DISTINCT p_type, p_name || '', 1 FROM part WHERE p_partkey % 30 = 7 UNION ALL SELECT story_id, 'f', 1 FROM rules WHERE length(story_id) % 2 = 0),
idents AS (SELECT story_id, 'ICA-2024-0' || (length(story_id) % 5) AS value FROM rules),
own AS (SELECT id, min(story_id) AS a, max(story_id) AS b FROM (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bICA-\d{4}(?:-\d{2})+\b'), lambda x: upper(x)))) AS value FROM i) JOIN idents USING (value) GROUP BY 1),
s AS (SELECT id, story_id, sum(weight) AS score FROM i JOIN terms ON contains(lower(text), lower(term)) GROUP BY 1, 2),
e AS (SELECT s.* FROM s JOIN rules USING (story_id) WHERE score >= min_score),
t AS (SELECT id, max(score) AS top FROM e GROUP BY 1),
u AS (SELECT t.id, top, count(*) AS ties, min(story_id) AS story_id FROM t JOIN e ON e.id = t.id AND e.score = t.top GROUP BY 1, 2),
r AS (SELECT i.id, a, b, top, ties, u.story_id AS story, CASE WHEN a <> b THEN 'ambiguous' WHEN a IS NOT NULL THEN 'matched' WHEN NOT regexp_matches(text, '(?i)\bformula\s+one\b|\bformula\s*1\b|\bf1\b') THEN 'filtered' WHEN ties IS NULL THEN 'unmatched' WHEN ties > 1 THEN 'ambiguous' ELSE 'matched' END AS status
  FROM i LEFT JOIN own ON own.id = i.id LEFT JOIN u ON u.id = i.id)
SELECT id, status, CASE WHEN status = 'matched' THEN coalesce(a, story) END AS story_id, CASE WHEN a IS NOT NULL THEN 100 WHEN status IN ('filtered', 'unmatched') THEN 0 ELSE top END::BIGINT AS score FROM r""")
def routed_items(part):
    """ST14, DM53: items to stories by identifiers and weighted terms, filtered and ambiguous ones included."""
    k, kind, name = F.col("p_partkey"), F.col("p_type"), F.col("p_name")
    opening = F.when(k % 6 == 0, "News of the week").when(k % 6 == 1, "xf1 test").otherwise("Formula  1:")
    title = F.concat(opening, F.when(k % 17 == 0, F.concat(F.lit(" ica-2024-0"), k % 5)).otherwise(""))
    items = part.select(k.alias("id"), title.alias("title"), F.array_compact(F.array(F.when(k % 3 == 0, kind), name)).alias("categories"))
    rules = part.select(kind.alias("story_id"), F.when(kind.startswith("E"), 5).otherwise(3).alias("min_score")).distinct()
    story, term = F.col("story_id"), lambda where, text, weight: part.where(where).select(kind.alias("story_id"), text.alias("term")).distinct().withColumn("weight", F.lit(weight))
    terms = rules.select(story, story.alias("term"), F.lit(3).alias("weight")).unionByName(term(k % 20 == 0, F.upper(name), 2)).unionByName(term(k % 30 == 7, name, 1)).unionByName(rules.where(F.length(story) % 2 == 0).select(story, F.lit("f").alias("term"), F.lit(1).alias("weight")))
    identifiers = rules.select(story, F.concat(F.lit("ICA-2024-0"), F.length(story) % 5).alias("value"))
    return route_items(items, rules, terms, identifiers)
