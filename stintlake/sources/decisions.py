"""Decision documents of listing pages: links below event headings, with the time that follows them.

A page is read as a sequence of links and texts. What a text means depends on what stood before it: a known
event's name opens its section until another known one; a link named "Doc n - title" within a section opens a document,
which the next link or event closes; the first time of publication in its own name or in the texts before it is closed
is its time. The state is carried by window functions over the page's sequence, so a page is one key of a shuffle and
nothing is collected but the texts of one document. Texts before any known event, links of other names and headings of unknown
events mean nothing. A page without html has no documents, as has one whose documents lie below no known event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.functions.taxonomy import document_class

# fixed values: how links and times are written, and the offset of the two local times
LINK_NAME = r"(?i)^(recalled\s*-\s*)?doc\s+([0-9]+)\s*-\s*(.+)$"
PUBLISHED = r"(?i)published\s+on\s+[0-9]{2}\.[0-9]{2}\.[0-9]{2}\s+[0-9]{2}:[0-9]{2}\s+(?:CET|CEST)\b"
OFFSETS = {"CEST": 2, "CET": 1}

_TOKEN = r"(?is)<a(?:\s[^>]*)?>.*?(?:</a\s*>|(?=<a[\s>])|$)|<[^>]*>|[^<]+|<"


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(T.unescaped(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def published_at(label: Column) -> Column:
    """The moment of "Published on dd.mm.yy HH:MM CET", as a time in UTC; null for what isn't one. Years from 69 on are of the last century."""
    text = F.regexp_replace(label, r"\s+", " ")
    day, year, time = (F.regexp_extract(text, r"([0-9]{2}\.[0-9]{2}\.)([0-9]{2}) ([0-9]{2}:[0-9]{2})", k) for k in (1, 2, 3))
    century = F.when(year >= "69", "19").otherwise("20")
    local = F.try_to_timestamp(F.concat(day, century, year, F.lit(" "), time), F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz")
    hours = F.when(F.upper(text).endswith("CEST"), OFFSETS["CEST"]).otherwise(OFFSETS["CET"])
    return local - F.make_dt_interval(hours=hours)


def page_tokens(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, n, link, href, text) of the links and non-empty texts of each page in order."""
    bare = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tokens = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(0))).alias("n", "token"))
    cut = tokens.withColumn("link", F.col("token").rlike(r"(?i)^<a[\s>]")).where("link or not startswith(token, '<')")
    text = F.when(F.col("link"), F.regexp_replace("token", r"(?is)^<a[^>]*>", "")).otherwise(F.col("token"))
    href = F.nullif(F.regexp_extract("token", r"""(?is)^<a[^>]*?\shref\s*=\s*["']?([^"'\s>]*)""", 1), F.lit(""))
    rows = cut.select(id_col, "n", "link", F.when(F.col("link"), T.unescaped(href)).alias("href"), _plain(text).alias("text"))
    return rows.where("link or text <> ''")


def decision_documents(pages: DataFrame, events: DataFrame, id_col: str = "page_id", html_col: str = "html", base: str = "") -> DataFrame:
    """(id, event_name, document_number, title, document_type, document_url, published_label, published_at, recalled,
    external_id) of pages, given the known ``events`` (name); of names of one normal form the smallest counts."""
    known = events.groupBy(T.normal(F.col("name")).alias("_key")).agg(F.min("name").alias("_event")).where("_key <> ''")
    tokens = page_tokens(pages, id_col, html_col).withColumn("_key", F.when(~F.col("link"), T.normal(F.col("text"))))
    rows = tokens.join(known, "_key", "left")
    so_far = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("link") | F.col("_event").isNotNull()
    rows = rows.withColumns({"event_name": F.last("_event", True).over(so_far), "block": F.sum(closes.cast("int")).over(so_far)})
    # a block is a link (or an event's name) and the texts up to the next
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("link") & F.col("_event").isNull(), F.struct("n", "text")))), lambda x: x["text"]), " ")
    opened = lambda c: F.max(F.when(F.col("link"), F.col(c))).alias(c)
    blocks = rows.where("event_name is not null").groupBy(id_col, "event_name", "block").agg(opened("href"), opened("text"), texts.alias("tail"))
    # each step is named before it is used more than once, so that no expression of one is written into the next
    inside, after = (F.nullif(F.regexp_extract(c, PUBLISHED, 0), F.lit("")) for c in ("text", "tail"))
    links = blocks.where(F.col("href").isNotNull()).select(id_col, "event_name", "href", F.trim(F.regexp_replace("text", rf"(?s){PUBLISHED}.*$", "")).alias("_name"), inside.alias("_inside"), after.alias("_after"))
    part = lambda k: F.regexp_extract("_name", LINK_NAME, k)
    named = links.where(F.col("_name").rlike(LINK_NAME)).select(id_col, "event_name", "href", part(1).alias("_recalled"), part(2).alias("_number"), F.trim(part(3)).alias("title"), F.coalesce("_inside", "_after").alias("published_label"))
    out = named.select(
        id_col, "event_name", F.col("_number").try_cast("int").alias("document_number"), "title", document_class(F.col("title")).alias("document_type"),
        F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href")).alias("document_url"),
        "published_label", published_at(F.col("published_label")).alias("published_at"), (F.col("_recalled") != "").alias("recalled"),
    )
    return out.withColumn("external_id", F.sha2(F.concat_ws("|", "event_name", "document_number", "document_url"), 256))
