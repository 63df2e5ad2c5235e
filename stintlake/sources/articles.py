"""Metadata of article pages: linked data first, then meta tags, the document title and the first heading."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stintlake.functions.text import strip_tags

from .tables import utc_timestamp

# fixed values: node types that are articles, and the keys of an image object
ARTICLE_TYPES = {"article", "newsarticle", "reportagenewsarticle", "blogposting"}
IMAGE_KEYS = ("url", "contentUrl", "thumbnailUrl")

_FIELDS = ("url", "headline", "description", "body", "published", "section", "image", "author")


def _texts(value: object, keys: tuple[str, ...]) -> list[str]:
    """The texts of a field that is a text, an object with one of the keys, or a list of these at any depth."""
    found, open_ = [], [value]
    while open_:
        v = open_.pop()
        if isinstance(v, list):
            open_.extend(reversed(v))
        elif isinstance(v, dict):
            open_.extend([next((v[k] for k in keys if isinstance(v.get(k), str) and v[k].strip()), None)])
        elif isinstance(v, str) and v.strip():
            found.append(v.strip())
    return found


def _article(documents: list[str]) -> dict:
    """The first article, in reading order, among the nodes of the documents and of their graphs."""
    for text in documents:
        try:
            open_ = [json.loads(text)]
        except (ValueError, RecursionError):  # a malformed document says nothing
            continue
        while open_:
            v = open_.pop()
            if isinstance(v, list):
                open_.extend(reversed(v))
            elif isinstance(v, dict):
                if ARTICLE_TYPES & {str(t).casefold() for t in _texts(v.get("@type"), ())}:
                    return v
                open_.extend(reversed(v["@graph"]) if isinstance(v.get("@graph"), list) else [])
    return {}


@F.pandas_udf(StructType([StructField(f, StringType()) for f in _FIELDS]))
def article_node(documents: pd.Series) -> pd.DataFrame:
    """The fields of the article among JSON-LD documents; fields of other kinds than text are null."""
    rows = []
    for d in documents:
        node = _article([] if d is None else list(d))
        plain = [next(iter(_texts(node.get(k) if isinstance(node.get(k), str) else None, ())), None) for k in ("url", "headline", "description", "articleBody", "datePublished")]
        section = ", ".join(_texts(node.get("articleSection"), ())) or None
        image = next(iter(_texts(node.get("image"), IMAGE_KEYS)), None)
        rows.append((*plain, section, image, ", ".join(_texts(node.get("author"), ("name",))) or None))
    return pd.DataFrame(rows, columns=list(_FIELDS), dtype=object)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.nullif(F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(quoted, F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1), F.lit("")))


def absolute_url(url: Column, base: Column) -> Column:
    """A reference seen from the page ``base``; steps upwards ("../") stay as they are written."""
    origin = F.regexp_extract(base, "^[a-z]+://[^/]*", 0)
    folder = F.when(base == origin, F.concat(base, F.lit("/"))).otherwise(F.regexp_replace(base, "[^/]*$", ""))
    beside = F.when(url.startswith("//"), F.concat(F.regexp_extract(base, "^[a-z]+:", 0), url)).when(url.startswith("/"), F.concat(origin, url))
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.coalesce(beside, F.concat(folder, url)))


def article_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds canonical_url, title, title_source, summary, body_excerpt, author, published_at, section,
    language, image_url and image_source to pages. A page without a title keeps its row with a null one.
    Python is handed the linked data alone, not the pages."""
    first = lambda pattern: F.nullif(strip_tags(F.regexp_extract(html, pattern, 1)), F.lit(""))
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    tags = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(_attribute(t, "property"), _attribute(t, "name"))).alias("key"), _attribute(t, "content").alias("content")))
    links = F.filter(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: F.contains(F.lower(_attribute(t, "rel")), F.lit("canonical")))
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))

    kept = pages.columns
    read = pages.select("*", F.filter(tags, lambda t: t["key"].isNotNull() & t["content"].isNotNull()).alias("_meta"), _attribute(F.try_element_at(links, F.lit(-1)), "href").alias("_link"), scripts.alias("_scripts"))
    read = read.withColumn("_node", article_node("_scripts"))

    def meta(key: str) -> Column:
        """The last tag of that key."""
        return F.nullif(strip_tags(F.try_element_at(F.filter("_meta", lambda t: t["key"] == key), F.lit(-1))["content"]), F.lit(""))

    node = lambda name: F.nullif(strip_tags(F.col(f"_node.{name}")), F.lit(""))
    titles = {"json_ld": node("headline"), "open_graph": meta("og:title"), "twitter": meta("twitter:title"), "document_title": first("(?is)<title[^>]*>(.*?)</title>"), "h1": first("(?is)<h1[^>]*>(.*?)</h1>")}
    images = {"json_ld": F.col("_node.image"), "open_graph": F.coalesce(meta("og:image"), meta("twitter:image"))}
    chosen = lambda options: F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in options.items()])
    canonical = F.coalesce("_link", "_node.url", meta("og:url"), F.col(url))
    canonical = F.rtrim(F.substring_index(canonical, "?", 1), F.lit("/"))
    return read.select(
        *kept,
        canonical.alias("canonical_url"),
        F.coalesce(*titles.values()).alias("title"),
        chosen(titles).alias("title_source"),
        F.coalesce(node("description"), meta("description"), meta("og:description")).alias("summary"),
        node("body").alias("body_excerpt"),
        F.coalesce(node("author"), meta("author")).alias("author"),
        utc_timestamp(F.coalesce(F.col("_node.published"), meta("article:published_time"), meta("date"))).alias("published_at"),
        F.coalesce(node("section"), meta("article:section")).alias("section"),
        F.nullif(F.regexp_extract(html, """(?is)<html[^>]*\\slang\\s*=\\s*["']([^"']*)["']""", 1), F.lit("")).alias("language"),
        absolute_url(F.coalesce(*images.values()), canonical).alias("image_url"),
        chosen(images).alias("image_source"),
    )
