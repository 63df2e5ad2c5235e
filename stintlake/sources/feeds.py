"""RSS and Atom feeds, one XML text a row, read by Spark's XML parser.

The kinds differ in names and in where a value stands (a text or an attribute), not in shape, so one schema reads
``item`` below ``channel`` or the root and ``entry`` below the root; name spaces are ignored, so ``dc:creator`` is a creator. A value is
the first that isn't blank. Of several names for one thing the first of the list counts, whatever their order in the feed.

A feed that isn't well formed gives no items and the state ``malformed``; a null or blank text, or one without items,
is ``empty``. An item without a title or a link is left out, as it can't be shown or told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import utc_timestamp

# fixed values: the names of an item's fields, best first, and the ends of picture addresses
NAMES = {"title": ("title",), "link": ("link",), "native_id": ("guid", "id"), "published": ("pubDate", "published", "updated", "date"), "summary": ("description", "summary", "content", "encoded"), "author": ("creator", "author")}
PICTURES = r"(?i)\.(jpg|jpeg|png|webp|avif)$"

_VALUE = "array<struct<_VALUE:string,_href:string,_url:string,_type:string,_term:string,_rel:string,name:string>>"
_FIELDS = ("title", "link", "guid", "id", "pubDate", "published", "updated", "date", "description", "summary", "content", "encoded", "creator", "author", "category", "thumbnail", "enclosure")
_ITEM = f"array<struct<{','.join(f'{f}:{_VALUE}' for f in _FIELDS)}>>"
# an item of which nothing is read: the parser passes over what is in it
_BARE = "array<struct<_none:string>>"
# the ends of texts that don't count: what \\s matches
_BLANK = " \t\n\x0b\f\r"


def _texts(item: Column, names: tuple[str, ...]) -> Column:
    """The values of the named fields that aren't blank, in the order of the names."""
    known = lambda x: F.trim(F.coalesce(x["_VALUE"], x["name"]), F.lit(_BLANK))
    lists = [F.coalesce(F.transform(item[n], known), F.array().cast("array<string>")) for n in names]
    return F.array_remove(F.array_compact(F.concat(*lists)), "")


def _all(item: Column, names: tuple[str, ...]) -> Column:
    return F.concat(*[F.coalesce(item[n], F.array().cast(_VALUE)) for n in names])


def _parsed(feeds: DataFrame, id_col: str, column: str, item: str) -> DataFrame:
    schema = f"struct<channel:array<struct<item:{item}>>,item:{item},entry:{item},_corrupt_record:string>"
    given = F.nullif(F.trim(F.col(column)), F.lit(""))
    feed = F.from_xml(given, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true", "attributePrefix": "_"})
    none = F.array().cast(item)
    rows = feeds.select(F.col(id_col), given.alias("_given"), feed.alias("_f"))
    channel = F.flatten(F.transform(F.col("_f.channel"), lambda c: F.coalesce(c["item"], none)))
    items = F.concat(F.coalesce(channel, none), F.coalesce("_f.item", none), F.coalesce("_f.entry", none))
    broken = F.col("_given").isNotNull() & (F.col("_f").isNull() | F.col("_f._corrupt_record").isNotNull())
    return rows.select(id_col, "_given", broken.alias("_broken"), F.when(broken | F.col("_given").isNull(), none).otherwise(items).alias("_items"))


def feed_states(feeds: DataFrame, id_col: str, column: str = "xml") -> DataFrame:
    """(id, state, items) of every feed: ``read``, ``empty`` or ``malformed``."""
    rows = _parsed(feeds, id_col, column, _BARE)
    return rows.select(id_col, F.when(F.col("_broken"), "malformed").when(F.size("_items") == 0, "empty").otherwise("read").alias("state"), F.size("_items").alias("items"))


def feed_entries(feeds: DataFrame, id_col: str, column: str = "xml") -> DataFrame:
    """(id, external_id, title, url, canonical_url, published_at, summary, author, categories, image_url) of the items of all feeds."""
    # an outer explode: the filter that a plain one puts before the parser would parse every feed several times
    rows = _parsed(feeds, id_col, column, _ITEM).select(id_col, F.explode_outer("_items").alias("x"))
    x = F.col("x")
    first = lambda key: F.get(_texts(x, NAMES[key]), F.lit(0))
    href = F.get(F.array_compact(F.transform(F.coalesce(x["link"], F.array().cast(_VALUE)), lambda v: F.nullif(F.trim(v["_href"]), F.lit("")))), F.lit(0))
    words = F.array_compact(F.transform(F.coalesce(x["category"], F.array().cast(_VALUE)), lambda v: F.coalesce(F.nullif(v["_term"], F.lit("")), F.nullif(F.trim(v["_VALUE"]), F.lit("")))))
    address = lambda v: F.coalesce(v["_url"], v["_href"])
    pictures = F.filter(_all(x, ("content", "thumbnail", "enclosure")), lambda v: address(v).isNotNull() & (F.coalesce(F.startswith(v["_type"], F.lit("image/")), F.lit(False)) | F.substring_index(address(v), "?", 1).rlike(PICTURES)))
    known = rows.where("x is not null").select(id_col, "x", first("title").alias("title"), F.coalesce(first("link"), href).alias("url")).where("title is not null and url is not null")
    out = known.select(
        id_col, "title", "url", first("native_id").alias("_native"), first("published").alias("_published"), first("summary").alias("summary"), first("author").alias("author"),
        words.alias("categories"), F.get(F.transform(pictures, address), F.lit(0)).alias("_image"),
    ).withColumn("published_at", utc_timestamp(F.col("_published")))
    bare = F.regexp_replace(F.substring_index("url", "?", 1), "/+$", "")
    return out.withColumn("canonical_url", bare).select(
        id_col, F.coalesce("_native", F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), "url"), 256)).alias("external_id"), "title", "url", "canonical_url", "published_at", "summary", "author", "categories",
        absolute(F.col("canonical_url"), F.col("_image")).alias("image_url"),
    )


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: whole, without protocol, from the root of the host, or beside the page."""
    site = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    beside = F.regexp_replace(F.concat(base, F.when(F.regexp_replace(base, "^[A-Za-z][A-Za-z0-9+.-]*://", "").contains("/"), "").otherwise("/")), "[^/]*$", "")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.substring_index(base, "//", 1), link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(beside, link))
