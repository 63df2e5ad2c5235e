"""Readers and tolerant casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that mean "nothing" in provider files.
EMPTY = ("", "\\N")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tolerant(text: Column, kind: str) -> Column:
    """Cast that reads empty marks and malformed values as null."""
    return F.when(~F.trim(text).isin(*EMPTY), F.trim(text)).try_cast(kind)


def utc_timestamp(text: Column) -> Column:
    """ISO 8601 with or without an offset, then RFC 822 without its weekday."""
    rfc = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(F.regexp_replace(rfc, " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss xx")))


def scalar_or_array(text: Column) -> dict[str, Column]:
    """A field that holds a number, an array of numbers or free text, as three typed columns."""
    number = text.try_cast("double")
    array = F.when(F.trim(text).startswith("["), F.from_json(text, "array<double>"))
    return {"number": number, "parts": array, "label": F.when(number.isNull() & array.isNull(), text)}


def feed_items(xml: DataFrame, column: str = "xml") -> DataFrame:
    """RSS items of documents held in a string column, one row each, with a hash for a missing id."""
    parts = xml.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<item[ >].*?</item>"), F.lit(0))).alias("item"))

    def tag(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("item", f"(?s)<{name}[^>]*>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{name}>", 1)), F.lit(""))

    out = parts.select(tag("guid").alias("guid"), tag("title").alias("title"), tag("link").alias("url"), utc_timestamp(tag("pubDate")).alias("published_at"), F.regexp_extract_all("item", F.lit("(?s)<category[^>]*>(.*?)</category>"), F.lit(1)).alias("categories"))
    return out.withColumn("external_id", F.coalesce("guid", F.sha2(F.concat_ws("|", "title", "url"), 256))).drop("guid")


def article_links(pages: DataFrame, html: str, base: str, path: str) -> DataFrame:
    """Distinct absolute links whose path matches, without query or closing slash."""
    href = F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"#?]+)'), F.lit(1)))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return pages.select(href.alias("href")).select(F.regexp_replace(url, "/$", "").alias("url")).where(F.col("url").startswith(base) & F.col("url").rlike(path)).distinct()
