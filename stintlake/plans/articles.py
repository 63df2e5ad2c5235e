"""Article pages read for their metadata, on pages that are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stintlake.sources.articles import article_metadata

from .registry import query


@query("customer", sql="""
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'https://site.example/ld' WHEN c_mktsegment = 'BUILDING' THEN 'https://site.example/og' ELSE 'https://site.example/p/' || c_custkey END AS canonical_url,
  c_name AS title, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'json_ld' WHEN 'BUILDING' THEN 'open_graph' WHEN 'FURNITURE' THEN 'twitter' WHEN 'HOUSEHOLD' THEN 'document_title' ELSE 'h1' END AS title_source,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Ann, Bob' WHEN 'FURNITURE' THEN 'Cy' END AS author,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Race, Tech' WHEN 'BUILDING' THEN 'News' END AS section,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://cdn.example/a.jpg' WHEN 'BUILDING' THEN 'https://site.example/i/b.jpg' WHEN 'FURNITURE' THEN 'https://site.example/p/c.jpg' END AS image_url,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'tale of ' || c_nationkey END AS summary,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN '2026-05-01' END AS published
FROM customer""")
def article_pages(customer):
    """SRC17, AJ08, DX45: the metadata of a page from its JSON-LD graph, its meta tags, its title or its heading."""
    name, tale, nothing = F.col("c_name"), F.concat(F.lit("tale of "), F.col("c_nationkey")), F.lit("")
    ld = F.format_string(
        '<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type": "WebSite", "@graph": [{"@type": ["Thing", "NewsArticle"], "url": "https://site.example/ld/?x=1", "headline": "%s", "description": "%s", '
        '"datePublished": "2026-05-01T10:00:00Z", "articleSection": ["Race", "Tech"], "image": [{"width": 1}, {"contentUrl": "https://cdn.example/a.jpg"}], "author": [{"name": "Ann"}, "Bob"]}]}]</script><title>no</title>',
        name, tale,
    )
    og = F.format_string(
        '<link rel="Canonical" href="https://site.example/og?utm=1"><meta property="og:title" content="old"><meta content="%s" property="OG:title"><meta name="description" content="%s"><meta property="article:section" content="News">'
        "<meta property='og:image' content='/i/b.jpg'><meta name='date' content='Fri, 01 May 2026 10:00:00 GMT'>",
        name, tale,
    )
    twitter = F.format_string('<meta name="twitter:title" content="%s"><meta name="twitter:image" content="c.jpg"><meta name="author" content="Cy">', name)
    title, heading = F.format_string("<title>\n %s </title><h1>no</h1>", name), F.format_string('<script type="application/ld+json">{"@type": "Event", "headline": "no"}</script><title> </title><h1><b>%s</b></h1>', name)
    body = nothing
    for segment, html in (("AUTOMOBILE", ld), ("BUILDING", og), ("FURNITURE", twitter), ("HOUSEHOLD", title), ("MACHINERY", heading)):
        body = F.when(F.col("c_mktsegment") == segment, html).otherwise(body)
    pages = customer.select("c_custkey", body.alias("html"), F.concat(F.lit("https://site.example/p/"), F.col("c_custkey")).alias("url"))
    found = article_metadata(pages)
    return found.select("c_custkey", "canonical_url", "title", "title_source", "author", "section", "image_url", "summary", F.date_format("published_at", "yyyy-MM-dd").alias("published"))
