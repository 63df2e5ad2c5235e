"""Metadata of article pages in odd shapes."""

import json

from stintlake.sources.articles import article_metadata

BASE = "https://e.x/news/a?x=1"


def one(spark, html, url=BASE):
    return article_metadata(spark.createDataFrame([(html, url)], "html string, url string")).first()


def test_deep_graphs_and_odd_fields(spark):
    node = {"@type": "BlogPosting", "headline": "A &amp; B", "image": [[], [["//cdn.x/i.png"]]], "author": {"name": " Jo "}, "articleSection": 7, "articleBody": "<p>x</p>"}
    for _ in range(30):
        node = {"@graph": [{"@type": None}, [node]]}
    row = one(spark, f"<html lang='de'><script type='application/ld+json'>{json.dumps(node)}</script>")
    assert (row.title, row.title_source, row.author, row.section, row.body_excerpt, row.language) == ("A & B", "json_ld", "Jo", None, "x", "de")
    assert (row.image_url, row.image_source, row.canonical_url) == ("https://cdn.x/i.png", "json_ld", "https://e.x/news/a")


def test_pages_that_say_nothing(spark):
    for html in (None, "", "<title></title>", '<meta name="x"><meta content="y">', '<script type="application/ld+json">[1, "a", null]</script>'):
        row = one(spark, html)
        assert (row.title, row.title_source, row.image_url, row.published_at) == (None, None, None, None)
    assert one(spark, "<h1>T</h1>", None).canonical_url is None
    assert article_metadata(spark.createDataFrame([], "html string, url string")).count() == 0
