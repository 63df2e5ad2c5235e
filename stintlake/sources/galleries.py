"""Pictures of gallery pages with their captions and origin.

A picture belongs to the figure around it: the figure's link to a picture, or else its picture, with the figure's caption. A picture
outside of figures counts when it lies among the uploads. The first place of an address on a page is its place. Who took a picture and where
it comes from is read from the caption, or from the alternative text where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintlake.functions import text as T
from stintlake.functions.taxonomy import SPACES, picture_role

from .feeds import PICTURES, absolute

# fixed values: how a credit is written, who provides pictures, ids of pictures, and a note on rights
CREDIT = r"(?i)\(?Photo(?:graph)? by\s+([^()/]+?)/([^()]+?)\)"
PROVIDERS = (("caption", "red bull content pool", "red_bull_content_pool"), ("caption", "getty images", "getty_images"), ("agency", "lat images", "lat_images"), ("agency", "sutton", "sutton_images"), ("agency", "dppi", "dppi"))
ASSET_ID, RIGHTS = r"\b(SI[0-9]{9,}|[0-9]{10})\b", "editorial use only"
UPLOADS = "wp-content/uploads"
SOURCES = ("data-full-url", "data-src", "data-lazy-src", "src")

_PIECE = r"(?is)<(?:figure\b.*?</figure\s*>|img\b[^>]*>)"
_HIDDEN = r"(?is)<(?:!--.*?-->|(script|style)\b.*?</\1\s*>)"
_IMAGE = r"(?is)<img\b[^>]*>"


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with(rows: DataFrame, **values: Column) -> DataFrame:
    """Columns that are computed once a row: those of an inline array are, while columns of a projection are copied to where they
    are used, and beside a generator they are computed for each row it makes."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))


def _named(name: str) -> str:
    """The pattern of an attribute: its value, in quotes or bare, is the group."""
    return rf"""(?is)\s{name}\s*=\s*(?:"|'|)((?<=")[^"]*(?=")|(?<=')[^']*(?=')|(?<!["'])[^\s"'>]+)"""


def _decoded(text: Column) -> Column:
    """Character references decoded, where there may be any."""
    return _once(text, lambda x: F.when(F.contains(x, F.lit("&")), T.unescaped(x)).otherwise(x))


def _filled(tag: Column, name: str) -> Column:
    """An attribute's value; empty where there is none."""
    return _decoded(F.regexp_extract(tag, _named(name), 1))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, which may be empty; null where there is none."""
    return _decoded(F.get(F.regexp_extract_all(tag, F.lit(_named(name)), F.lit(1)), F.lit(0)))


def _spaced(html: Column) -> Column:
    return _once(F.trim(F.regexp_replace(_decoded(F.regexp_replace(html, "<[^>]*>", "")), SPACES, " ")), lambda x: F.when(x != "", x))


def _is_picture(url: Column) -> Column:
    return F.coalesce(F.substring_index(url, "?", 1).rlike(PICTURES), F.lit(False))


def _source(tag: Column) -> Column:
    """The best address of a picture, if that is a picture's."""
    given = {name: _once(_filled(tag, name), lambda x: F.when(x != "", x)) for name in SOURCES}
    # most pictures have no attribute of the lazy kinds
    lazy = F.coalesce(*[x for name, x in given.items() if name.startswith("data-")])
    best = F.coalesce(F.when(F.contains(F.lower(tag), F.lit("data-")), lazy), given["src"])
    return _once(best, lambda x: F.when(_is_picture(x), x))


def _last(values: Column) -> Column:
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def gallery_pictures(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, n, image_url, gallery_title, caption, alt_text, photographer, agency, origin_provider, origin_asset_id, content_role, rights_note); ``n`` counts a page's pictures
    from 1 in order."""
    all_of = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = _with(pages.select(F.col(id_col), F.col(url_col).alias("_page"), F.col(html_col).alias("_given")), _html=F.regexp_replace("_given", _HIDDEN, " "))
    title = F.get(F.array_compact(F.transform(all_of(F.col("_html"), r"(?is)<h1\b.*?</h1\s*>"), _spaced)), F.lit(0))
    rows = _with(rows, gallery_title=title, _pieces=all_of(F.col("_html"), _PIECE)).select(id_col, "_page", "gallery_title", F.posexplode("_pieces").alias("_at", "_piece"))
    figure = F.substring("_piece", 2, 1).isin("f", "F")
    tags = F.transform(F.when(figure, all_of(F.col("_piece"), _IMAGE)).otherwise(F.array("_piece")), lambda t: F.struct(_source(t).alias("url"), t.alias("tag")))
    pictures = _once(F.filter(tags, lambda p: p["url"].isNotNull()), lambda ps: F.struct(_last(F.transform(ps, lambda p: p["url"])).alias("shown"), _attribute(F.try_element_at(ps, F.lit(-1))["tag"], "alt").alias("alt")))
    links = F.transform(all_of(F.col("_piece"), r"(?is)<a\s[^>]*>"), lambda t: _once(_filled(t, "href"), lambda x: F.when(_is_picture(x), x)))
    said = _spaced(F.try_element_at(all_of(F.col("_piece"), r"(?is)<figcaption\b.*?</figcaption\s*>"), F.lit(-1)))
    rows = _with(rows, _figure=figure, _img=pictures, _link=F.when(figure, _last(links)), _said=F.when(figure, said)).drop("_piece")
    link, alt = F.coalesce("_link", "_img.shown"), F.col("_img.alt")
    found = _with(rows.where(link.isNotNull()), image_url=absolute(F.col("_page"), link))
    found = found.where(F.col("image_url").isNotNull() & (F.col("_figure") | F.col("image_url").contains(UPLOADS)))
    found = found.select(id_col, "gallery_title", "_at", "image_url", F.when(F.col("_figure"), F.col("_said")).otherwise(alt).alias("_caption"), alt.alias("alt_text"))
    once = found.groupBy(id_col, "image_url").agg(F.min_by(F.struct("_at", "gallery_title", "_caption", "alt_text"), "_at").alias("p")).select(id_col, "image_url", "p.*")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("_at"))
    caption = F.coalesce(F.nullif("_caption", F.lit("")), "alt_text")
    out = once.withColumns({"n": place, "caption": caption})
    credit = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("caption", CREDIT, k), r"\s+", " ")), F.lit(""))
    out = out.withColumns({"photographer": credit(1), "agency": credit(2)})
    provider = F.coalesce(*[F.when(F.contains(F.lower(of), F.lit(words)), name) for of, words, name in PROVIDERS])
    asset = F.nullif(F.regexp_extract("caption", ASSET_ID, 1), F.lit(""))
    return out.select(id_col, "n", "image_url", "gallery_title", "caption", "alt_text", "photographer", "agency", provider.alias("origin_provider"), asset.alias("origin_asset_id"), picture_role(F.col("caption")).alias("content_role"), F.when(F.contains(F.lower("caption"), F.lit(RIGHTS)), RIGHTS).alias("rights_note"))

