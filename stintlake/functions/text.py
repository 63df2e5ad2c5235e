"""Text expressions: normal form, tokens, similarity, cascades. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented Latin letters and the letters they fold to
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normal(text: Column) -> Column:
    """Lower case, accents folded, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *FOLD), "[^a-z0-9]+", " "))


def slug(text: Column, size: int = 90) -> Column:
    return F.substring(F.regexp_replace(normal(text), " ", "-"), 1, size)


def tokens(text: Column, stop: list[str]) -> Column:
    return F.filter(F.array_distinct(F.split(normal(text), " ")), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whole-token containment of one normal form in another."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cascade(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds decides."""
    out = None
    for rule, name in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out.otherwise(F.lit(otherwise))


# fixed values: the common character references
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """The common character references decoded, ``&amp;`` last."""
    for reference, char in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    """Mark-up out, the common entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "))


def hex_colour(text: Column) -> Column:
    bare = F.upper(F.ltrim(F.trim(text), F.lit("#")))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), bare))
