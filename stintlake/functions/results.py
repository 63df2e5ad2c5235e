"""Result and timing vocabularies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: beginnings of a status, after white space and case are evened out
NOT_STARTED = ("did not start", "did not qualify", "did not prequalify", "withdrawn", "withdrew")
DISQUALIFIED = ("disqualified", "excluded")
FINISHED = ("finished", "classified", "lapped")

# fixed values: tokens of tyre compounds and of mini-sector codes
TYRES = {"SOFT": "tyre-soft", "MEDIUM": "tyre-medium", "HARD": "tyre-hard", "INTERMEDIATE": "tyre-intermediate", "WET": "tyre-wet"}
SEGMENTS = {0: "segment-unavailable", 2048: "timing-yellow", 2049: "timing-green", 2051: "timing-purple", 2064: "pit-lane"}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def status_class(status: Column) -> Column:
    """dns, dsq, classified or dnf. A null or blank status counts as a start without a finish."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(status, F.lit("")), r"\s+", " ")))
    begins = lambda words: F.reduce(F.array(*[F.lit(w) for w in words]), F.lit(False), lambda hit, w: hit | F.startswith(s, w))
    return F.when(begins(NOT_STARTED), "dns").when(begins(DISQUALIFIED), "dsq").when(s.isin(*FINISHED) | s.startswith("+"), "classified").otherwise("dnf")


def tyre_token(compound: Column) -> Column:
    return _lookup(TYRES, F.upper(F.trim(compound)))


def segment_tokens(codes: Column) -> Column:
    """Mini-sector codes as (index from 1, code, token); a null array gives an empty one."""
    token = lambda v: F.when(v.isNull(), "segment-unavailable").otherwise(F.coalesce(_lookup(SEGMENTS, v), F.lit("segment-unknown")))
    return F.coalesce(F.transform(codes.cast("array<int>"), lambda v, k: F.struct((k + 1).alias("index"), v.alias("code"), token(v).alias("token"))), F.array().cast("array<struct<index:int,code:int,token:string>>"))


def flag_token(flag: Column, category: Column, label: Column) -> Column:
    """The token of a race-control message: its flag decides first, then what the text speaks of."""
    f = F.upper(F.coalesce(flag, F.lit("")))
    said = F.upper(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(label, F.lit(""))))
    out = F.when(f.rlike("CHEQUERED|CHECKERED"), "flag-chequered").when(f.contains("BLACK AND WHITE"), "flag-black-white").when(f.startswith("BLACK"), "flag-black").when(f == "RED", "flag-red")
    for colour in ("yellow", "green", "blue"):
        out = out.when(f.contains(colour.upper()), f"flag-{colour}")
    return out.when(said.rlike("VIRTUAL SAFETY CAR|VSC"), "virtual-safety-car").when(said.contains("SAFETY CAR"), "safety-car").when(said.contains("DRS"), "drs")


def outcome(dsq: Column, dns: Column, dnf: Column) -> Column:
    """Of a session result's marks the gravest; a missing mark doesn't count."""
    mark = lambda c: F.coalesce(c, F.lit(False))
    return F.when(mark(dsq), "DSQ").when(mark(dns), "DNS").when(mark(dnf), "DNF").otherwise("CLASSIFIED")
