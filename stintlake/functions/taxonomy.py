"""Ordered keyword taxonomies of titles: the first rule that holds names the class.

Rules are data: (order, class, kind of match, phrase). ``classify`` decides one title in an expression; ``classify_by_terms``
looks phrases of any number of rules up as an equi-join on the title's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# fixed values: classes of stories in order, with the phrases that their titles contain
STORY_CLASSES = {
    "academy_feeder": ("academy", "junior team", "rookie test"),
    "regulation": ("regulation", "regulations", "technical directive", "sporting directive", "penalty", "virtual safety car", "vsc", "rule change", "rules change", "new rule", "new rules"),
    "team_business": ("licensing", "partner", "sponsor", "budget", "commercial", "brand management", "management structure"),
    "personnel": (
        "joins", "hires", "appoints", "appointed", "chief technical", "tech chief", "team principal", "driver line up", "driver lineup", "contract extension",
        "extends with", "continue with the team", "until the end of 2030", "injury recovery", "dropped him", "leaving the team",
    ),
    "technical": ("upgrade", "floor", "aero", "technical", "development", "design"),
    "media_marketing": ("collection", "livery", "creator", "merchandise", "launch event", "stickers", "hospitality", "time pieces"),
    "sporting": ("grand prix", "qualifying", "practice recap", "race recap", "race report", "race results", "sprint", "calendar", "fp1", "fp2", "fp3"),
}
STORY_OTHERWISE = "general"
# fixed values: classes of decision documents in order; a phrase that begins with ^ opens the title
DOCUMENT_CLASSES = {
    "car_presentation": ("car presentation submissions",), "parc_ferme": ("parts and parameters", "parc ferme"), "stewards": ("^decision ", "^infringement ", "^summons "),
    "starting_grid": ("starting grid",), "classification": ("classification",), "scrutineering": ("scrutineering",), "power_unit": ("pu element", "power unit"),
    "race_director": ("race director",), "entry_list": ("entry list",), "tyre": ("pirelli",),
}
DOCUMENT_OTHERWISE = "other"


# fixed values: what pictures show, in order, with words of their captions
PICTURE_ROLES = {
    "podium": ("podium", "trophy", "champagne"), "winner": ("winner", "wins the", "victory", "parc ferme"), "race_start": ("at the start", "race start", "turn one", "first corner"),
    "incident": ("crash", "collision", "contact", "spins", "spin"), "pit_stop": ("pit stop", "pitstop", "pit lane"), "overtake": ("overtake", "passes", "battle for", "fight for"),
    "technical_detail": ("front wing", "rear wing", "floor", "technical detail"), "celebration": ("celebrates", "celebration"), "garage": ("garage", "mechanics"), "driver_action": ("driving", "on track"),
}
PICTURE_OTHERWISE = "generic"
# white space that isn't one blank: what a replacement by a blank would change
SPACES = r"\s(?:\s+|(?<! ))"


def picture_role(caption: Column) -> Column:
    """The first role one of whose phrases the caption contains, case and white space aside."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), SPACES, " ")))
    return T.bound(text, lambda known: _first_class(known, PICTURE_ROLES, PICTURE_OTHERWISE))


def classify(title: Column, classes: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first class one of whose phrases the title's normal form contains, also inside words; ``otherwise`` for a null title too."""
    return T.bound(T.normal(title), lambda norm: _first_class(norm, classes, otherwise))


def _first_class(norm: Column, classes: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    def holds(phrase: str) -> Column:
        return norm.startswith(phrase[1:]) if phrase[0] == "^" else F.contains(norm, F.lit(phrase))

    rules = []
    for name, phrases in classes.items():
        rule = F.lit(False)
        for phrase in phrases:
            rule = rule | F.coalesce(holds(phrase), F.lit(False))
        rules.append((rule, name))
    return T.cascade(rules, otherwise)


def story_class(title: Column) -> Column:
    return classify(title, STORY_CLASSES, STORY_OTHERWISE)


def document_class(title: Column) -> Column:
    return classify(title, DOCUMENT_CLASSES, DOCUMENT_OTHERWISE)


def classify_by_terms(items: DataFrame, rules: DataFrame, text: Column, id_col: str, otherwise: str) -> DataFrame:
    """(id, class, phrase) of items by rules (place, class, phrase, excludes): of the classes whose phrase is among the
    item's whole words, the one of the smallest place, with its smallest phrase. A rule that excludes strikes its class
    from the items that contain its phrase.

    A rule is looked up by the first word of its phrase, as an equi-join with the words of the items, and the words that follow are compared in
    place: a text is read once, no word sequence is formed that no rule begins, and thousands of rules are one join."""
    begun = rules.withColumns({"_first": F.substring_index("phrase", " ", 1), "_size": F.size(F.split("phrase", " "))})
    words = items.select(F.col(id_col), F.split(T.normal(text), " ").alias("_w")).select(id_col, "_w", F.posexplode("_w").alias("_k", "_first"))
    met = words.join(begun, "_first").where((F.col("_size") == 1) | (F.array_join(F.slice("_w", F.col("_k") + 1, F.col("_size")), " ") == F.col("phrase")))
    best = F.min(F.when(~F.col("excludes"), F.struct("place", "phrase"))).alias("f")
    classes = met.groupBy(id_col, "class").agg(best, F.coalesce(F.bool_or("excludes"), F.lit(False)).alias("struck"))
    left = classes.where("f is not null and not (struck and class is not null)").select(id_col, F.struct("f.place", "f.phrase", "class").alias("f"))
    first = left.groupBy(id_col).agg(F.min("f").alias("f"))
    return items.select(id_col).join(first, id_col, "left").select(id_col, F.coalesce("f.class", F.lit(otherwise)).alias("class"), F.col("f.phrase").alias("phrase"))
