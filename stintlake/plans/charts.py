"""Charts over session tables: weather panels, overtakes, results, classification, race control.

The functions take tables in the shapes of the session data; the registered queries run them on
the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlake.functions.results import flag_token, outcome
from stintlake.functions.text import hex_colour
from stintlake.operators.core import top1_per_key

from .registry import query

# fixed values: panels of the weather chart with label and unit
WEATHER = (
    ("air_temperature_c", "Air temperature", "celsius"),
    ("track_temperature_c", "Track temperature", "celsius"),
    ("humidity_percent", "Humidity", "percent"),
    ("pressure_mbar", "Pressure", "mbar"),
    ("wind_speed_mps", "Wind speed", "mps"),
    ("rainfall", "Rainfall", "boolean"),
)


def panels(df: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row a key, panel and measured value; nothing for what wasn't measured. One pass, no shuffle."""
    cell = [F.struct(F.lit(c).alias("panel"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.col(c).cast("double").alias("value")) for c, label, unit in fields]
    return df.select(*keys, F.inline(F.array(*cell))).where("value is not null")


def weather_chart(weather: DataFrame) -> DataFrame:
    return panels(weather, ["session_id", "observed_at", "wind_direction_degrees"], WEATHER)


def _named(df: DataFrame, entities: DataFrame, key: str, prefix: str) -> DataFrame:
    side = entities.select(F.col("id").alias(key), F.col("slug").alias(f"{prefix}_key"), F.col("display_name").alias(f"{prefix}_label"))
    return df.join(side, key, "left")


def overtake_chart(overtakes: DataFrame, entities: DataFrame, entries: DataFrame) -> DataFrame:
    """Overtakes with the names of both sides and the car of the one that overtakes. The cars of a session, as many as it has entries, meet
    its overtakes by the session alone, so rows that lie together by session are not shuffled for them; names come after."""
    car = F.struct("driver_number", "name_acronym", hex_colour(F.col("team_colour")).alias("color"))
    cars = entries.groupBy("session_id").agg(F.collect_list(car).alias("_cars"))
    own = F.filter("_cars", lambda c: c["driver_number"] == F.col("overtaking_driver_number"))
    rows = overtakes.join(cars, "session_id", "left").select(*overtakes.columns, F.explode_outer(own).alias("_car")).select(*overtakes.columns, "_car.name_acronym", "_car.color")
    return _named(_named(rows, entities, "overtaken_driver_entity_id", "overtaken"), entities, "overtaking_driver_entity_id", "overtaker")


def session_result_chart(results: DataFrame, entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Result rows with the outcome, the gap as text (a written gap before a number of seconds) and
    a key and label even where no driver is known."""
    car = entries.select("session_id", "driver_number", F.col("driver_entity_id").alias("_d"), F.col("team_entity_id").alias("_t"), "full_name", "team_name", "name_acronym", "team_colour")
    rows = results.join(car, ["session_id", "driver_number"], "left").withColumns({"driver_entity_id": F.coalesce("driver_entity_id", "_d"), "team_entity_id": F.coalesce("team_entity_id", "_t")})
    rows = _named(_named(rows, entities, "driver_entity_id", "driver"), entities, "team_entity_id", "team")
    number = F.col("driver_number").cast("string")
    return rows.select(
        "session_id", "driver_number", "position", F.coalesce("driver_key", F.concat(F.lit("car-"), number)).alias("key"), F.coalesce("driver_label", "full_name", F.concat(F.lit("Car "), number)).alias("label"),
        "team_key", F.coalesce("team_label", "team_name").alias("team_label"), F.col("name_acronym").alias("driver_acronym"), hex_colour(F.col("team_colour")).alias("color"),
        F.coalesce("gap_to_leader_text", F.col("gap_to_leader_seconds").cast("string")).alias("gap"), outcome(F.col("dsq"), F.col("dns"), F.col("dnf")).alias("status"),
    )


def classification_chart(results: DataFrame, entities: DataFrame, sessions: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Race results with the short name and colour of the driver's latest session of the race; failing
    that the driver's best code."""
    last = top1_per_key(
        sessions.select(F.col("id").alias("session_id"), "race_id", "starts_at").join(entries.where("driver_entity_id is not null"), "session_id"),
        ["race_id", "driver_entity_id"], [F.col("starts_at").desc_nulls_first(), F.col("session_id").asc()],
    ).select("race_id", "driver_entity_id", "name_acronym", "team_colour")
    code = top1_per_key(aliases.where("alias_type = 'driver_code' and enabled"), ["entity_id"], [F.col("confidence").desc_nulls_first(), F.col("alias").asc()]).select(F.col("entity_id").alias("driver_entity_id"), F.col("alias").alias("code"))
    rows = results.join(last, ["race_id", "driver_entity_id"], "left").join(code, "driver_entity_id", "left")
    rows = _named(_named(rows, entities, "driver_entity_id", "driver"), entities, "team_entity_id", "team")
    return rows.select(
        *[c for c in results.columns], "driver_key", "driver_label", "team_key", "team_label", F.coalesce("name_acronym", "code").alias("driver_acronym"), hex_colour(F.col("team_colour")).alias("color"),
        F.when(F.col("fastest_lap_rank") == 1, "timing-purple").alias("fastest_lap_token"),
    )


def annotations(messages: DataFrame) -> DataFrame:
    label = F.coalesce("message", "flag", "category")
    return messages.select("session_id", "id", F.coalesce(F.nullif("category", F.lit("")), F.lit("race_control")).alias("type"), label.alias("label"), F.col("lap_number").alias("lap"), "observed_at", flag_token(F.col("flag"), F.col("category"), label).alias("token"))


@query("lineitem", sql="""
WITH l AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_quantity AS quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, 'discount' AS panel, 'ratio' AS unit, discount AS value FROM l WHERE discount IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'tax', 'ratio', tax FROM l WHERE tax IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'quantity', 'pieces', quantity FROM l WHERE quantity IS NOT NULL""")
def weather_panels(lineitem):
    """DM11: measures unpivoted to panels, nothing where none was taken."""
    zero = lambda c, name: F.nullif(F.col(c), F.lit(0.0)).alias(name)
    rows = lineitem.select("l_orderkey", "l_linenumber", zero("l_discount", "discount"), zero("l_tax", "tax"), F.col("l_quantity").alias("quantity"))
    return panels(rows, ["l_orderkey", "l_linenumber"], [("discount", "", "ratio"), ("tax", "", "ratio"), ("quantity", "", "pieces")]).drop("label")


@query("orders", "customer", "nation", sql="""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'car-' || o_custkey ELSE lower(c_name) END AS key, coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END, n_name, 'Car ' || o_custkey) AS label,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'DSQ' WHEN o_orderstatus = 'P' THEN 'DNS' WHEN o_orderstatus = 'O' THEN 'DNF' ELSE 'CLASSIFIED' END AS status,
coalesce(CASE WHEN o_orderstatus = 'O' THEN '+1 LAP' END, o_custkey::VARCHAR) AS gap
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def session_results(orders, customer, nation):
    """DM17: result rows; customers with debts stand for drivers who are not known as entities."""
    results = orders.select(
        F.col("o_orderkey").alias("position"), F.lit(1).alias("session_id"), F.col("o_custkey").alias("driver_number"), F.lit(None).cast("long").alias("driver_entity_id"), F.lit(None).cast("long").alias("team_entity_id"),
        F.when(F.col("o_orderstatus") == "O", "+1 LAP").alias("gap_to_leader_text"), F.col("o_custkey").alias("gap_to_leader_seconds"),
        (F.col("o_orderpriority") == "1-URGENT").alias("dsq"), (F.col("o_orderstatus") == "P").alias("dns"), (F.col("o_orderstatus") == "O").alias("dnf"),
    )
    entries = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select(
        F.lit(1).alias("session_id"), F.col("c_custkey").alias("driver_number"), F.col("c_custkey").alias("driver_entity_id"), F.lit(None).cast("long").alias("team_entity_id"), F.col("n_name").alias("full_name"), F.lit("").alias("team_name"), F.lit("").alias("name_acronym"), F.lit("").alias("team_colour")
    )
    entities = customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("slug"), F.col("c_name").alias("display_name"))
    return session_result_chart(results, entries, entities).select(F.col("position").alias("o_orderkey"), "key", "label", "status", "gap")


@query("orders", "lineitem", sql="""
WITH e AS (SELECT l_orderkey, l_suppkey, l_returnflag, l_shipdate, l_linenumber FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey, l_linenumber, l_returnflag) AS n FROM e)
SELECT o_orderkey, o_totalprice, l_suppkey, l_returnflag FROM orders LEFT JOIN f ON l_orderkey = o_orderkey AND n = 1""")
def latest_entry(orders, lineitem):
    """DM19, JN04: a result with what its latest entry says, rows without one kept."""
    last = top1_per_key(lineitem, ["l_orderkey"], [F.col("l_shipdate").desc_nulls_last(), F.col("l_suppkey").asc(), F.col("l_linenumber").asc(), F.col("l_returnflag").asc()])
    return orders.join(last.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag"), "o_orderkey", "left").select("o_orderkey", "o_totalprice", "l_suppkey", "l_returnflag")


@query("lineitem", "supplier", "customer", "orders", sql="""
SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey, s_name AS overtaker, c_name AS overtaken FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN customer ON c_custkey = o_custkey""")
def overtakes(lineitem, supplier, customer, orders):
    """DM12: an event with the names of both of its sides."""
    rows = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    events = rows.select(
        F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_suppkey", "o_custkey", F.col("l_suppkey").alias("overtaking_driver_number"),
        F.concat(F.lit("s"), "l_suppkey").alias("overtaking_driver_entity_id"), F.concat(F.lit("c"), "o_custkey").alias("overtaken_driver_entity_id"),
    )
    named = lambda df, kind, key, name: df.select(F.concat(F.lit(kind), key).alias("id"), F.lower(name).alias("slug"), F.col(name).alias("display_name"))
    entities = named(supplier, "s", "s_suppkey", "s_name").unionByName(named(customer, "c", "c_custkey", "c_name"))
    entries = events.select("session_id", F.col("l_suppkey").alias("driver_number")).distinct().withColumns({"name_acronym": F.lit("ACR"), "team_colour": F.lit("00ff00")})
    chart = overtake_chart(events, entities, entries).where("color = '#00FF00'")
    return chart.select(F.col("session_id").alias("l_orderkey"), "l_linenumber", "l_suppkey", "o_custkey", F.col("overtaker_label").alias("overtaker"), F.col("overtaken_label").alias("overtaken"))


@query("orders", "customer", "nation", "lineitem", sql="""
WITH e AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, -l_linenumber, l_returnflag)) AS acronym FROM (SELECT l_orderkey, l_shipdate, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2, 3) GROUP BY 1)
SELECT o_orderkey, c_name AS driver, n_name AS team, coalesce(acronym, CASE WHEN c_acctbal > 0 THEN 'D' || c_custkey END) AS acronym, CASE WHEN o_orderpriority = '1-URGENT' THEN 'timing-purple' END AS token
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN e ON l_orderkey = o_orderkey""")
def classification(orders, customer, nation, lineitem):
    """DM19: results with the short name of the driver's latest session of the race, or else the best code."""
    held = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    results = held.select(F.col("o_orderkey").alias("race_id"), F.concat(F.lit("d"), "o_custkey").alias("driver_entity_id"), F.concat(F.lit("t"), "c_nationkey").alias("team_entity_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("fastest_lap_rank"))
    lines = lineitem.where("l_quantity > 20").groupBy("l_orderkey", "l_shipdate", "l_linenumber").agg(F.max("l_returnflag").alias("flag")).withColumn("id", F.concat_ws("/", "l_linenumber", "l_orderkey", "l_shipdate"))
    sessions = lines.select("id", F.col("l_orderkey").alias("race_id"), F.col("l_shipdate").alias("starts_at"))
    entries = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("id").alias("session_id"), F.concat(F.lit("d"), "o_custkey").alias("driver_entity_id"), F.col("flag").alias("name_acronym"), F.lit("none").alias("team_colour"))
    named = lambda df, kind, key, name: df.select(F.concat(F.lit(kind), key).alias("id"), F.lower(name).alias("slug"), F.col(name).alias("display_name"))
    aliases = customer.where("c_acctbal > 0").select(F.concat(F.lit("d"), "c_custkey").alias("entity_id"), F.concat(F.lit("D"), "c_custkey").alias("alias"), F.lit("driver_code").alias("alias_type"), F.lit(True).alias("enabled"), F.lit(1).alias("confidence"))
    entities = named(customer, "d", "c_custkey", "c_name").unionByName(named(nation, "t", "n_nationkey", "n_name"))
    chart = classification_chart(results, entities, sessions, entries, aliases)
    return chart.select(F.col("race_id").alias("o_orderkey"), F.col("driver_label").alias("driver"), F.col("team_label").alias("team"), F.col("driver_acronym").alias("acronym"), F.col("fastest_lap_token").alias("token"))


@query("orders", sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'flag-red' WHEN '2-HIGH' THEN 'flag-yellow' WHEN '3-MEDIUM' THEN 'virtual-safety-car' WHEN '5-LOW' THEN 'flag-black-white' ELSE CASE o_orderstatus WHEN 'O' THEN 'safety-car' WHEN 'F' THEN 'drs' END END AS token FROM orders""")
def race_control(orders):
    """DM18, ST11: tokens of race-control messages."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    flag = F.when(p == "1-URGENT", "red").when(p == "2-HIGH", "DOUBLE YELLOW").when(p == "5-LOW", "BLACK AND WHITE")
    message = F.when(p == "3-MEDIUM", "VSC deployed").when(s == "O", "Safety car in this lap").when(s == "F", "drs enabled").otherwise("track clear")
    rows = orders.select(F.lit(1).alias("session_id"), F.col("o_orderkey").alias("id"), flag.alias("flag"), F.lit("Other").alias("category"), message.alias("message"), F.lit(None).cast("int").alias("lap_number"), F.col("o_orderdate").alias("observed_at"))
    return annotations(rows).select(F.col("id").alias("o_orderkey"), "token")
