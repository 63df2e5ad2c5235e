"""Every registered query against its SQL on a small scale, and golden cases of the building blocks."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from stintlake import plans
from stintlake.functions import text as T
from stintlake.operators import core, lookup
from stintlake.operators.downsample import greedy_downsample
from stintlake.plans.entities import alias_mentions
from stintlake.sources import tables as S

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    return value.isoformat() if isinstance(value, (dt.datetime, dt.date)) else value


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    rows = sorted(([plain(v) for v in r] for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_downsampling_depends_on_kept_samples(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(milliseconds=ms), k) for k, ms in enumerate([0, 300, 1100, 1900, 2100])]
    df = spark.createDataFrame(rows, "driver int, ts timestamp_ntz, k long")
    kept = greedy_downsample(df, ["driver"], "ts", "k", 1).collect()
    assert sorted(r.k for r in kept) == [0, 2, 4]


def test_asof_boundaries(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, at(10), 1), (1, at(20), 2), (2, at(5), 3)], "d int, ts timestamp_ntz, id int")
    right = spark.createDataFrame([(1, at(10), 7), (1, at(10), 8), (1, at(11), 9)], "d int, ts timestamp_ntz, id int")
    plain_ = {r.id: r.r_id for r in core.asof_join(left, right, ["d"], "ts", "id").collect()}
    assert plain_ == {1: 8, 2: 9, 3: None}
    bound = {r.id: r.r_id for r in core.asof_join(left, right, ["d"], "ts", "id", 3).collect()}
    assert bound == {1: 8, 2: None, 3: None}


def test_redirects_reach_the_end_and_survive_cycles(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101), (101, 100)], "a int, b int")
    got = {r.a: r.b for r in core.follow_redirects(links, "a", "b").collect()}
    assert all(got[k] == 20 for k in range(20)) and got[100] in (100, 101)


def test_pages_and_merges(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "k int")
    rows = core.page(df, [F.col("k").desc()], 2, 2).collect()
    assert [(r.k, r.total, r.next_offset) for r in rows] == [(2, 5, 4), (1, 5, 4)]
    assert core.page(df, [F.col("k").asc()], 4, 2).first().next_offset is None
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "d")]))
    assert sorted(map(tuple, core.append_unseen(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, core.replace_partitions(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d"), (3, "d")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Sergio Pérez – No. 11", "ff8000", "the red car"), (None, "#12", "")], "a string, c string, t string")
    one, two = df.select(T.normal(F.col("a")).alias("n"), T.slug(F.col("a")).alias("s"), T.hex_colour(F.col("c")).alias("h"), T.tokens(F.col("t"), ["the"]).alias("t")).collect()
    assert (one.n, one.s, one.h, one.t) == ("sergio perez no 11", "sergio-perez-no-11", "#FF8000", ["red", "car"])
    assert two.n is None and two.h is None and two.t == []
    half = spark.range(1).select(T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), T.has_phrase(F.lit("ab cd"), F.lit("b")).alias("p")).first()
    assert half.j == 0.5 and not half.p


def test_tolerant_reading(spark):
    df = spark.createDataFrame([("12",), ("",), ("\\N",), ("x",), ("[1.5, null]",), ("+1 LAP",)], "v string")
    assert [r.v for r in df.select(S.tolerant(F.col("v"), "int").alias("v")).collect()] == [12, None, None, None, None, None]
    parts = df.select(*[c.alias(k) for k, c in S.scalar_or_array(F.col("v")).items()]).collect()
    assert parts[0].number == 12 and parts[4].parts == [1.5, None] and parts[5].label == "+1 LAP"
    times = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("Wed, 01 May 2024 12:00:00 +0200",), ("Wed, 01 May 2024 10:00:00 GMT",), ("never",)], "v string").select(S.utc_timestamp(F.col("v")).cast("string").alias("v"))
    assert [r.v for r in times.collect()] == ["2024-05-01 10:00:00"] * 3 + [None]


def test_feed_and_links(spark):
    xml = "<rss><item><guid>g1</guid><title><![CDATA[A & B]]></title><link>https://e.x/a</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate><category>c</category></item><item><title>T</title><link>u</link></item></rss>"
    one, two = S.feed_items(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert (one.external_id, one.title, one.categories) == ("g1", "A & B", ["c"]) and len(two.external_id) == 64
    html = '<a href="/news/x?q=1">x</a><a href="https://e.x/news/x/">y</a><a href="https://other/news/x">z</a>'
    assert [r.url for r in S.article_links(spark.createDataFrame([(html,)], "h string"), "h", "https://e.x", "/news/").collect()] == ["https://e.x/news/x"]


def test_redirects_of_any_length_and_into_cycles(spark):
    rows = [(k, k + 1) for k in range(100)] + [(203, 201), (201, 202), (202, 200), (200, 201), (300, 300), (310, None)]
    got = {r.a: r.b for r in core.follow_redirects(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()}
    assert got == {k: 100 for k in range(100)} | {k: 200 for k in range(200, 204)} | {300: 300, 310: None}


def test_alias_of_five_words(spark):
    texts = spark.createDataFrame([(1, "News of The Royal Racing Club Nord today"), (2, "Royal Racing"), (3, None)], "id int, text string")
    entities = spark.createDataFrame([(7, "The Royal Racing Club Nord"), (8, "racing"), (9, None)], "entity int, alias string")
    got = alias_mentions(texts, "text", entities, "alias").collect()
    assert sorted((r.id, r.entity) for r in got) == [(1, 7), (1, 8), (2, 8)]


def test_greedy_downsampling_streams_over_batches(spark):
    base, gap = dt.datetime(2024, 1, 1), 7
    rows = [(None if k % 5 == 0 else k % 2, base + dt.timedelta(seconds=k * k % 997), k) for k in range(700)] + [(1, None, 900), (1, None, 901)]
    want, last = [], {}
    for d, t, k in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or base, r[2])):
        if last.get(d) is None or (t - last[d]).total_seconds() >= gap:
            want.append(k)
            last[d] = t
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = greedy_downsample(spark.createDataFrame(rows, "driver int, ts timestamp_ntz, k long"), ["driver"], "ts", "k", gap)
        assert sorted(r.k for r in out.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_season_queries_over_all_keys(spark):
    orders = S.table(spark, FOLDER, "orders")
    drivers, seasons = (plans.QUERIES[n](spark, FOLDER) for n in ("season_results_all", "facet_season_results_all"))
    assert drivers.count() == orders.count() and drivers.select("o_custkey").distinct().count() == orders.select("o_custkey").distinct().count()
    assert seasons.count() == orders.where("o_orderdate is not null").count() and seasons.select("season").distinct().count() > 1


def test_exclusive_nearest_takes_each_row_once(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, 10, day(1)), (1, 11, day(1, 6)), (1, 12, day(9)), (2, 13, day(1)), (1, 14, None)], "g int, id long, at timestamp_ntz")
    right = spark.createDataFrame([(1, 20, day(1, 5)), (1, 21, day(2, 12)), (1, 22, day(8)), (1, 23, day(10)), (3, 24, day(1))], "g int, id long, at timestamp_ntz")
    got = {(r.left_id, r.right_id) for r in lookup.exclusive_nearest(left, right, "g", "at", 36).collect()}
    assert got == {(10, 20), (11, 21), (12, 22)}
    assert lookup.exclusive_nearest(left.limit(0), right, "g", "at", 36).count() == 0


def test_exclusive_dates_equal_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/orders.parquet").toPandas().sort_values(["o_orderdate", "o_orderkey"])
    want = set()
    for _, g in rows.groupby("o_custkey"):
        free = [(r.o_orderkey, r.o_orderdate) for r in g[g.o_orderstatus == "F"].itertuples()]
        for r in g[g.o_orderstatus == "O"].itertuples():
            near = [(abs(t - r.o_orderdate), n) for n, (_, t) in enumerate(free) if abs(t - r.o_orderdate) <= dt.timedelta(hours=36)]
            if near:
                want.add((r.o_orderkey, free.pop(min(near)[1])[0]))
    assert {(r.left_id, r.right_id) for r in plans.QUERIES["exclusive_dates"](spark, FOLDER).collect()} == want


def test_newest_generation_and_late_rows(spark, tmp_path):
    from stintlake.streaming import incremental

    schema = "k int, version int, note string, at timestamp"
    write = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    write("a", [(1, 1, "x", at(1)), (1, 1, "y", at(1)), (2, 5, "z", at(1))])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    merge = lambda: {(r.k, r.version, r.note) for r in incremental.run_merge(read(), f"{tmp_path}/out", ["k"], "version").collect()}
    assert merge() == {(1, 1, "y"), (2, 5, "z")} == merge()
    counts = lambda: {(r.start.hour, r.n) for r in incremental.closed_windows(read(), "at", ["k"], "1 hour", "1 hour", f"{tmp_path}/win").where("k < 3").collect()}
    counts()
    write("b", [(1, 2, "n", at(9)), (2, 4, "old", at(9))])
    assert merge() == {(1, 2, "n"), (2, 5, "z")} == merge()
    counts()
    write("c", [(1, 3, "late", at(1)), (9, 1, "q", at(20))])
    assert counts() >= {(1, 2), (1, 1)} and (1, 3) not in counts()
