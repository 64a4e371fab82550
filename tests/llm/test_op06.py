from pyspark.sql import functions as F

from finfacts.checks.compare import difference
from finfacts.llm import op06_url_filters as op


def test_equals_sql(spark, oracle, sf_dir):
    assert difference(spark, oracle, "op6", op.op6_url_filters, op.ORACLE, sf_dir) is None


def test_rules_and_odd_urls(spark):
    urls = [
        (1, "https://A.Example.NET/en/x"), (2, "https://a.example.net/fr/x"), (3, "http://net/"), (4, "http://x.net"),
        (5, "http://notnet/x"), (6, "ftp://w.org/fr/?q"), (7, "http://example.com/de/#x"), (8, None), (9, ""), (10, "no scheme"),
        (11, "a://b://c/d"), (12, "http://x?y://z.net/"), (13, "http://spam-farm.example.org/en/"), (13, "http://spam-farm.example.org/en/"),
        (14, "http://spam-farm.example.org/fr/"), (15, "x\ny://h\n/p"),
    ]
    got = [tuple(r) for r in op.judge(spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit("clash"), "html": F.lit(None).cast("string")}))
           .select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/fr/x", "net/", "block"),
        (3, "net", "/", "net/", "block"), (4, "x.net", "", None, "allow"), (5, "notnet", "/x", None, "allow"),
        (6, "w.org", "/fr/", "org/fr/", "allow"), (7, "example.com", "/de/", "example.com/de/", "block"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "b:", "//c/d", None, "allow"),
        (12, "x", "", None, "allow"), (13, "spam-farm.example.org", "/en/", None, "block"),
        (13, "spam-farm.example.org", "/en/", None, "block"), (14, "spam-farm.example.org", "/fr/", "org/fr/", "allow"),
        (15, "h\n", "/p", None, "allow"),
    ], key=str)


def test_cascade_is_exact(spark):
    rows = spark.range(5000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), "id")
    listed = rows.where("id % 3 = 0").select("key").unionAll(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    assert len(op.cascade(op.universe(rows, ["key"], listed))) >= 2
    out = op.marked(rows, ["key"], listed)
    assert out.where("on_list <> (id % 3 = 0)").count() == 0
    # 1,667 listed keys in three shards.
    sharded = op.marked(rows, ["key"], listed, shard_keys=600)
    assert sharded.where("on_list <> (id % 3 = 0)").count() == 0
    for frame in (out, sharded):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and "Python" not in text


def test_levels_grow_with_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, path = op.host_of("url"), op.path_of("url")
    rows = pages.select(op.address_of(host, path).alias("address"), host.alias("host"), op.site_of(host).alias("site"),
                        op.stuffed("html").alias("stuffed"))
    known = op.universe(rows, ["address", "host", "site"], op.block_list(rows))
    # Several copies of the table under other addresses: more listed keys, and every one of them is found.
    copies = F.explode(F.sequence(F.lit(1), F.lit(400)))
    wide = known.select("key", "listed", copies.alias("n")).select(F.concat("key", F.col("n").cast("string")).alias("key"), "listed")
    wide.cache()
    levels = op.cascade(wide)
    assert len(levels) >= 3 and levels[0].bits >= op.BITS_PER_KEY * wide.where("listed").count()
    assert wide.where(F.col("listed") != op.contains(levels, "key")).count() == 0


def test_list_of_addresses_hosts_and_sites(spark):
    stuffed = " | ".join("word" for _ in range(op.STUFFED + 1))
    rows = [
        (1, "http://a.b.org/x?q=1", stuffed), (2, "https://A.b.org/x#y", "prose"), (3, "http://a.b.org/x/", "prose"),
        (4, "http://h.org", stuffed), (5, "http://h.org/", None), (6, "http://h.org/p", ""), (7, None, stuffed), (8, "", stuffed),
        (9, "http://www.spam-farm.example.org/", "prose"), (10, "http://spam-farm.example.org.x/", "prose"),
        (11, "http://k.org/" + "y" * 200_000, stuffed), (12, "http://k.org/" + "y" * 199_999, stuffed[:-7]),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.page_id for r in op.judge(pages).where("on_list").collect()) == [1, 2, 4, 5, 9, 11]
    listed = spark.createDataFrame([("h.org",), ("a.b.org",), ("k.org/",)], "key string")
    assert sorted(r.page_id for r in op.judge(pages.drop("html"), listed).where("on_list").collect()) == [1, 2, 3, 4, 5, 6]


def test_empty_list_and_table(spark):
    rows = spark.createDataFrame([(1, "http://h/", None)], "page_id long, url string, html string")
    assert op.judge(rows).first().verdict == "allow"
    assert op.judge(rows, rows.select(F.lit("k").alias("key")).limit(0)).first().verdict == "allow"
    assert op.judge(rows.limit(0)).count() == 0
