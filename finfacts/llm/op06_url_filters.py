"""URL filters: a Bloom filter cascade answers exact list membership for every key of the corpus.

Level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through by chance, level 3 the
listed keys that level 2 lets through, and so on until a level has no false positive among the corpus's keys.
For keys of that universe the answer is then exact, from bits alone: no join with the list. Everything is a
DataFrame expression; the levels are read as scalar subqueries. Levels stay under a fixed size: a longer list is cut
by key hash into shards, each with a cascade of its own, and the rows are marked shard after shard.

A url is looked up by three keys: its address (host and path), its host, and its site (the host's last three labels).
The block list is a table of such keys. The query's list holds the sites of ``LISTED_SITES`` and the addresses whose
page, fetched under any scheme, query or fragment, is stuffed with keywords; it grows with the table.

Nulls, urls without ``://`` and empty urls have an empty host and path, no key, fit no rule and are on no list. A null
or empty page is no evidence. Urls of any length are read whole. Repeated urls each keep their row. An empty list has no
level and blocks nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): the host up to the first slash, then the path's beginning.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Sites on the block list, as keys.
LISTED_SITES = tuple(f"{name}.example.{end}" for name in (
    "adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
#: A page with this many separators `` | `` is a list of keywords, not prose.
SEPARATOR, STUFFED = " | ", 20
#: Bits a key and probes a key: about 1 % false positives a level, so a few levels end the cascade.
BITS_PER_KEY, PROBES = 10, 7
#: Listed keys of one shard. A level is one array value, sent to every task: 40 million keys are 50 MB.
SHARD_KEYS = 40_000_000


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(host: Column, path: Column) -> Column:
    """Host and path; no path is the path ``/``, so that no address is taken for a host."""
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path)))


def site_of(host: Column) -> Column:
    return F.when(host != "", F.substring_index(host, ".", -3))


def stuffed(page: str) -> Column:
    """Whether a page's text is stuffed with keywords."""
    bars = F.length(page) - F.length(F.replace(F.col(page), F.lit(SEPARATOR), F.lit("")))
    return F.coalesce(bars >= STUFFED * len(SEPARATOR), F.lit(False))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or one of its parents, and begins the path."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, start = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row: array of 64-bit words
    bits: int


def _positions(key: str, level: int, bits: int) -> list[Column]:
    first = F.xxhash64(F.col(key), F.lit(2 * level))
    step = F.xxhash64(F.col(key), F.lit(2 * level + 1))
    # Both are reduced first, so that no probe overflows.
    first, step = F.pmod(first, F.lit(bits)), F.pmod(step, F.lit(bits))
    return [F.pmod(first + F.lit(j) * step, F.lit(bits)) for j in range(PROBES)]


def _encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the level's words; a word's bits are joined with OR before and after the shuffle."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_positions("key", level, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("value"))
    dense = spark.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    pairs = F.sort_array(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0).cast("long")).alias("value"))))
    return dense.agg(F.transform(pairs, lambda p: p["value"]).alias("words"))


def _passes(level: Level, key: str, number: int) -> Column:
    words = level.words.scalar()
    set_bits = [
        F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63).cast("int")) == 1
        for at in _positions(key, number, level.bits)
    ]
    return reduce(Column.__and__, set_bits)


def cascade(keys: DataFrame) -> list[Level]:
    """Levels for distinct keys: ``key``, and ``listed``, whether it is to be found."""
    inside, outside = keys.where("listed"), keys.where("not listed")
    levels: list[Level] = []
    while (n := inside.count()) > 0:
        bits = -(-max(n * BITS_PER_KEY, 64) // 64) * 64
        level = Level(stored(_encode(inside, len(levels), bits), f"level{len(levels)}"), bits)
        wrong = stored(outside.where(_passes(level, "key", len(levels))), f"wrong{len(levels)}")
        levels.append(level)
        inside, outside = wrong, inside
    return levels


def contains(levels: list[Level], key: str) -> Column:
    """Exact membership for a key of the cascade's universe."""
    found = F.lit(False)
    for number in reversed(range(len(levels))):
        found = _passes(levels[number], key, number) & ~found
    return found


def universe(rows: DataFrame, keys: Sequence[str], listed: DataFrame) -> DataFrame:
    """The distinct values of the columns ``keys`` and whether ``listed`` (column ``key``) has them. Values are told
    apart in the tasks first, so a hot host is one row a task before the shuffle."""
    own = rows.select(F.explode(F.array(*keys)).alias("key"), F.lit(True).alias("own"), F.lit(False).alias("listed"))
    names = listed.select("key", F.lit(False).alias("own"), F.lit(True).alias("listed"))
    found = own.unionAll(names).where("key is not null").groupBy("key")
    return found.agg(F.bool_or("own").alias("own"), F.bool_or("listed").alias("listed")).where("own").drop("own")


def marked(rows: DataFrame, keys: Sequence[str], listed: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``rows`` with boolean ``on_list``: whether the value of one of the columns ``keys`` is among ``listed``."""
    known = stored(universe(rows, keys, listed), "keys")
    shards = max(1, -(-known.where("listed").count() // shard_keys))
    shard = lambda key: F.pmod(F.xxhash64(F.col(key), F.lit(-1)), F.lit(shards))
    rows = rows.withColumn("on_list", F.lit(False))
    for number in range(shards):
        levels = cascade(known.where(shard("key") == number))
        hits = [(shard(key) == number) & contains(levels, key) for key in keys]
        rows = rows.withColumn("on_list", F.col("on_list") | F.coalesce(*[F.when(hit, True) for hit in hits], F.lit(False)))
        if number + 1 < shards:
            rows = stored(rows, f"marked{number}")
    return rows


def block_list(rows: DataFrame) -> DataFrame:
    """``key`` of the query's list: the listed sites, and the ``address`` of every row whose page is ``stuffed``."""
    sites = rows.sparkSession.createDataFrame([(s,) for s in LISTED_SITES], "key string")
    return sites.unionAll(rows.where("stuffed").select(F.col("address").alias("key")))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, on_list of every page.

    ``listed`` has the block list in ``key``: addresses, hosts and sites. By default it is ``block_list`` of the pages,
    whose text is then read from ``html``.
    """
    host, path = host_of("url"), path_of("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), address_of(host, path).alias("address"),
                        site_of(host).alias("site"), *([stuffed("html").alias("stuffed")] if listed is None else []))
    rows = stored(rows, "urls")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("on_list"), "block").otherwise("allow")
    return marked(rows, ["address", "host", "site"], block_list(rows) if listed is None else listed).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "on_list")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_REST = "coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '')"
ORACLE = f"""
WITH u AS (
  SELECT page_id, html, {_REST} AS rest FROM pages
), p AS (
  SELECT page_id, html,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), a AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE path WHEN '' THEN '/' ELSE path END END AS address FROM p
), l AS (
  SELECT DISTINCT address FROM a
  WHERE address IS NOT NULL AND length(html) - length(replace(html, '{SEPARATOR}', '')) >= {STUFFED * len(SEPARATOR)}
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    array_to_string(string_split(host, '.')[-3:], '.') IN ({", ".join(f"'{s}'" for s in LISTED_SITES)})
      OR coalesce(address IN (SELECT address FROM l), false) AS on_list
  FROM a
)
SELECT page_id, host, path, rule, on_list,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
                 ELSE CASE WHEN on_list THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
