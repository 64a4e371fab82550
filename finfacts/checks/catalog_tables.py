"""Queries whose terms, bands, rules, definitions and keywords are tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts import reference_data as ref
from finfacts.checks import sqltext as S
from finfacts.checks.catalog_items import _LABELS, _renamed
from finfacts.checks.registry import ORACLES, query
from finfacts.functions import periods as per
from finfacts.operators import asof, facts as fx, intervals, items as it, peers, questions as qn, ratios, terms, trends, wide_report
from finfacts.plans import sqltools
from finfacts.session import scratch_path
from finfacts.sources.panel import PANEL_BUCKETS, PANEL_CODES, facts, institutions, line_items, pick, questions, table

# ---------------------------------------------------------------- terms

# Six digits of an order's amount, a code of a part's type, and short and blank ones from the region keys.
_TERMS = """terms AS (SELECT DISTINCT term FROM (
  SELECT right(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 6) AS term FROM orders
  UNION ALL SELECT ' ' || upper(p_type) || ' ' FROM part
  UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'Net' WHEN 1 THEN '%' WHEN 2 THEN 'rc' WHEN 3 THEN '  ' ELSE 'RCON14' END FROM region))"""


def _terms(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    amounts = table(spark, sf, "orders").select(F.right(price, F.lit(6)).alias("term"))
    kinds = table(spark, sf, "part").select(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")))
    odd = table(spark, sf, "region").select(pick(["Net", "%", "rc", "  ", "RCON14"], F.col("r_regionkey")))
    return amounts.union(kinds).union(odd).distinct()


# All substrings of the lengths that terms have, met by equality.
def _inside(fields: str, source: str, needles: str) -> str:
    return f"""lens AS (SELECT DISTINCT length(needle) AS n FROM {needles}),
pieces AS (SELECT DISTINCT k, substr(t, CAST(i AS BIGINT), n) AS needle FROM (
  SELECT k, t, n, unnest(range(1, greatest(length(t) - n + 2, 1))) AS i FROM (SELECT k, unnest([{fields}]) AS t FROM {source}) JOIN lens ON n > 0 WHERE t IS NOT NULL)
  UNION SELECT k, '' FROM {source})"""


@query("prj10_terms_table", S.with_(S.ITEMS, _TERMS, "needles AS (SELECT term, lower(trim(term)) AS needle FROM terms)",
       "numbered AS (SELECT *, row_number() OVER () AS k FROM items)",
       _inside("lower(item_code), lower(description), lower(value_raw)", "numbered", "needles")) + """
SELECT rssd_id, reporting_period, item_code, description, value_raw, line_number, term
FROM numbered JOIN pieces USING (k) JOIN needles USING (needle)""")
def _(spark, sf):
    return terms.search_table(line_items(spark, sf), _terms(spark, sf)).select(
        "rssd_id", "reporting_period", "item_code", "description", "value_raw", "line_number", "term")


# Ends of customer numbers, nation names, and blank.
_BANK_TERMS = """terms AS (SELECT DISTINCT term FROM (SELECT right(c_name, 3) AS term FROM customer
  UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT CASE r_regionkey WHEN 0 THEN '' ELSE 'UPPLIER#' END FROM region))"""


def _bank_terms(spark, sf):
    ends = table(spark, sf, "customer").select(F.right("c_name", F.lit(3)).alias("term"))
    cities = table(spark, sf, "nation").select(F.lower("n_name"))
    odd = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "").otherwise("UPPLIER#"))
    return ends.union(cities).union(odd)


@query("prj11_terms_table", S.with_(S.INSTITUTIONS, _BANK_TERMS) + """
SELECT term, pos, rssd_id, name, city, state FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY CAST(rssd_id AS BIGINT)) AS pos FROM institutions JOIN terms
  ON contains(lower(name), lower(term)) OR contains(rssd_id, term) OR contains(lower(city), lower(term))) WHERE pos <= 100""")
def _(spark, sf):
    return terms.match_institutions_table(
        institutions(spark, sf), _bank_terms(spark, sf), with_city=True, limit=100, blank_matches_all=True
    ).select("term", "pos", "rssd_id", "name", "city", "state")


@query("prj14_terms_table", S.with_(S.FACTS) + """
, patterns AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'UBPR' || chr(65 + p_size % 6) ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END AS pattern,
  CASE WHEN p_size % 2 = 0 THEN 'prefix' ELSE 'part' END AS kind FROM part)
SELECT DISTINCT quarter_date, code, pattern, kind FROM facts JOIN patterns
ON CASE kind WHEN 'prefix' THEN starts_with(code, pattern) ELSE contains(code, pattern) END""".lstrip())
def _(spark, sf):
    even = F.col("p_size") % 2 == 0
    pattern = F.when(even, F.concat(F.lit("UBPR"), F.chr(65 + F.col("p_size") % 6))).otherwise(
        F.lpad(F.col("p_size").cast("string"), 2, "0"))
    patterns = table(spark, sf, "part").select(pattern.alias("pattern"), F.when(even, "prefix").otherwise("part").alias("kind"))
    return terms.find_codes_table(fx.code_catalog(facts(spark, sf)), patterns.distinct())


# ---------------------------------------------------------------- bands

# Narrow and overlapping bands in steps of a hundredth, one in two hundred open below, one in three hundred above.
_BANDS = """bands AS (SELECT p_partkey AS band,
  CASE WHEN p_partkey % 200 = 3 THEN NULL ELSE CAST(p_partkey * 37 % 9973 AS DOUBLE) / 100 END AS lo,
  CASE WHEN p_partkey % 300 = 7 THEN NULL ELSE CAST(p_partkey * 37 % 9973 AS DOUBLE) / 100 + CAST(p_size - 1 AS DOUBLE) / 500 END AS hi FROM part)"""


def _bands(spark, sf):
    low = (F.col("p_partkey") * 37 % 9973).cast("double") / 100.0
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("band"),
        F.when(F.col("p_partkey") % 200 != 3, low).alias("lo"),
        F.when(F.col("p_partkey") % 300 != 7, low + (F.col("p_size") - 1).cast("double") / 500.0).alias("hi"))


@query("prj13_bands_table", S.with_(S.FACTS, _BANDS) + """
SELECT rssd_id, quarter_date, code, value_num, band FROM facts JOIN bands
ON value_num >= coalesce(lo, '-infinity'::DOUBLE) AND value_num <= coalesce(hi, 'infinity'::DOUBLE)""")
def _(spark, sf):
    found = fx.values_in_bands(facts(spark, sf), _bands(spark, sf))
    return found.select("rssd_id", "quarter_date", "code", "value_num", "band")


# Customers' balances as widths, at positions given by their numbers: thousands of nested and overlapping size bands.
_SIZES = """sizebands AS (SELECT 'band:' || CAST(c_custkey AS VARCHAR) AS peer_group,
  CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE CAST(c_custkey % 400 AS DOUBLE) * 5000 END AS lo,
  CASE WHEN c_custkey % 150 = 1 THEN NULL ELSE CAST(c_custkey % 400 AS DOUBLE) * 5000 + c_acctbal END AS hi FROM customer)"""


@query("prj06_bands_table", S.with_(S.FACTS, _SIZES) + """
, cellkeys AS (SELECT rssd_id, quarter_date, max(value_num) FILTER (WHERE code = 'UBPR2170') AS size FROM facts GROUP BY 1, 2)
SELECT rssd_id, quarter_date, size, 'all' AS peer_group FROM cellkeys
UNION ALL SELECT rssd_id, quarter_date, size, peer_group FROM cellkeys JOIN sizebands
ON size >= coalesce(lo, '-infinity'::DOUBLE) AND size < coalesce(hi, 'infinity'::DOUBLE)""".lstrip())
def _(spark, sf):
    key = F.col("c_custkey")
    low = (key % 400).cast("double") * 5000.0
    bands = table(spark, sf, "customer").select(
        F.concat(F.lit("band:"), key.cast("string")).alias("peer_group"),
        F.when(key % 100 != 0, low).alias("lo"), F.when(key % 150 != 1, low + F.col("c_acctbal")).alias("hi"))
    return peers.band_groups(facts(spark, sf), bands)


# ---------------------------------------------------------------- rules and dates

# One rule for each nation, for one code each, and one for each region that holds for all codes.
_RULES = f"""rules AS (SELECT CAST(n_nationkey AS INT) AS place, {S.lit_list(PANEL_CODES)}[n_nationkey % {len(PANEL_CODES)} + 1] AS code,
  CAST(1995 + n_nationkey * 3 % 8 AS VARCHAR) || '0' || CAST(1 + n_regionkey AS VARCHAR) || '15' AS rule_date, n_name AS rule_label FROM nation
  UNION ALL SELECT 100 + r_regionkey, NULL, CAST(1996 + r_regionkey AS VARCHAR) || '0331', r_name FROM region)"""
_SPANS = """spans AS (SELECT rssd_id, code, quarter_date, lead(quarter_date, 6) OVER (PARTITION BY rssd_id, code ORDER BY quarter_date) AS end_quarter FROM facts)"""


def _rules(spark, sf):
    key = F.col("n_nationkey")
    date = F.concat((1995 + key * 3 % 8).cast("string"), F.lit("0"), (1 + F.col("n_regionkey")).cast("string"), F.lit("15"))
    own = table(spark, sf, "nation").select(
        key.cast("int").alias("place"), pick(PANEL_CODES, key % len(PANEL_CODES)).alias("code"), date.alias("rule_date"),
        F.col("n_name").alias("rule_label"))
    every = table(spark, sf, "region").select(
        (100 + F.col("r_regionkey")).cast("int"), F.lit(None).cast("string"),
        F.concat((1996 + F.col("r_regionkey")).cast("string"), F.lit("0331")), "r_name")
    return own.union(every)


def _spans(spark, sf):
    end = F.lead("quarter_date", 6).over(trends.oldest_first())
    return facts(spark, sf).select("rssd_id", "code", "quarter_date", end.alias("end_quarter"))


@query("jn08_rules_table", S.with_(S.FACTS, _RULES, _SPANS) + """
SELECT s.rssd_id, s.code, quarter_date, end_quarter, place, rule_date, rule_label FROM spans s JOIN rules r
ON (r.code IS NULL OR r.code = s.code) AND rule_date > quarter_date AND rule_date <= end_quarter""")
def _(spark, sf):
    return intervals.dates_inside(_spans(spark, sf), "quarter_date", "end_quarter", _rules(spark, sf), "rule_date", "code")


@query("jn08_first_rule", S.with_(S.FACTS, _RULES, _SPANS) + """
SELECT s.rssd_id, s.code, s.quarter_date, s.end_quarter, f.place, f.rule_date, f.rule_label FROM spans s LEFT JOIN (
  SELECT s.rssd_id, s.code, quarter_date, min(place) AS place, arg_min(rule_date, place) AS rule_date, arg_min(rule_label, place) AS rule_label
  FROM spans s JOIN rules r ON (r.code IS NULL OR r.code = s.code) AND rule_date > quarter_date AND rule_date <= end_quarter GROUP BY 1, 2, 3) f
ON f.rssd_id = s.rssd_id AND f.code = s.code AND f.quarter_date = s.quarter_date""")
def _(spark, sf):
    return intervals.first_date_inside(
        _spans(spark, sf), ["rssd_id", "code", "quarter_date"], "quarter_date", "end_quarter", _rules(spark, sf), "rule_date",
        "place", "code")


# A filing has gaps: cells that report a valid capital ratio only.
_FILED = """filed AS (SELECT rssd_id, quarter_date, value_num FROM facts WHERE valid AND code = 'UBPRD486' AND value_num < 30)"""


def _filed(spark, sf):
    return fx.valid_ratios(facts(spark, sf)).where("code = 'UBPRD486' AND value_num < 30").select("rssd_id", "quarter_date", "value_num")


def _shipped(spark, sf):
    """Every line of an institution, with its day."""
    return line_items(spark, sf).select("rssd_id", "reporting_period", "line_number", F.col("last_update").alias("day"))


@query("jn09_nearest_filing", S.with_(S.FACTS, S.ITEMS, _FILED) + """
, asked AS (SELECT DISTINCT rssd_id, last_update AS day FROM items),
found AS (SELECT a.rssd_id, day, arg_min(quarter_date, ROW(abs(date_diff('day', strptime(quarter_date, '%Y%m%d'), strptime(day, '%Y%m%d'))), -CAST(quarter_date AS INT))) AS nearest
  FROM asked a JOIN filed f ON f.rssd_id = a.rssd_id GROUP BY 1, 2)
SELECT i.rssd_id, reporting_period, line_number, last_update AS day, nearest,
  date_diff('day', strptime(last_update, '%Y%m%d'), strptime(nearest, '%Y%m%d')) AS gap_days
FROM items i LEFT JOIN found f ON f.rssd_id = i.rssd_id AND f.day = i.last_update""".lstrip())
def _(spark, sf):
    return asof.nearest_filing(_shipped(spark, sf), _filed(spark, sf), ["rssd_id"], "day", "quarter_date")


@query("jn09_latest_value", S.with_(S.FACTS, S.ITEMS, _FILED) + """
SELECT i.rssd_id, reporting_period, line_number, last_update AS day, f.quarter_date, value_num
FROM items i ASOF LEFT JOIN filed f ON f.rssd_id = i.rssd_id AND i.last_update >= f.quarter_date""")
def _(spark, sf):
    return asof.latest_values(_shipped(spark, sf), _filed(spark, sf), ["rssd_id"], "day", "quarter_date")


# ---------------------------------------------------------------- definitions and keywords

_DEFINED = f"""defs AS (SELECT n_name AS label, ' ' || {S.lit_list([*PANEL_CODES, 'bad code;'])}[n_nationkey % {len(PANEL_CODES) + 1} + 1] AS numerator,
  CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE {S.lit_list([*PANEL_CODES, 'UBPRZZZZ'])}[n_nationkey * 3 % {len(PANEL_CODES) + 1} + 1] END AS denominator,
  ['percent', 'dollar', 'raw'][n_nationkey % 3 + 1] AS scale FROM nation)"""


def _definitions(spark, sf):
    key = F.col("n_nationkey")
    below = pick([*PANEL_CODES, "UBPRZZZZ"], key * 3 % (len(PANEL_CODES) + 1))
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("label"),
        F.concat(F.lit(" "), pick([*PANEL_CODES, "bad code;"], key % (len(PANEL_CODES) + 1))).alias("numerator"),
        F.when(F.col("n_regionkey") > 1, below).when(F.col("n_regionkey") == 1, "  ").alias("denominator"),
        pick(["percent", "dollar", "raw"], key % 3).alias("scale"))


@query("rep06_saved", S.with_(S.FACTS, _DEFINED, f"""vals AS (SELECT rssd_id, quarter_date, code, max({S.prefix('value_raw')}) AS v FROM facts GROUP BY 1, 2, 3),
pairs AS (SELECT c.rssd_id, c.quarter_date, label, trim(numerator) AS numerator, coalesce(trim(denominator), '') AS denominator, scale, n.v AS n, d.v AS d
  FROM (SELECT DISTINCT rssd_id, quarter_date FROM facts) c CROSS JOIN defs
  LEFT JOIN vals n ON n.rssd_id = c.rssd_id AND n.quarter_date = c.quarter_date AND n.code = trim(numerator)
  LEFT JOIN vals d ON d.rssd_id = c.rssd_id AND d.quarter_date = c.quarter_date AND d.code = trim(denominator)),
judged AS (SELECT *, CASE WHEN denominator = '' THEN n ELSE n / nullif(d, 0) END AS raw, CASE WHEN n IS NULL THEN 'numerator not found'
  WHEN denominator <> '' AND coalesce(d, 0) = 0 THEN 'denominator is zero or not found' END AS error FROM pairs)""") + f"""
SELECT rssd_id, quarter_date, label, numerator, denominator, raw, error, CASE WHEN error IS NULL THEN CASE scale
  WHEN 'percent' THEN CASE WHEN denominator = '' AND abs(raw) <= 200 AND numerator LIKE 'UBPR%' THEN {S.percent('raw')} ELSE {S.percent('(raw * 100.0::DOUBLE)')} END
  WHEN 'dollar' THEN {S.money('raw')} ELSE {S.fixed('raw', 4)} END END AS display FROM judged""")
def _(spark, sf):
    return ratios.saved_ratios(facts(spark, sf), _definitions(spark, sf))


# Phrases that begin, hold and repeat one another, of two topics, from the names of the star schema.
_KEYWORDS = """words AS (SELECT 'place' AS topic, 'nation ' || CAST(n_regionkey AS VARCHAR) AS class, n_nationkey % 7 AS priority, 'bank ' || CAST(n_nationkey AS VARCHAR) AS phrase FROM nation
  UNION ALL SELECT 'place', 'any bank', 9, 'Bank' FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'kind', ['capital', 'peers', 'trend', 'filing', 'other'][r_regionkey + 1], r_regionkey, ['CET1', 'peer', 'trend', 'filing', 'e'][r_regionkey + 1] FROM region
  UNION ALL SELECT 'kind', 'capital', 0, 'tier one buffer' FROM region WHERE r_regionkey = 1)"""


def _keywords(spark, sf):
    nation, region, key = table(spark, sf, "nation"), table(spark, sf, "region"), F.col("r_regionkey")
    rows = nation.select(
        F.lit("place").alias("topic"), F.concat(F.lit("nation "), F.col("n_regionkey").cast("string")).alias("class"),
        (F.col("n_nationkey") % 7).alias("priority"), F.concat(F.lit("bank "), F.col("n_nationkey").cast("string")).alias("phrase"))
    rows = rows.union(region.where("r_regionkey = 0").select(F.lit("place"), F.lit("any bank"), F.lit(9), F.lit("Bank")))
    rows = rows.union(region.select(
        F.lit("kind"), pick(["capital", "peers", "trend", "filing", "other"], key), key, pick(["CET1", "peer", "trend", "filing", "e"], key)))
    return rows.union(region.where("r_regionkey = 1").select(F.lit("kind"), F.lit("capital"), F.lit(0), F.lit("tier one buffer")))


@query("qr01_keywords_table", S.with_(S.QUESTIONS, _KEYWORDS) + """
, hit AS (SELECT question_id, topic, arg_min(class, ROW(priority, class)) AS class FROM questions JOIN words ON contains(lower(question), lower(phrase)) GROUP BY 1, 2)
SELECT q.question_id, p.class AS place, k.class AS kind FROM questions q LEFT JOIN (SELECT * FROM hit WHERE topic = 'place') p USING (question_id)
LEFT JOIN (SELECT * FROM hit WHERE topic = 'kind') k USING (question_id)""".lstrip())
def _(spark, sf):
    return qn.classify(questions(spark, sf), _keywords(spark, sf)).select("question_id", "place", "kind")


# ---------------------------------------------------------------- wide reports

_CELLS = f"""cells8 AS (SELECT section, item_code, c.rssd_id, reporting_period, description, value, coalesce(bank_label, c.rssd_id) AS bank,
    substr(reporting_period, 7, 4) || substr(reporting_period, 1, 2) || substr(reporting_period, 4, 2) AS pk
  FROM (SELECT section, item_code, rssd_id, reporting_period, arg_min(description, ord) AS description, arg_max(value_raw, ord) AS value
    FROM items WHERE section IS NOT NULL GROUP BY 1, 2, 3, 4) c LEFT JOIN labels2 l ON l.rssd_id = c.rssd_id)"""


def _lines_sql(label: str, order: str, shard: int) -> str:
    """The report's lines from the full grid of rows and columns."""
    quote = lambda x: f"""'"' || replace({x}, '"', '""') || '"'"""
    return S.with_(S.ITEMS, S.INSTITUTIONS, _LABELS, _CELLS, f"""
cols AS (SELECT label, row_number() OVER (ORDER BY o) - 1 AS col FROM (SELECT DISTINCT {label} AS label, {order} AS o FROM cells8)),
vals AS (SELECT section, item_code, {label} AS label, arg_max(value, ROW(pk, rssd_id)) AS v FROM cells8 GROUP BY 1, 2, 3),
heads AS (SELECT section, item_code, min(description) AS description FROM cells8 GROUP BY 1, 2)""") + f"""
SELECT CAST(col // {shard} AS INT) AS shard, {quote('r.section')} || ',' || {quote('r.item_code')} || ',' || {quote('r.description')} || ',' ||
  string_agg({quote("coalesce(v, '-')")}, ',' ORDER BY col) AS line
FROM heads r CROSS JOIN cols k LEFT JOIN vals v ON v.section = r.section AND v.item_code = r.item_code AND v.label = k.label
GROUP BY 1, r.section, r.item_code, r.description
UNION ALL SELECT CAST(col // {shard} AS INT), '"section","item_code","description",' || string_agg({quote('label')}, ',' ORDER BY col) FROM cols GROUP BY 1"""


def _written_report(spark, sf, many_banks: bool, many_periods: bool, shard: int):
    """The report as files, and their lines read back."""
    path = scratch_path(spark, "report")
    rows = it.with_section(line_items(spark, sf))
    wide_report.write_report(wide_report.report_lines(rows, _renamed(spark, sf), many_banks, many_periods, shard), path)
    return spark.read.schema("value string, shard int").text(path).select("shard", F.col("value").alias("line"))


@query("rep08_bank_period_csv", _lines_sql("bank || ' · ' || reporting_period", "ROW(bank, pk)", 1000))
def _(spark, sf):
    return _written_report(spark, sf, True, True, 1000)


@query("rep08_bank_csv", _lines_sql("bank", "bank", 64))
def _(spark, sf):
    return _written_report(spark, sf, True, False, 64)


# ---------------------------------------------------------------- tools called from SQL

def _tool(name: str, like: str, call: str, **frames):
    """The same result as the query ``like``, through the SQL function."""

    @query(name, ORACLES[like])
    def _(spark, sf):
        sqltools.register(spark, buckets=PANEL_BUCKETS, **{k: make(spark, sf) for k, make in frames.items()})
        return spark.sql(f"SELECT * FROM {call}")


_tool("tf01_sql", "tf01_ratios", "get_ubpr_ratios()", facts=facts)
_tool("tf02_sql", "tf02_peer_comparison", "get_peer_comparison('community')", facts=facts)
_tool("tf03_sql", "tf03_trend", "get_ubpr_trend(' UBPRE013,, UBPRE018 ', '20001231', '19960331')", facts=facts)
_tool("tf04_sql", "tf04_regulatory_lines", "flag_regulatory_issues()", facts=facts)
_tool("tf05_sql", "tf05_available_periods", "get_available_periods()", periods=lambda spark, sf: facts(spark, sf).select(
    per.key_to_period("quarter_date").alias("period"), "quarter_date").distinct())
_tool("tf06_sql", "tf06_metrics", "get_bank_metrics()", items=lambda spark, sf: it.with_section(line_items(spark, sf)))
_tool("tf07_sql", "tf07_schedule_data", "get_schedule_data('RC, RI,,RC-C')",
      items=lambda spark, sf: it.with_section(line_items(spark, sf)))
_tool("tf08_sql", "tf08_schedules", "get_available_schedules()", items=lambda spark, sf: it.with_section(line_items(spark, sf)))


@query("tf03_sql_lateral", S.with_(S.FACTS, S.INSTITUTIONS) + """
SELECT name, i.rssd_id, code, quarter_date, value_raw FROM institutions i JOIN facts f ON f.rssd_id = i.rssd_id
WHERE code IN ('UBPRE013', 'UBPR7414') AND quarter_date BETWEEN '19980331' AND '19991231'""")
def _(spark, sf):
    """Each institution calls the trend function with its own id."""
    sqltools.register(spark, facts(spark, sf))
    institutions(spark, sf).createOrReplaceTempView("banks")
    return spark.sql("""SELECT b.name, t.* FROM banks b, LATERAL (
      SELECT * FROM get_ubpr_trend('UBPRE013,UBPR7414', '19980331', '19991231') t WHERE t.rssd_id = b.rssd_id) t""")
