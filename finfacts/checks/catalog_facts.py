"""Queries over the ratio facts: projections, peers, trends, ranking, thresholds, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts import reference_data as ref
from finfacts.checks import sqltext as S
from finfacts.checks.registry import query
from finfacts.functions import numeric as num, periods as per
from finfacts.operators import compare as cmp, facts as fx, lifecycle, peers, ranking, ratios, regulatory, trends
from finfacts.plans import reports, tools
from finfacts.sources import store
from finfacts.sources.panel import PANEL_BUCKETS, PANEL_CODES, facts, institutions, table

ALL = ["all", *[b[0] for b in PANEL_BUCKETS]]
QUARTERS_98 = ["19980331", "19980630", "19980930", "19981231"]
# Panel-era definition changes (the fixed calendar's dates fall after the panel ends).
PANEL_RULES = [
    ("20000101", "second definition", "from 2000 on"),
    ("19970101", "first definition", "from 1997 on"),
]
FULL_SPAN = ("19950331", "20011231")
KEYS = [f"{y}{e}" for y in range(1995, 2002) for e in ("0331", "0630", "0930", "1231")]

BUCKETS_SQL = f"buckets(peer_group, lo, hi) AS ({ref.values_sql([('all', None, None), *PANEL_BUCKETS])})"
# Each (institution, quarter) in every group it belongs to; a missing size is only in 'all'.
MEMBERS_SQL = f"""cellkeys AS (SELECT DISTINCT rssd_id, quarter_date FROM facts),
sizes AS (SELECT k.rssd_id, k.quarter_date, f.value_num AS size FROM cellkeys k
  LEFT JOIN facts f ON f.rssd_id = k.rssd_id AND f.quarter_date = k.quarter_date AND f.code = 'UBPR2170'),
{BUCKETS_SQL},
members AS (SELECT rssd_id, quarter_date, size, peer_group FROM sizes JOIN buckets
  ON peer_group = 'all' OR (size IS NOT NULL AND (lo IS NULL OR size >= lo) AND (hi IS NULL OR size < hi)))"""
_PEERS = S.in_list(ref.PEER_CODES)
# The direct definition: every institution against the average over the others.
LOO_SQL = f"""pool AS (SELECT m.peer_group, f.quarter_date, f.code, f.rssd_id, CAST(f.value_num AS DECIMAL(30,8)) AS v
    FROM facts f JOIN members m USING (rssd_id, quarter_date) WHERE f.value_num IS NOT NULL AND f.code IN {_PEERS}),
loo AS (SELECT o.rssd_id, o.quarter_date, g.peer_group, o.code, any_value(o.value_num) AS bank_value,
    count(p.v) AS n_peers,
    {S.rnd('(CAST(sum(p.v) AS DOUBLE) / nullif(count(p.v), 0))', 6)} AS peer_average
  FROM facts o CROSS JOIN (SELECT peer_group FROM buckets) g
  LEFT JOIN pool p ON p.peer_group = g.peer_group AND p.quarter_date = o.quarter_date AND p.code = o.code
    AND p.rssd_id <> o.rssd_id
  WHERE o.valid AND o.code IN {_PEERS} GROUP BY 1, 2, 3, 4)"""
PEER_BASE = S.with_(S.FACTS, MEMBERS_SQL, LOO_SQL)


def ui_status_sql(code: str, v: str) -> str:
    cases = " ".join(
        f"WHEN {code} = '{c}' THEN CASE WHEN {v} IS NULL THEN NULL WHEN {v} < {lo} THEN 'danger'"
        f" WHEN {v} < {well} THEN 'warning' ELSE 'healthy' END"
        for c, lo, well, _ in ref.UI_THRESHOLDS
    )
    return f"(CASE {cases} END)"


def ui_label_sql(s: str) -> str:
    return (
        f"(CASE {s} WHEN 'danger' THEN 'Below Minimum' WHEN 'warning' THEN 'Below Well-Capitalized'"
        f" WHEN 'healthy' THEN 'Well-Capitalized' END)"
    )


# ---------------------------------------------------------------- sources and selections

@query("src01_quarter_scan", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts WHERE quarter_date = '19981231'""")
def _(spark, sf):
    return fx.between_quarters(facts(spark, sf), "19981231", "19981231")


@query("src02_catalog", S.with_(S.FACTS) + "SELECT DISTINCT quarter_date, code FROM facts")
def _(spark, sf):
    return fx.code_catalog(facts(spark, sf))


@query("src11_field_count", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, n_reported, total_fields FROM
 (SELECT rssd_id, quarter_date, count(*) AS n_reported FROM facts GROUP BY 1, 2)
 JOIN (SELECT quarter_date, count(DISTINCT code) + 2 AS total_fields FROM facts GROUP BY 1) USING (quarter_date)""")
def _(spark, sf):
    return store.field_counts(facts(spark, sf))


@query("prj01_ratio_projection", S.with_(S.FACTS) + "SELECT rssd_id, quarter_date, " + ", ".join(
    f"max(value_raw) FILTER (WHERE code = '{c}') AS {c}" for c in ("UBPRE013", "UBPRE018", "UBPR7414")
) + " FROM facts WHERE code IN ('UBPRE013', 'UBPRE018', 'UBPR7414') GROUP BY 1, 2")
def _(spark, sf):
    return fx.wide(facts(spark, sf), ["UBPRE013", "bad code;", "UBPRE018", "UBPR7414", "UBPRE013"])


@query("prj02_safe_codes", S.with_(S.FACTS) + r"""
SELECT DISTINCT code FROM (SELECT CASE WHEN value_raw IN ('n/a', '') THEN code || '; drop' ELSE code END AS code FROM facts)
WHERE regexp_matches(code, '^[A-Za-z0-9_]+$')""")
def _(spark, sf):
    asked = facts(spark, sf).select(
        F.when(F.col("value_raw").isin("n/a", ""), F.concat("code", F.lit("; drop"))).otherwise(F.col("code")).alias("code")
    )
    return fx.safe_code_rows(asked).distinct()


@query("prj03_multi_bank", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts
WHERE rssd_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)""")
def _(spark, sf):
    chosen = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("rssd_id"))
    return fx.for_banks(facts(spark, sf), chosen)


@query("prj04_valid_ratio", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts WHERE valid""")
def _(spark, sf):
    return fx.valid_ratios(facts(spark, sf))


@query("prj05_quarter_range", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts WHERE quarter_date BETWEEN '19970630' AND '19990331'""")
def _(spark, sf):
    return fx.between_quarters(facts(spark, sf), "19990331", "19970630")


@query("prj06_size_bucket", S.with_(S.FACTS, MEMBERS_SQL) + "SELECT rssd_id, quarter_date, size, peer_group FROM members")
def _(spark, sf):
    return peers.size_groups(facts(spark, sf), PANEL_BUCKETS)


@query("prj13_range_codes", S.with_(S.FACTS) + """
, bands(band, lo, hi) AS (VALUES ('low', CAST(0.001 AS DOUBLE), CAST(4.0 AS DOUBLE)), ('mid', 3.0, 30.0), ('high', 30.0, 100.0))
SELECT rssd_id, quarter_date, code, value_num, band FROM facts JOIN bands ON value_num BETWEEN lo AND hi""".lstrip())
def _(spark, sf):
    return fx.codes_in_value_bands(facts(spark, sf), [("low", 0.001, 4.0), ("mid", 3.0, 30.0), ("high", 30.0, 100.0)])


@query("prj14_code_search", S.with_(S.FACTS) + """
SELECT DISTINCT quarter_date, code FROM facts WHERE code LIKE 'UBPRD%' OR contains(code, '74') OR contains(code, '01')""")
def _(spark, sf):
    return fx.find_codes(fx.code_catalog(facts(spark, sf)), "UBPRD", ["74", "01"])


_REQUIRED = ["UBPR7400", "UBPRE013", "UBPR7414", "UBPR2170", "UBPRJJ33"]


@query("prj15_presence", S.with_(S.FACTS) + f"""
, required(code) AS ({ref.values_sql([(c,) for c in _REQUIRED])})
SELECT q.quarter_date, r.code, EXISTS (SELECT 1 FROM facts f WHERE f.quarter_date = q.quarter_date AND f.code = r.code) AS present
FROM (SELECT DISTINCT quarter_date FROM facts) q CROSS JOIN required r""".lstrip())
def _(spark, sf):
    return fx.code_presence(facts(spark, sf), _REQUIRED, ["quarter_date"])


@query("prj17_alerts", S.with_(S.FACTS, S.RATIO_META, f"pg(group_ord, code_ord, code, fallback) AS ({ref.values_sql(ref.priority_group_rows())})") + f"""
, picks AS (SELECT rssd_id, quarter_date, CAST(group_ord AS BIGINT) AS group_ord, arg_min(code, code_ord) AS code, arg_min(value_num, code_ord) AS value_num
  FROM facts JOIN pg USING (code) WHERE valid GROUP BY 1, 2, 3)
SELECT rssd_id, quarter_date, group_ord, code, label, value_num, {ui_status_sql('code', 'value_num')} AS status,
  {ui_label_sql(ui_status_sql('code', 'value_num'))} AS status_label
FROM picks LEFT JOIN ratio_meta USING (code) WHERE {ui_status_sql('code', 'value_num')} IN ('danger', 'warning')""".lstrip())
def _(spark, sf):
    return reports.summary_alerts(facts(spark, sf))


# ---------------------------------------------------------------- joins

@query("jn01_bank_vs_peers", PEER_BASE + f"""
SELECT rssd_id, quarter_date, code, bank_value, peer_average, {S.rnd('(bank_value - peer_average)', 6)} AS difference
FROM loo WHERE peer_group = 'all' AND peer_average IS NOT NULL""")
def _(spark, sf):
    rows = peers.with_difference(peers.leave_one_out(facts(spark, sf), buckets=PANEL_BUCKETS, groups=["all"]))
    return rows.where("peer_average IS NOT NULL").select(
        "rssd_id", "quarter_date", "code", "bank_value", "peer_average", "difference"
    )


@query("jn02_ratio_meta", S.with_(S.FACTS, S.RATIO_META) + """
SELECT rssd_id, quarter_date, code, value_raw, coalesce(label, code) AS label, coalesce(category, 'Other') AS category,
  coalesce(CAST(higher_better AS VARCHAR), 'unknown') AS higher_better
FROM facts LEFT JOIN ratio_meta USING (code)""")
def _(spark, sf):
    return fx.with_meta(facts(spark, sf)).select(
        "rssd_id", "quarter_date", "code", "value_raw", "label", "category",
        F.coalesce(F.col("higher_better").cast("string"), F.lit("unknown")).alias("higher_better"),
    )


@query("jn03_bank_names", S.with_(S.FACTS, S.INSTITUTIONS) + """
SELECT f.rssd_id, quarter_date, code, value_raw, coalesce(name, f.rssd_id) AS name FROM facts f
LEFT JOIN institutions i ON f.rssd_id = i.rssd_id""")
def _(spark, sf):
    return fx.with_bank_names(facts(spark, sf), institutions(spark, sf)).select("rssd_id", "quarter_date", "code", "value_raw", "name")


@query("jn07_reg_ui", S.with_(S.FACTS, S.UI_THRESHOLDS) + f"""
SELECT rssd_id, quarter_date, code, value_num, rule_label, status, {ui_label_sql('status')} AS status_label FROM (
  SELECT *, CASE WHEN value_num < minimum THEN 'danger' WHEN value_num < well THEN 'warning' ELSE 'healthy' END AS status
  FROM facts JOIN ui_thresholds USING (code) WHERE valid)""")
def _(spark, sf):
    return regulatory.regulatory_status(facts(spark, sf), "ui").select(
        "rssd_id", "quarter_date", "code", "value_num", "rule_label", "status", "status_label"
    )


_AGENT = S.with_(S.FACTS, S.AGENT_THRESHOLDS) + """
, checked AS (SELECT rssd_id, quarter_date, code, value_num, rule_label, minimum, well,
  CASE WHEN value_num >= well THEN 'WELL-CAPITALIZED' WHEN value_num >= adequate THEN 'ADEQUATELY CAPITALIZED' ELSE 'UNDERCAPITALIZED' END AS status
  FROM facts JOIN agent_thresholds USING (code) WHERE valid)""".lstrip()


@query("jn07_reg_agent", _AGENT + "SELECT rssd_id, quarter_date, code, value_num, rule_label, status FROM checked")
def _(spark, sf):
    return regulatory.regulatory_status(facts(spark, sf), "agent").select(
        "rssd_id", "quarter_date", "code", "value_num", "rule_label", "status"
    )


_RULES_SQL = f"rules(rule_date, rule_label, rule_note) AS ({ref.values_sql(PANEL_RULES)})"


@query("jn08_rule_change", S.with_(S.FACTS, _RULES_SQL) + """
, spans AS (SELECT rssd_id, code, quarter_date, lead(quarter_date, 4) OVER (PARTITION BY rssd_id, code ORDER BY quarter_date) AS end_quarter FROM facts)
SELECT rssd_id, code, quarter_date, end_quarter, rule_date, rule_label, rule_note FROM spans
JOIN rules ON rule_date > quarter_date AND rule_date <= end_quarter""".lstrip())
def _(spark, sf):
    spans = facts(spark, sf).select(
        "rssd_id", "code", "quarter_date", F.lead("quarter_date", 4).over(trends.oldest_first()).alias("end_quarter")
    )
    return trends.rule_changes_crossed(
        spans.where(F.col("end_quarter").isNotNull()), PANEL_RULES, "quarter_date", "end_quarter"
    )


_DEFS = [
    ratios.RatioDef("npl share of assets", "UBPR7414", "UBPR2170"),
    ratios.RatioDef("roa alone", "UBPRE013"),
    ratios.RatioDef("assets per line", "UBPR2170", "UBPRE600", "dollar"),
    ratios.RatioDef("assets", "UBPR2170", None, "dollar"),
    ratios.RatioDef("capital spread", "UBPRD488", "UBPRD487", "raw"),
    ratios.RatioDef("not a code", "UBPRZZZZ", "UBPRE013"),
]


def _custom_sql() -> str:
    parts = []
    for d in _DEFS:
        n = f"max({S.prefix('value_raw')}) FILTER (WHERE code = '{d.numerator}')"
        dn = f"max({S.prefix('value_raw')}) FILTER (WHERE code = '{d.denominator}')" if d.denominator else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT rssd_id, quarter_date, {ref.sql_literal(d.label)} AS label, '{d.numerator}' AS numerator,"
            f" '{d.denominator or ''}' AS denominator, '{d.scale}' AS scale, {n} AS n, {dn} AS d FROM facts GROUP BY 1, 2"
        )
    raw = "CASE WHEN denominator = '' THEN n ELSE n / nullif(d, 0) END"
    pct_already = "(denominator = '' AND abs(raw) <= 200 AND numerator LIKE 'UBPR%')"
    return S.with_(S.FACTS, "pairs AS (" + " UNION ALL ".join(parts) + ")", f"""judged AS (
      SELECT *, {raw} AS raw, CASE WHEN n IS NULL THEN 'numerator not found'
        WHEN denominator <> '' AND (d IS NULL OR d = 0) THEN 'denominator is zero or not found' END AS error FROM pairs)""") + f"""
    SELECT rssd_id, quarter_date, label, numerator, denominator, raw, error, CASE WHEN error IS NULL THEN
      CASE scale WHEN 'percent' THEN CASE WHEN {pct_already} THEN {S.percent('raw')} ELSE {S.percent('(raw * 100.0::DOUBLE)')} END
        WHEN 'dollar' THEN {S.money('raw')} ELSE {S.fixed('raw', 4)} END END AS display FROM judged"""


@query("rep06_defs", _custom_sql())
def _(spark, sf):
    return ratios.custom_ratios(facts(spark, sf), _DEFS)


@query("jn10_custom_ratio", S.with_(S.FACTS) + f"""
SELECT a.rssd_id, a.quarter_date, {S.prefix('a.value_raw')} / nullif({S.prefix('b.value_raw')}, 0) AS raw
FROM facts a JOIN facts b ON a.rssd_id = b.rssd_id AND a.quarter_date = b.quarter_date AND a.code = 'UBPR2170' AND b.code = 'UBPRE600'
WHERE {S.prefix('a.value_raw')} IS NOT NULL AND coalesce({S.prefix('b.value_raw')}, 0) <> 0""")
def _(spark, sf):
    rows = ratios.custom_ratios(facts(spark, sf), [ratios.RatioDef("assets per line", "UBPR2170", "UBPRE600", "raw")])
    return rows.where("error IS NULL").select("rssd_id", "quarter_date", "raw")


@query("jn12_calendar_fill", S.with_(S.FACTS) + f"""
, span AS (SELECT min(quarter_date) AS a, max(quarter_date) AS b FROM facts),
cal AS (SELECT strftime(last_day(make_date(y, q * 3, 1)), '%Y%m%d') AS quarter_date FROM range(1900, 2200) t(y), range(1, 5) u(q)),
series AS (SELECT DISTINCT rssd_id, code FROM facts)
SELECT s.rssd_id, s.code, c.quarter_date, {S.percent(S.prefix('f.value_raw'))} AS display
FROM series s CROSS JOIN (SELECT quarter_date FROM cal, span WHERE quarter_date BETWEEN a AND b) c
LEFT JOIN facts f ON f.rssd_id = s.rssd_id AND f.code = s.code AND f.quarter_date = c.quarter_date""".lstrip())
def _(spark, sf):
    return trends.calendar_filled(facts(spark, sf))


# ---------------------------------------------------------------- aggregates

@query("agg01_peer_bucket", S.with_(S.FACTS, MEMBERS_SQL) + f"""
SELECT quarter_date, peer_group, code, count(*) AS n_banks,
  {S.rnd('(CAST(sum(CAST(value_num AS DECIMAL(30,8))) AS DOUBLE) / count(*))', 6)} AS peer_average
FROM facts JOIN members USING (rssd_id, quarter_date) WHERE value_num IS NOT NULL AND code IN {_PEERS} GROUP BY 1, 2, 3""")
def _(spark, sf):
    return peers.peer_averages(facts(spark, sf), buckets=PANEL_BUCKETS)


@query("prj07_exclude_self", PEER_BASE + "SELECT * FROM loo")
def _(spark, sf):
    return peers.leave_one_out(facts(spark, sf), buckets=PANEL_BUCKETS)


@query("agg02_avg_castable", S.with_(S.FACTS) + """
SELECT quarter_date, code, CAST(sum(CAST(value_num AS DECIMAL(30,8))) AS DOUBLE) / nullif(count(value_num), 0) AS avg_value,
  count(value_num) AS n_values FROM facts GROUP BY 1, 2""")
def _(spark, sf):
    return fx.castable_average(facts(spark, sf), ["quarter_date", "code"])


@query("agg07_unpivot", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw FROM facts WHERE code IN ('UBPRE013', 'UBPRE018', 'UBPR7414')""")
def _(spark, sf):
    codes = ["UBPRE013", "UBPRE018", "UBPR7414", "UBPRABSENT"]
    return fx.long(fx.wide(facts(spark, sf), codes), codes)


@query("agg12_schema_union", S.with_(S.FACTS) + "SELECT DISTINCT code FROM facts")
def _(spark, sf):
    return fx.all_codes(facts(spark, sf))


@query("agg13_category_map", S.with_(S.FACTS, S.RATIO_META) + """
, used AS (SELECT DISTINCT code, coalesce(label, code) AS label, coalesce(category, 'Other') AS category FROM facts LEFT JOIN ratio_meta USING (code))
SELECT category, count(*) AS n_codes, string_agg(code || '=' || label, ';' ORDER BY code) AS codes FROM used GROUP BY 1""".lstrip())
def _(spark, sf):
    return fx.category_map(facts(spark, sf))


# ---------------------------------------------------------------- windows and trends

_QOQ = """qoq AS (SELECT rssd_id, code, quarter_date, value_num,
  lag(quarter_date) OVER w AS prev_quarter, lag(value_num) OVER w AS prev_value FROM facts WHERE value_num IS NOT NULL
  WINDOW w AS (PARTITION BY rssd_id, code ORDER BY quarter_date))"""
_GOOD = "CASE WHEN change IS NOT NULL THEN CASE WHEN (coalesce(higher_better, false) AND change >= 0) OR (NOT coalesce(higher_better, false) AND change <= 0) THEN 'good' ELSE 'bad' END END"
_CHANGES = f", changes AS (SELECT *, {S.rnd('(value_num - prev_value)', 6)} AS change FROM qoq)"


@query("win01_qoq", S.with_(S.FACTS, _QOQ, S.RATIO_META) + _CHANGES + f"""
SELECT rssd_id, code, quarter_date, value_num, prev_quarter, prev_value, change, {_GOOD} AS change_is
FROM changes LEFT JOIN ratio_meta USING (code)""")
def _(spark, sf):
    return trends.with_direction(trends.quarter_change(facts(spark, sf))).select(
        "rssd_id", "code", "quarter_date", "value_num", "prev_quarter", "prev_value", "change", "change_is"
    )


@query("win02_last8", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts WHERE quarter_date IN
 (SELECT DISTINCT quarter_date FROM facts ORDER BY quarter_date DESC LIMIT 8)""")
def _(spark, sf):
    return trends.in_latest_quarters(facts(spark, sf), 8)


@query("win03_spark4", S.with_(S.FACTS) + f"""
SELECT rssd_id, code, string_agg({S.fixed('value_num', 4)}, ',' ORDER BY quarter_date) AS values FROM (
  SELECT *, row_number() OVER (PARTITION BY rssd_id, code ORDER BY quarter_date DESC) AS rn FROM facts WHERE value_num IS NOT NULL)
WHERE rn <= 4 GROUP BY 1, 2""")
def _(spark, sf):
    return trends.sparkline(facts(spark, sf)).withColumn(
        "values", F.array_join(F.transform("values", lambda v: num.fixed_text(v, 4)), ",")
    )


@query("win04_scale", S.with_(S.FACTS) + f"""
SELECT rssd_id, code, quarter_date, {S.rnd('((value_num - lo) / coalesce(nullif(hi - lo, 0), 0.001::DOUBLE))', 6)} AS scaled FROM (
  SELECT *, min(value_num) OVER (PARTITION BY rssd_id, code) AS lo, max(value_num) OVER (PARTITION BY rssd_id, code) AS hi
  FROM facts WHERE value_num IS NOT NULL)""")
def _(spark, sf):
    return trends.scaled(facts(spark, sf)).select("rssd_id", "code", "quarter_date", "scaled")


_KPI = f"""kpi AS (SELECT s.rssd_id, s.code, oldest_quarter, latest_quarter, coalesce(n_values, 0) AS n_values, latest_value,
   {S.rnd('(latest_value - before_value)', 6)} AS change FROM
  (SELECT rssd_id, code, min(quarter_date) AS oldest_quarter, max(quarter_date) AS latest_quarter FROM facts GROUP BY 1, 2) s
  LEFT JOIN (SELECT rssd_id, code, count(*) AS n_values, max(value_num) FILTER (WHERE rn = 1) AS latest_value,
      max(value_num) FILTER (WHERE rn = 2) AS before_value
    FROM (SELECT *, row_number() OVER (PARTITION BY rssd_id, code ORDER BY quarter_date DESC) AS rn FROM facts WHERE value_num IS NOT NULL)
    GROUP BY 1, 2) v ON s.rssd_id = v.rssd_id AND s.code = v.code)"""


@query("win08_kpi", S.with_(S.FACTS, _KPI) + "SELECT * FROM kpi")
def _(spark, sf):
    return trends.series_kpi(facts(spark, sf))


@query("rep11_drill_down", S.with_(S.FACTS, _KPI, S.RATIO_META) + f"""
SELECT rssd_id, code, coalesce(label, code) AS label, oldest_quarter, latest_quarter, n_values, latest_value, change, {_GOOD} AS change_is,
  {ui_status_sql('code', 'latest_value')} AS status,
  CASE WHEN oldest_quarter < '20000101' AND '20000101' <= latest_quarter THEN 'second definition'
       WHEN oldest_quarter < '19970101' AND '19970101' <= latest_quarter THEN 'first definition' ELSE '' END AS rule_label
FROM kpi LEFT JOIN ratio_meta USING (code)""")
def _(spark, sf):
    return reports.drill_down(facts(spark, sf), PANEL_RULES)


_COMPARE_SQL = f"""cc(category, code_ord, code) AS ({ref.values_sql(ref.compare_code_rows())}),
grp AS (SELECT quarter_date || '-' || coalesce(state, '?') AS set_id, rssd_id, quarter_date, name, coalesce(state, '?') AS st
  FROM (SELECT DISTINCT rssd_id, quarter_date FROM facts) JOIN institutions USING (rssd_id)),
present AS (SELECT set_id, code, count(*) AS n, max(value_num) AS hi, min(value_num) AS lo
  FROM grp JOIN facts USING (rssd_id, quarter_date) WHERE valid AND code IN (SELECT code FROM cc) GROUP BY 1, 2),
cells2 AS (SELECT g.set_id, g.rssd_id, g.quarter_date, g.name, c.category, CAST(c.code_ord AS BIGINT) AS code_ord, p.code, p.n, p.hi, p.lo,
  f.value_num AS v FROM grp g JOIN present p USING (set_id) JOIN cc c USING (code)
  LEFT JOIN facts f ON f.rssd_id = g.rssd_id AND f.quarter_date = g.quarter_date AND f.code = p.code AND f.valid)"""


def _compare_select(best: str, worst: str) -> str:
    return S.with_(S.FACTS, S.INSTITUTIONS, S.RATIO_META, _COMPARE_SQL) + f"""
SELECT set_id, rssd_id, quarter_date, array_to_string(string_split(name, ' ')[1:3], ' ') AS bank, {S.q_label('quarter_date')} AS quarter,
  x.category, code_ord, x.code, label, v AS value_num, coalesce({S.auto('v')}, '-') AS display, hi AS max_value, lo AS min_value,
  {best} AS is_best, ({worst}) AND hi <> lo AS is_worst, {ui_status_sql('x.code', 'v')} AS status
FROM cells2 x JOIN ratio_meta m ON x.code = m.code"""


_TOP = "coalesce(v = hi AND n > 1, false)"
_LOW = "coalesce(v = lo AND n > 1, false)"


def _compare_sets(spark, sf):
    ids = facts(spark, sf).select("rssd_id", "quarter_date").distinct()
    return ids.join(institutions(spark, sf), "rssd_id").select(
        F.concat_ws("-", "quarter_date", F.coalesce("state", F.lit("?"))).alias("set_id"),
        "rssd_id", "quarter_date", "name",
    )


@query("rep05_compare", _compare_select(_TOP, _LOW))
def _(spark, sf):
    return cmp.compare(_compare_sets(spark, sf), facts(spark, sf))


@query("win06_directional", _compare_select(
    f"CASE WHEN coalesce(higher_better = false, false) THEN {_LOW} ELSE {_TOP} END",
    f"CASE WHEN coalesce(higher_better = false, false) THEN {_TOP} ELSE {_LOW} END"))
def _(spark, sf):
    return cmp.compare(_compare_sets(spark, sf), facts(spark, sf), direction_aware=True)


@query("win06_best_worst", S.with_(S.FACTS, S.INSTITUTIONS, _COMPARE_SQL) + f"""
SELECT set_id, code, count(*) FILTER (WHERE {_TOP}) AS n_best, count(*) FILTER (WHERE {_LOW} AND hi <> lo) AS n_worst FROM cells2 GROUP BY 1, 2""")
def _(spark, sf):
    rows = cmp.compare(_compare_sets(spark, sf), facts(spark, sf))
    return rows.groupBy("set_id", "code").agg(
        F.count(F.when(F.col("is_best"), 1)).alias("n_best"), F.count(F.when(F.col("is_worst"), 1)).alias("n_worst")
    )


@query("agg08_min_max", S.with_(S.FACTS, S.INSTITUTIONS, _COMPARE_SQL) + "SELECT set_id, code, hi AS max_value, lo AS min_value FROM present")
def _(spark, sf):
    rows = cmp.set_extremes(_compare_sets(spark, sf), facts(spark, sf))
    return rows.select("set_id", "code", "max_value", "min_value")


@query("prj18_present_codes", S.with_(S.FACTS, S.INSTITUTIONS, _COMPARE_SQL) + """
SELECT set_id, code FROM present WHERE code IN (SELECT code FROM cc WHERE category = 'Asset Quality')""")
def _(spark, sf):
    rows = cmp.set_extremes(_compare_sets(spark, sf), facts(spark, sf)).where("category = 'Asset Quality'")
    return rows.select("set_id", "code")


_PG = f"pg(group_ord, code_ord, code, fallback_label) AS ({ref.values_sql(ref.priority_group_rows())})"
_PICKS = """picks AS (SELECT rssd_id, quarter_date, CAST(group_ord AS BIGINT) AS group_ord, arg_min(code, code_ord) AS code,
  arg_min(value_num, code_ord) AS value_num, any_value(fallback_label) AS fallback_label FROM facts JOIN pg USING (code) WHERE valid GROUP BY 1, 2, 3)"""


@query("win07_top10", S.with_(S.FACTS, _PG, _PICKS) + "SELECT * FROM picks")
def _(spark, sf):
    return ranking.summary_picks(facts(spark, sf))


# ---------------------------------------------------------------- ordering and limits

@query("srt01_trend_order", S.with_(S.FACTS) + """
SELECT rssd_id, code, quarter_date, value_raw, row_number() OVER (PARTITION BY rssd_id, code ORDER BY quarter_date DESC) AS pos FROM facts""")
def _(spark, sf):
    return facts(spark, sf).select(
        "rssd_id", "code", "quarter_date", "value_raw",
        F.row_number().over(trends.newest_first()).cast("bigint").alias("pos"),
    )


@query("srt02_priority", S.with_(S.FACTS, S.RATIO_META, f"prio(code, ord) AS ({ref.values_sql([(c, i) for i, c in enumerate(ref.PRIORITY_CODES)])})") + """
SELECT rssd_id, quarter_date, code, row_number() OVER (PARTITION BY rssd_id, quarter_date
  ORDER BY ord ASC NULLS LAST, coalesce(category, 'Other'), code) AS display_pos
FROM facts LEFT JOIN ratio_meta USING (code) LEFT JOIN prio USING (code) WHERE valid""")
def _(spark, sf):
    return ranking.display_order(fx.valid_ratios(facts(spark, sf))).select("rssd_id", "quarter_date", "code", "display_pos")


_TOP15 = S.with_(S.FACTS) + """SELECT rssd_id, quarter_date, pos, code, value_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY rssd_id, quarter_date ORDER BY code) AS pos FROM facts WHERE valid) WHERE pos <= """


@query("srt03_top15", _TOP15 + "15")
def _(spark, sf):
    return tools.get_ubpr_ratios(facts(spark, sf))


@query("tf01_ratios", _TOP15 + "15")
def _(spark, sf):
    return tools.get_ubpr_ratios(facts(spark, sf))


_PLACE = f"list_position({S.lit_list(ref.PEER_CODES)}, code)"


@query("srt04_top12", PEER_BASE + f"""
SELECT rssd_id, quarter_date, peer_group, code, place FROM (SELECT *, row_number() OVER (PARTITION BY rssd_id, quarter_date, peer_group
  ORDER BY {_PLACE}, code) AS place FROM loo WHERE peer_average IS NOT NULL) WHERE place <= 12""")
def _(spark, sf):
    rows = peers.top_peer_rows(peers.leave_one_out(facts(spark, sf), buckets=PANEL_BUCKETS))
    return rows.select("rssd_id", "quarter_date", "peer_group", "code", F.col("place").cast("bigint").alias("place"))


@query("srt08_range_listing", S.with_(S.FACTS) + """
SELECT quarter_date, rssd_id, code, value_num, pos FROM (SELECT *, row_number() OVER (PARTITION BY quarter_date, rssd_id ORDER BY value_num, code) AS pos
  FROM facts WHERE value_num BETWEEN 0.001 AND 50.0) WHERE pos <= 40""")
def _(spark, sf):
    return ranking.first_by_value(facts(spark, sf).where(F.col("value_num").between(0.001, 50.0)), 40).select(
        "quarter_date", "rssd_id", "code", "value_num", "pos"
    )


@query("srt09_quarter_list", S.with_(S.FACTS) + """
SELECT string_agg(quarter_date, ',' ORDER BY quarter_date) AS oldest_first, string_agg(quarter_date, ',' ORDER BY quarter_date DESC) AS newest_first
FROM (SELECT DISTINCT quarter_date FROM facts)""")
def _(spark, sf):
    return lifecycle.quarter_lists(facts(spark, sf))


# ---------------------------------------------------------------- set operations

@query("set01_union_missing", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, max(value_raw) FILTER (WHERE code = 'UBPRE013') AS UBPRE013,
  max(value_raw) FILTER (WHERE code = 'UBPR7414' AND quarter_date <= '19981231') AS UBPR7414,
  max(value_raw) FILTER (WHERE code = 'UBPRE600' AND quarter_date > '19981231') AS UBPRE600
FROM facts WHERE code = 'UBPRE013' OR (code = 'UBPR7414' AND quarter_date <= '19981231') OR (code = 'UBPRE600' AND quarter_date > '19981231')
GROUP BY 1, 2""")
def _(spark, sf):
    f = facts(spark, sf)
    old = fx.wide(f.where("quarter_date <= '19981231'"), ["UBPRE013", "UBPR7414"])
    new = fx.wide(f.where("quarter_date > '19981231'"), ["UBPRE013", "UBPRE600"])
    return fx.union_quarters(old, new)


@query("set04_intersect", S.with_(S.FACTS) + f"""
SELECT rssd_id, quarter_date, string_agg(code, ',' ORDER BY {_PLACE}) AS peer_codes FROM facts WHERE valid AND code IN {_PEERS} GROUP BY 1, 2""")
def _(spark, sf):
    return fx.listed_codes(fx.valid_ratios(facts(spark, sf)), ref.PEER_CODES, "peer_codes")


# ---------------------------------------------------------------- table functions and reports

@query("tf02_peer_comparison", PEER_BASE + f"""
SELECT rssd_id, quarter_date, peer_group, place AS pos, code, {S.fixed('bank_value', 2)} AS bank, {S.fixed('peer_average', 2)} AS peer_avg,
  (CASE WHEN bank_value - peer_average >= 0 THEN '+' ELSE '' END) || {S.fixed('(bank_value - peer_average)', 2)} AS diff
FROM (SELECT *, row_number() OVER (PARTITION BY rssd_id, quarter_date ORDER BY {_PLACE}, code) AS place
  FROM loo WHERE peer_average IS NOT NULL AND peer_group = 'size:community') WHERE place <= 12""")
def _(spark, sf):
    return tools.get_peer_comparison(facts(spark, sf), "community", buckets=PANEL_BUCKETS)


@query("tf03_trend", S.with_(S.FACTS) + """
SELECT rssd_id, code, quarter_date, value_raw FROM facts WHERE code IN ('UBPRE013', 'UBPRE018') AND quarter_date BETWEEN '19960331' AND '20001231'""")
def _(spark, sf):
    return tools.get_ubpr_trend(facts(spark, sf), "19960331", "20001231", " UBPRE013,, UBPRE018 ")


_LINE = f"""rule_label || ' (' || code || '): ' || {S.fixed('value_num', 2)} || '% — ' || status || ' (min: ' || {S.fixed('minimum', 1)}
  || '%, well-cap: ' || {S.fixed('well', 1)} || '%)'"""
_REG = _AGENT + f"SELECT rssd_id, quarter_date, code, rule_label, value_num, minimum, well, status, {_LINE} AS line FROM checked"


@query("tf04_regulatory_lines", _REG)
def _(spark, sf):
    return tools.flag_regulatory_issues(facts(spark, sf))


@query("rep10_regulatory", _REG)
def _(spark, sf):
    return reports.regulatory_report(facts(spark, sf))


@query("rep10_alerts", _AGENT + """
SELECT quarter_date, status, count(*) AS n_ratios, count(DISTINCT rssd_id) AS n_banks FROM checked WHERE status <> 'WELL-CAPITALIZED' GROUP BY 1, 2""")
def _(spark, sf):
    low = regulatory.regulatory_status(facts(spark, sf), "agent").where("status <> 'WELL-CAPITALIZED'")
    per_bank = low.groupBy("quarter_date", "status", "rssd_id").agg(F.count(F.lit(1)).alias("n"))
    return per_bank.groupBy("quarter_date", "status").agg(
        F.sum("n").alias("n_ratios"), F.count(F.lit(1)).alias("n_banks")
    )


@query("rep01_key_ratios", S.with_(S.FACTS, S.RATIO_META, f"prio(code, ord) AS ({ref.values_sql([(c, i) for i, c in enumerate(ref.PRIORITY_CODES)])})") + """
SELECT rssd_id, quarter_date, row_number() OVER (PARTITION BY rssd_id, quarter_date
  ORDER BY ord ASC NULLS LAST, coalesce(category, 'Other'), code) AS display_pos,
  code, coalesce(label, code) AS label, coalesce(category, 'Other') AS category, value_raw, value_num
FROM facts LEFT JOIN ratio_meta USING (code) LEFT JOIN prio USING (code) WHERE valid""")
def _(spark, sf):
    return reports.key_ratios(facts(spark, sf))


@query("rep02_trend", S.with_(S.FACTS, S.RATIO_META) + f"""
, picked AS (SELECT * FROM facts WHERE code IN {S.in_list(ref.DEFAULT_TREND_CODES)} AND quarter_date BETWEEN '20000331' AND '20011231' AND value_num IS NOT NULL),
lagged AS (SELECT *, lag(value_num) OVER (PARTITION BY rssd_id, code ORDER BY quarter_date) AS prev_value FROM picked),
changes AS (SELECT *, {S.rnd('(value_num - prev_value)', 6)} AS change FROM lagged)
SELECT rssd_id, code, label, quarter_date, {S.q_label('quarter_date')} AS quarter, value_num, prev_value, change, {_GOOD} AS change_is
FROM changes LEFT JOIN ratio_meta USING (code)""".lstrip())
def _(spark, sf):
    return reports.trend(facts(spark, sf), ref.DEFAULT_TREND_CODES, "20011231", "20000331")


@query("rep03_peer_all", PEER_BASE.rstrip() + ", " + S.RATIO_META + f"""
SELECT rssd_id, quarter_date, peer_group, code, label, category, bank_value, peer_average, n_peers, difference,
  CASE WHEN (coalesce(higher_better, false) AND difference >= 0) OR (NOT coalesce(higher_better, false) AND difference <= 0) THEN 'Above' ELSE 'Below' END AS position,
  {ui_status_sql('code', 'bank_value')} AS status
FROM (SELECT *, {S.rnd('(bank_value - peer_average)', 6)} AS difference FROM loo WHERE peer_average IS NOT NULL) LEFT JOIN ratio_meta USING (code)""")
def _(spark, sf):
    return reports.peer_comparison(facts(spark, sf), buckets=PANEL_BUCKETS)


@query("sc29_peer_position", PEER_BASE.rstrip() + ", " + S.RATIO_META + """
SELECT quarter_date, peer_group, code, position, count(*) AS n FROM (
  SELECT *, CASE WHEN (coalesce(higher_better, false) AND difference >= 0) OR (NOT coalesce(higher_better, false) AND difference <= 0) THEN 'Above' ELSE 'Below' END AS position
  FROM (SELECT *, bank_value - peer_average AS difference FROM loo WHERE peer_average IS NOT NULL) LEFT JOIN ratio_meta USING (code)) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    rows = reports.peer_comparison(facts(spark, sf), buckets=PANEL_BUCKETS)
    return rows.groupBy("quarter_date", "peer_group", "code", "position").agg(F.count(F.lit(1)).alias("n"))


@query("rep04_summary", PEER_BASE.rstrip() + ", " + ", ".join([S.RATIO_META, _PG, _PICKS, _QOQ]) + _CHANGES + f"""
, joined AS (SELECT p.*, c.change, l.peer_average, {ui_status_sql('p.code', 'p.value_num')} AS status FROM picks p
  LEFT JOIN changes c ON c.rssd_id = p.rssd_id AND c.quarter_date = p.quarter_date AND c.code = p.code
  LEFT JOIN loo l ON l.rssd_id = p.rssd_id AND l.quarter_date = p.quarter_date AND l.code = p.code AND l.peer_group = 'all')
SELECT rssd_id, quarter_date, group_ord, j.code, coalesce(label, j.code) AS label, coalesce(category, 'Other') AS category, value_num, {S.auto('value_num')} AS display,
  coalesce({S.fixed('change', 2)}, '-') AS qoq_change,
  coalesce({S.fixed(S.rnd('(value_num - peer_average)', 6), 2)}, '-') AS vs_peers, status,
  coalesce({ui_label_sql('status')}, 'N/A') AS status_label
FROM joined j LEFT JOIN ratio_meta m ON m.code = j.code""")
def _(spark, sf):
    return reports.executive_summary(facts(spark, sf), PANEL_BUCKETS)
