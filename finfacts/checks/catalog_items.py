"""Queries over filing line items, institutions and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts import reference_data as ref
from finfacts.checks import roundtrip, sqltext as S
from finfacts.checks.registry import query
from finfacts.functions import numeric as num, periods as per, text as txt
from finfacts.operators import items as it, search
from finfacts.plans import exports, reports, tools
from finfacts.sources import sdf
from finfacts.sources.panel import facts, institutions, line_items, table

FULL_SPAN = ("19950331", "20011231")
KEYS = per.quarter_keys(*FULL_SPAN)
PERIODS = [f"{k[4:6]}/{k[6:]}/{k[:4]}" for k in KEYS]
BASE = S.with_(S.ITEMS)
VARIANT_CODES = [c for _, codes in ref.METRIC_VARIANTS for c in codes]


def _periods(spark, sf):
    """The panel's own calendar: every quarter between the first and the last that a line has."""
    # Two dates are read from one column; the keys are made of them.
    days = table(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    span = days.select(per.quarter_end("a").alias("a"), per.quarter_end("b").alias("b")).first()
    return [f"{k[4:6]}/{k[6:]}/{k[:4]}" for k in (per.quarter_keys(span.a, span.b) if span.a else [])]


def items(spark, sf):
    return it.with_section(line_items(spark, sf))


# ---------------------------------------------------------------- parsing

_SLICE = f"l_orderkey // {roundtrip.KEYS_PER_SLICE}, l_partkey // {roundtrip.KEYS_PER_SLICE}"
_SDF = BASE + f"""SELECT reporting_period AS call_date, rssd_id AS bank_rssd, item_code, value, last_update, description, section, line_number,
  source_line_number, concat_ws(';', reporting_period, rssd_id, item_code, value, last_update, description, schedule, line_number) AS raw
FROM (SELECT reporting_period, rssd_id, trim(item_code) AS item_code, trim(value_raw) AS value, last_update, description, section, schedule, line_number,
  row_number() OVER (PARTITION BY rssd_id, reporting_period, {_SLICE} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) + 1 AS source_line_number
  FROM items)"""
_SDF_COLUMNS = ["call_date", "bank_rssd", "item_code", "value", "last_update", "description", "section", "line_number", "raw"]


@query("src06_sdf_roundtrip", _SDF)
def _(spark, sf):
    docs = roundtrip.sdf_documents(line_items(spark, sf))
    return sdf.parse_documents(docs).select(
        *_SDF_COLUMNS, F.col("source_line_number").cast("bigint").alias("source_line_number")
    )


@query("src05_decode", _SDF)
def _(spark, sf):
    """The same documents arriving base64-coded, every other one wrapped in a JSON string."""
    docs = roundtrip.sdf_documents(line_items(spark, sf))
    coded = F.base64(F.encode("text", "UTF-8"))
    coded = F.regexp_replace(coded, "[\r\n]", "")
    wrapped = F.when(F.col("slice_b") % 2 == 0, F.concat(F.lit(' "'), coded, F.lit('"'))).otherwise(coded)
    payloads = docs.withColumn("text", wrapped)
    decoded = payloads.withColumn("text", sdf.decode_payload("text"))
    return sdf.parse_documents(decoded).select(
        *_SDF_COLUMNS, F.col("source_line_number").cast("bigint").alias("source_line_number")
    )


# ---------------------------------------------------------------- aggregates over items

@query("agg03_first", BASE + """
SELECT rssd_id, reporting_period, upper(trim(item_code)) AS item_code, arg_min(value_raw, ord) AS value_raw
FROM items WHERE trim(item_code) <> '' GROUP BY 1, 2, 3""")
def _(spark, sf):
    return it.first_values(line_items(spark, sf))


@query("agg04_last", BASE + """
SELECT rssd_id, reporting_period, item_code, arg_max(value_raw, ord) AS value_raw FROM items GROUP BY 1, 2, 3""")
def _(spark, sf):
    return it.last_values(line_items(spark, sf))


_SECTION_LIST = BASE + """
SELECT rssd_id, reporting_period, string_agg(section, ', ' ORDER BY section) AS sections
FROM (SELECT DISTINCT rssd_id, reporting_period, section FROM items WHERE section IS NOT NULL) GROUP BY 1, 2"""


@query("agg05_sections", _SECTION_LIST)
def _(spark, sf):
    return it.section_list(items(spark, sf))


@query("tf08_schedules", _SECTION_LIST)
def _(spark, sf):
    return tools.get_available_schedules(items(spark, sf))


_LABELS = """labels2 AS (SELECT rssd_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || rssd_id || ')' ELSE name END AS bank_label
  FROM (SELECT rssd_id, CASE WHEN CAST(rssd_id AS BIGINT) < 3 THEN 'Same Name Bank' ELSE name END AS name FROM institutions))"""


def _renamed(spark, sf):
    return institutions(spark, sf).withColumn(
        "name", F.when(F.col("rssd_id").cast("bigint") < 3, "Same Name Bank").otherwise(F.col("name"))
    )


@query("agg06_pivot_cells", S.with_(S.ITEMS, S.INSTITUTIONS, _LABELS) + """
SELECT section, item_code, c.rssd_id, reporting_period, coalesce(bank_label, c.rssd_id) || chr(10) || reporting_period AS col_key,
  coalesce(bank_label, c.rssd_id) || ' · ' || reporting_period AS header, description, value
FROM (SELECT section, item_code, rssd_id, reporting_period, arg_min(description, ord) AS description, arg_max(value_raw, ord) AS value
  FROM items WHERE section IS NOT NULL GROUP BY 1, 2, 3, 4) c LEFT JOIN labels2 l ON l.rssd_id = c.rssd_id""")
def _(spark, sf):
    return it.report_cells(items(spark, sf), _renamed(spark, sf))


@query("sc30_column_keys", S.with_(S.ITEMS, S.INSTITUTIONS, _LABELS) + """
SELECT 'banks' AS mode, coalesce(bank_label, i.rssd_id) AS col_key, count(DISTINCT (section, item_code, i.rssd_id, reporting_period)) AS n_cells
  FROM items i LEFT JOIN labels2 l ON l.rssd_id = i.rssd_id WHERE section IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'periods', reporting_period, count(DISTINCT (section, item_code, rssd_id, reporting_period))
  FROM items WHERE section IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    i, b = items(spark, sf), _renamed(spark, sf)
    count = lambda mode, rows: rows.groupBy(F.lit(mode).alias("mode"), "col_key").agg(F.count(F.lit(1)).alias("n_cells"))
    return count("banks", it.report_cells(i, b, True, False)).unionByName(
        count("periods", it.report_cells(i, b, False, True))
    )


_PIVOT = "SELECT rssd_id, section, item_code, arg_min(description, ROW(ord, description)) AS description, " + ", ".join(
    f"arg_max(value_raw, ord) FILTER (WHERE reporting_period = '{p}') AS \"{p}\"" for p in PERIODS
) + " FROM {src} WHERE section IS NOT NULL GROUP BY 1, 2, 3"


@query("agg06_pivot", BASE + _PIVOT.format(src="items"))
def _(spark, sf):
    return it.report_by_period(items(spark, sf), _periods(spark, sf))


@query("agg09_counts", BASE + """
SELECT rssd_id, reporting_period, count(*) AS n_rows, count(DISTINCT item_code) AS n_codes, count(DISTINCT section) AS n_sections FROM items GROUP BY 1, 2""")
def _(spark, sf):
    return it.filing_counts(items(spark, sf))


_VARIANTS = f"variants(metric, variant_ord, item_code) AS ({ref.values_sql(ref.metric_variant_rows())})"
_BASE_VALUES = f"""firsts AS (SELECT rssd_id, reporting_period, upper(trim(item_code)) AS item_code, arg_min(value_raw, ord) AS value_raw
    FROM items WHERE trim(item_code) <> '' GROUP BY 1, 2, 3),
picked AS (SELECT rssd_id, reporting_period, metric, arg_min(v, variant_ord) AS v FROM
   (SELECT f.*, metric, variant_ord, {S.lenient('value_raw')} AS v FROM firsts f JOIN variants USING (item_code)) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
based AS (SELECT rssd_id, reporting_period, """ + ", ".join(
    f"max(v) FILTER (WHERE metric = '{m}') AS {m}" for m, _ in ref.METRIC_VARIANTS
) + " FROM picked GROUP BY 1, 2)"
_METRICS = f"""totals AS (SELECT rssd_id, reporting_period, count(*) AS total_rows FROM items GROUP BY 1, 2),
resid AS (SELECT *, CASE WHEN coalesce(res_1_4, multifamily, construction) IS NOT NULL
  THEN coalesce(res_1_4, 0) + coalesce(multifamily, 0) + coalesce(construction, 0) END AS residential_total FROM based),
metrics AS (SELECT t.rssd_id, t.reporting_period, total_rows, total_assets, total_loans, total_deposits, total_equity, net_income, residential_total,
  residential_total / nullif(total_loans, 0) AS residential_ratio, total_equity / nullif(total_assets, 0) AS equity_to_assets,
  total_loans / nullif(total_deposits, 0) AS loans_to_deposits
  FROM totals t LEFT JOIN resid r ON r.rssd_id = t.rssd_id AND r.reporting_period = t.reporting_period)"""
_METRIC_CTES = S.with_(S.ITEMS, _VARIANTS, _BASE_VALUES, _METRICS)


@query("rep07_metrics", _METRIC_CTES + "SELECT * FROM metrics")
def _(spark, sf):
    return it.metrics(items(spark, sf))


@query("win09_variants", S.with_(S.ITEMS, _VARIANTS, _BASE_VALUES) + """
SELECT rssd_id, reporting_period, res_1_4, multifamily, construction, net_income FROM based""")
def _(spark, sf):
    # Filings with a known code but no number in it have a row of NULLs; the oracle lists numbers only.
    rows = it.variant_values(line_items(spark, sf))
    anything = F.coalesce(*[F.col(m) for m, _ in ref.METRIC_VARIANTS]).isNotNull()
    return rows.where(anything).select("rssd_id", "reporting_period", "res_1_4", "multifamily", "construction", "net_income")


@query("agg11_sum_nonnull", S.with_(S.ITEMS, _VARIANTS, _BASE_VALUES, _METRICS) + """
SELECT rssd_id, reporting_period, residential_total FROM metrics WHERE residential_total IS NOT NULL""")
def _(spark, sf):
    return it.metrics(items(spark, sf)).where("residential_total IS NOT NULL").select(
        "rssd_id", "reporting_period", "residential_total"
    )


def _metric_rows_sql() -> str:
    parts = []
    for i, (m, group, label, unit) in enumerate(ref.METRIC_META, 1):
        shown = S.percent(f"({m} * 100.0::DOUBLE)") if unit == "fraction" else f"coalesce({S.grouped(m, 0)}, '-')"
        tool = (f"CASE WHEN {m} IS NULL THEN 'N/A' ELSE {S.percent(f'({m} * 100.0::DOUBLE)')} END" if unit == "fraction"
                else S.money_tool(m))
        parts.append(
            f"SELECT rssd_id, reporting_period, {i}::BIGINT AS metric_ord, '{m}' AS metric, '{group}' AS metric_group,"
            f" '{label}' AS label, {shown} AS display, {tool} AS text FROM metrics"
        )
    return "metric_rows AS (" + " UNION ALL ".join(parts) + ")"


_METRIC_ROWS = _METRIC_CTES.rstrip() + ", " + _metric_rows_sql()


@query("agg14_metric_matrix", _METRIC_ROWS + " SELECT rssd_id, metric_group, metric_ord, metric, label, " + ", ".join(
    f"max(display) FILTER (WHERE reporting_period = '{p}') AS \"{p}\"" for p in PERIODS
) + " FROM metric_rows GROUP BY 1, 2, 3, 4, 5")
def _(spark, sf):
    return it.metric_matrix(it.metrics(items(spark, sf)), _periods(spark, sf))


@query("tf06_metrics", _METRIC_ROWS + " SELECT rssd_id, reporting_period, metric_ord, metric, text FROM metric_rows")
def _(spark, sf):
    return tools.get_bank_metrics(items(spark, sf))


# ---------------------------------------------------------------- sections, fields, search

_ASKED = ["RC", "RI", "RC-C", "RC-X"]


@query("prj09_sections", BASE + f"""
, asked(section) AS ({ref.values_sql([(s,) for s in _ASKED])})
SELECT f.rssd_id, f.reporting_period, a.section, count(i.section) AS n_rows
FROM (SELECT DISTINCT rssd_id, reporting_period FROM items) f CROSS JOIN asked a
LEFT JOIN items i ON i.rssd_id = f.rssd_id AND i.reporting_period = f.reporting_period AND i.section = a.section GROUP BY 1, 2, 3""".lstrip())
def _(spark, sf):
    return it.requested_sections(items(spark, sf), _ASKED)


_TERMS = ["RCON14", " net ", "12ABC", "securities", "%"]


@query("prj10_search", BASE + f"""
, terms(term) AS ({ref.values_sql([(t,) for t in _TERMS])})
SELECT rssd_id, reporting_period, item_code, description, value_raw, line_number, term FROM items JOIN terms
ON contains(lower(item_code), lower(trim(term))) OR contains(lower(description), lower(trim(term))) OR contains(lower(value_raw), lower(trim(term)))""".lstrip())
def _(spark, sf):
    return it.search(line_items(spark, sf), _TERMS).select(
        "rssd_id", "reporting_period", "item_code", "description", "value_raw", "line_number", "term"
    )


_BANK_TERMS = ["supplier", "00000001", "7", "nation_1", ""]


def _match_sql(extra: str, limit: int, blank: bool) -> str:
    return S.with_(S.INSTITUTIONS) + f"""
, terms(term) AS ({ref.values_sql([(t,) for t in _BANK_TERMS])})
SELECT term, pos, rssd_id, name, city, state FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY CAST(rssd_id AS BIGINT)) AS pos FROM institutions JOIN terms
  ON (term <> '' AND (contains(lower(name), lower(term)) OR contains(rssd_id, term){extra})){' OR term = ' + chr(39) * 2 if blank else ''}) WHERE pos <= {limit}""".lstrip()


@query("prj11_institution_match", _match_sql("", 80, False))
def _(spark, sf):
    return search.match_institutions(institutions(spark, sf), _BANK_TERMS).select("term", "pos", "rssd_id", "name", "city", "state")


@query("prj11_sidebar_match", _match_sql(" OR contains(lower(city), lower(term))", 100, True))
def _(spark, sf):
    return search.match_institutions(
        institutions(spark, sf), _BANK_TERMS, with_city=True, limit=100, blank_matches_all=True
    ).select("term", "pos", "rssd_id", "name", "city", "state")


@query("prj15_wanted_codes", BASE + f"""
, wanted(code, o) AS ({ref.values_sql([(c, i) for i, c in enumerate([*VARIANT_CODES, 'RCFD0000'])])}),
has AS (SELECT b.rssd_id, w.code, w.o, EXISTS (SELECT 1 FROM items i WHERE i.rssd_id = b.rssd_id AND i.item_code = w.code) AS present
  FROM (SELECT DISTINCT rssd_id FROM items) b CROSS JOIN wanted w)
SELECT rssd_id, coalesce(string_agg(code, ',' ORDER BY o) FILTER (WHERE present), '') AS present,
  coalesce(string_agg(code, ',' ORDER BY o) FILTER (WHERE NOT present), '') AS missing,
  count(*) FILTER (WHERE present) AS n_present, count(*) FILTER (WHERE NOT present) AS n_missing FROM has GROUP BY 1""".lstrip())
def _(spark, sf):
    return it.wanted_codes(line_items(spark, sf), [*VARIANT_CODES, "RCFD0000"])


@query("prj16_catalog", BASE + """
SELECT rssd_id, reporting_period, section || '::' || item_code AS id, item_code, description, value_raw AS value, line_number, section, last_update
FROM items WHERE section IS NOT NULL""")
def _(spark, sf):
    return it.field_catalog(items(spark, sf))


_TOP_ROWS = BASE + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY rssd_id, reporting_period, section
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS pos,
  count(*) OVER (PARTITION BY rssd_id, reporting_period, section) AS section_rows FROM items WHERE section IS NOT NULL)
SELECT rssd_id, reporting_period, section, pos, item_code, substr(description, 1, 48) AS description, value_raw AS value, section_rows,
  greatest(section_rows - 10, 0) AS n_more FROM ranked WHERE pos <= 10""".lstrip()


@query("srt05_top10_schedule", _TOP_ROWS)
def _(spark, sf):
    return it.top_rows(items(spark, sf))


@query("tf07_schedule_data", _TOP_ROWS + " AND section IN ('RC', 'RI', 'RC-C')")
def _(spark, sf):
    return tools.get_schedule_data(items(spark, sf), "RC, RI,,RC-C")


@query("prj19_short_text", BASE + """
SELECT DISTINCT description, substr(description, 1, 48) AS short_text, length(substr(description, 1, 48))::BIGINT AS n FROM items""")
def _(spark, sf):
    short = F.substring("description", 1, 48)
    return line_items(spark, sf).select(
        "description", short.alias("short_text"), F.length(short).cast("bigint").alias("n")
    ).distinct()


@query("set05_sections", BASE + "SELECT DISTINCT section FROM items WHERE section IS NOT NULL")
def _(spark, sf):
    return it.all_sections(items(spark, sf))


_GRID = ["12/31/2000", "09/30/2001", "12/31/2001", "03/31/2002"]


@query("jn04_cross_missing", S.with_(S.ITEMS, S.INSTITUTIONS) + f"""
, asked(reporting_period) AS ({ref.values_sql([(p,) for p in _GRID])}),
filed AS (SELECT rssd_id, reporting_period, count(*) AS n FROM items GROUP BY 1, 2)
SELECT b.rssd_id, a.reporting_period, b.name, coalesce(n, 0) AS n_rows, n IS NULL AS is_missing FROM institutions b CROSS JOIN asked a
LEFT JOIN filed f ON f.rssd_id = b.rssd_id AND f.reporting_period = a.reporting_period""".lstrip())
def _(spark, sf):
    return it.bank_period_grid(institutions(spark, sf), line_items(spark, sf), _GRID)


_OVER = """overrides AS (SELECT CAST(s_suppkey AS VARCHAR) AS rssd_id FROM supplier WHERE s_acctbal < 3000)"""
_SELECTED = f"""chosen AS (SELECT i.* FROM items i WHERE item_code IN {S.in_list(VARIANT_CODES)}
  AND (i.rssd_id NOT IN (SELECT rssd_id FROM overrides) OR item_code LIKE 'RCFD%'))"""


def _chosen(spark, sf):
    allowed = [c for c in VARIANT_CODES if c.startswith("RCFD")]
    overrides = table(spark, sf, "supplier").where("s_acctbal < 3000").select(
        F.col("s_suppkey").cast("string").alias("rssd_id"),
        F.explode(F.array(*map(F.lit, allowed))).alias("item_code"),
    )
    return it.select_fields(items(spark, sf), VARIANT_CODES, overrides)


@query("jn11_field_selection", S.with_(S.ITEMS, _OVER, _SELECTED) + """
SELECT rssd_id, reporting_period, item_code, value_raw, line_number, last_update FROM chosen""")
def _(spark, sf):
    return _chosen(spark, sf).select("rssd_id", "reporting_period", "item_code", "value_raw", "line_number", "last_update")


@query("rep08_custom", S.with_(S.ITEMS, _OVER, _SELECTED) + _PIVOT.format(src="chosen"))
def _(spark, sf):
    return it.report_by_period(_chosen(spark, sf), _periods(spark, sf))


@query("rep09_section_browser", BASE + f"""
SELECT s.*, CASE WHEN section IN {S.in_list(ref.BALANCE_SHEET_SCHEDULES)} THEN 'Balance Sheet' WHEN section IN {S.in_list(ref.INCOME_SCHEDULES)} THEN 'Income' ELSE 'Other' END AS family, total_rows
FROM (SELECT rssd_id, reporting_period, section, count(*) AS n_rows FROM items WHERE section IS NOT NULL GROUP BY 1, 2, 3) s
JOIN (SELECT rssd_id, reporting_period, count(*) AS total_rows FROM items GROUP BY 1, 2) t
  ON t.rssd_id = s.rssd_id AND t.reporting_period = s.reporting_period""")
def _(spark, sf):
    return reports.section_browser(items(spark, sf))


# ---------------------------------------------------------------- exports as text

@query("snk05_call_summary", S.with_(S.ITEMS, S.INSTITUTIONS, _VARIANTS, _BASE_VALUES, _METRICS) + f"""
, seclist AS (SELECT rssd_id, reporting_period, string_agg(section, ', ' ORDER BY section) AS sections
  FROM (SELECT DISTINCT rssd_id, reporting_period, section FROM items WHERE section IS NOT NULL) GROUP BY 1, 2)
SELECT m.rssd_id, m.reporting_period, concat_ws(chr(10), '# Call Report Summary', '', '**Institution:** ' || coalesce(name, m.rssd_id), '**RSSD ID:** ' || m.rssd_id,
  '**Reporting Period:** ' || m.reporting_period, '', '## Key Metrics', '| Metric | Value |', '| --- | --- |',
  """.lstrip() + ", ".join(
    f"'| {label} | ' || {S.money_tool(m)} || ' |'" for label, m in [
        ("Total Assets", "total_assets"), ("Total Loans", "total_loans"), ("Total Deposits", "total_deposits"),
        ("Total Equity", "total_equity"), ("Net Income", "net_income")]
) + ", '', '## Computed Ratios', '| Ratio | Value |', '| --- | --- |', " + ", ".join(
    f"'| {label} | ' || {S.percent(f'({m} * 100.0::DOUBLE)')} || ' |'" for label, m in [
        ("Equity-to-Assets", "equity_to_assets"), ("Loans-to-Deposits", "loans_to_deposits")]
) + """, '', '## Available Schedules', coalesce(sections, '')) AS report
FROM metrics m LEFT JOIN seclist s ON s.rssd_id = m.rssd_id AND s.reporting_period = m.reporting_period
LEFT JOIN institutions i ON i.rssd_id = m.rssd_id""")
def _(spark, sf):
    return exports.call_summary(items(spark, sf), institutions(spark, sf))


# ---------------------------------------------------------------- scalar rules over item and fact texts

_TEXTS = S.with_(S.FACTS, S.ITEMS) + ", texts2 AS (SELECT value_raw AS t FROM facts UNION SELECT value_raw FROM items) "


def texts(spark, sf):
    one = facts(spark, sf).select(F.col("value_raw").alias("t"))
    return one.union(line_items(spark, sf).select("value_raw")).distinct()


@query("sc01_strict", _TEXTS + f"SELECT t, {S.strict('t')} AS v FROM texts2")
def _(spark, sf):
    return texts(spark, sf).select("t", num.strict_number("t").alias("v"))


@query("sc02_lenient", _TEXTS + f"SELECT t, {S.lenient('t')} AS v FROM texts2")
def _(spark, sf):
    return texts(spark, sf).select("t", num.lenient_number("t").alias("v"))


@query("sc03_prefix", _TEXTS + f"SELECT t, {S.prefix('t')} AS v FROM texts2")
def _(spark, sf):
    return texts(spark, sf).select("t", num.prefix_number("t").alias("v"))


@query("sc04_valid", _TEXTS + f"SELECT t, {S.is_ratio('t')} AS v FROM texts2")
def _(spark, sf):
    return texts(spark, sf).select("t", num.is_ratio("t").alias("v"))


@query("sc05_divide", S.with_(S.ITEMS) + f"""
SELECT rssd_id, last_update, line_number, {S.lenient('value_raw')} / nullif(CAST(l_linenumber - 4 AS DOUBLE), 0) AS ratio FROM items""")
def _(spark, sf):
    return line_items(spark, sf).select(
        "rssd_id", "last_update", "line_number",
        num.safe_divide(num.lenient_number("value_raw"), (F.col("ord.l_linenumber") - 4).cast("double")).alias("ratio"),
    )


_X = "(" + S.lenient("t") + " * 1.7::DOUBLE / 3.0::DOUBLE)"


@query("sc06_round", _TEXTS + f"""
SELECT t, {S.rnd('x', 6)} AS r6, {S.rnd('x', 4)} AS r4, {S.rnd('x', 2)} AS r2 FROM (SELECT t, {_X} AS x FROM texts2)""")
def _(spark, sf):
    x = num.lenient_number("t") * 1.7 / 3.0
    return texts(spark, sf).select(
        "t", *[num.round_half_up(x, n).alias(f"r{n}") for n in (6, 4, 2)]
    )


@query("sc07_schedule", BASE + f"""
SELECT DISTINCT s, {S.schedule('s')} AS section FROM (SELECT CASE l_orderkey % 4 WHEN 0 THEN ' ' || lower(schedule) WHEN 1 THEN schedule || 'B '
  WHEN 2 THEN schedule || '-' || CAST(l_linenumber AS VARCHAR) ELSE schedule END AS s FROM items)""")
def _(spark, sf):
    variant = F.col("ord.l_orderkey") % 4
    s = (
        F.when(variant == 0, F.concat(F.lit(" "), F.lower("schedule")))
        .when(variant == 1, F.concat("schedule", F.lit("B ")))
        .when(variant == 2, F.concat("schedule", F.lit("-"), F.col("ord.l_linenumber").cast("string")))
        .otherwise(F.col("schedule"))
    )
    return line_items(spark, sf).select(s.alias("s")).distinct().withColumn("section", txt.normalize_schedule("s"))


@query("sc08_family", BASE + f"""
SELECT section, CASE WHEN section IN {S.in_list(ref.BALANCE_SHEET_SCHEDULES)} THEN 'Balance Sheet' WHEN section IN {S.in_list(ref.INCOME_SCHEDULES)} THEN 'Income' ELSE 'Other' END AS family,
  count(*) AS n FROM items WHERE section IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    rows = items(spark, sf).where(F.col("section").isNotNull())
    return rows.groupBy("section", txt.schedule_family("section").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("sc09_local_name", S.with_(S.FACTS) + r"""
SELECT DISTINCT tag, regexp_extract(tag, '([^}:]+)$', 1) AS code FROM (
  SELECT CASE CAST(rssd_id AS BIGINT) % 3 WHEN 0 THEN '{http://example.org/a:b}' || code WHEN 1 THEN 'u:' || code ELSE code END AS tag FROM facts)""")
def _(spark, sf):
    k = F.col("rssd_id").cast("bigint") % 3
    tag = (
        F.when(k == 0, F.concat(F.lit("{http://example.org/a:b}"), "code"))
        .when(k == 1, F.concat(F.lit("u:"), "code")).otherwise(F.col("code"))
    )
    return facts(spark, sf).select(tag.alias("tag")).distinct().withColumn("code", txt.local_name("tag"))


@query("sc10_entity_id", S.with_(S.FACTS) + r"""
SELECT DISTINCT member, nullif(regexp_extract(member, 'FI ([0-9]+)\(ID RSSD\)', 1), '') AS rssd_id FROM (
  SELECT 'x/FI ' || rssd_id || CASE WHEN CAST(rssd_id AS BIGINT) % 4 = 0 THEN '(ID) ' ELSE '(ID RSSD) ' END || quarter_date || '.xml' AS member FROM facts)""")
def _(spark, sf):
    mark = F.when(F.col("rssd_id").cast("bigint") % 4 == 0, "(ID) ").otherwise("(ID RSSD) ")
    member = F.concat(F.lit("x/FI "), "rssd_id", mark, "quarter_date", F.lit(".xml"))
    return facts(spark, sf).select(member.alias("member")).distinct().withColumn("rssd_id", txt.entity_id("member"))


_NAMES = """names AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'First National ' || p_name || ' Bank, N.A.' WHEN 1 THEN 'The ' || p_name || ' & Trust Co'
   WHEN 2 THEN upper(p_name) || '  HOLDINGS   of ' || p_type WHEN 3 THEN p_name || '''s Savings & Loan Corp.' ELSE p_name || ' ' || p_brand || ' federal' END AS name FROM part)"""
_WORDS = (
    "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(name), '['',.&]', ' ', 'g'), "
    f"'\\b({'|'.join(ref.NAME_STOP_WORDS)})\\b', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"
)


def _names(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("First National "), "p_name", F.lit(" Bank, N.A.")))
        .when(k == 1, F.concat(F.lit("The "), "p_name", F.lit(" & Trust Co")))
        .when(k == 2, F.concat(F.upper("p_name"), F.lit("  HOLDINGS   of "), "p_type"))
        .when(k == 3, F.concat("p_name", F.lit("'s Savings & Loan Corp.")))
        .otherwise(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" federal")))
    )
    return p.select(name.alias("name")).distinct()


@query("sc11_name_norm", S.with_(_NAMES) + f"""
SELECT name, array_to_string({_WORDS}, ' ') AS words, regexp_replace(array_to_string({_WORDS}[1:2], ''), '[^a-z0-9]', '', 'g') AS slug,
  array_to_string(list_transform({_WORDS}[1:2], lambda w: upper(w[1])), '') AS initials FROM names""")
def _(spark, sf):
    return _names(spark, sf).select(
        "name", F.array_join(txt.name_words("name"), " ").alias("words"),
        txt.name_slug("name").alias("slug"), txt.name_initials("name").alias("initials"),
    )


@query("sc12_short_name", S.with_(_NAMES) + r"""
SELECT name, array_to_string(string_split(regexp_replace(trim(name), '\s+', ' ', 'g'), ' ')[1:3], ' ') AS short FROM names""")
def _(spark, sf):
    return _names(spark, sf).select("name", txt.short_name("name").alias("short"))


_SCALED = f"""scaled AS (SELECT DISTINCT value_raw, l_linenumber, {S.lenient('value_raw')} * power(31.0::DOUBLE, l_linenumber) / 7.0::DOUBLE AS x FROM items)"""


def _amounts(spark, sf):
    """Amounts from cents to quadrillions: item values times a power of their line number."""
    n = F.col("ord.l_linenumber")
    return line_items(spark, sf).select(
        "value_raw", n.alias("l_linenumber"),
        (num.lenient_number("value_raw") * F.pow(F.lit(31.0), n) / 7.0).alias("x"),
    ).distinct()


@query("sc13_money", S.with_(S.ITEMS, _SCALED) + f"SELECT value_raw, l_linenumber, {S.money('x')} AS ui, {S.money_tool('x')} AS tool FROM scaled")
def _(spark, sf):
    return _amounts(spark, sf).select("value_raw", "l_linenumber", num.money_text("x").alias("ui"), num.money_tool_text("x").alias("tool"))


@query("sc14_percent", _TEXTS + f"""
SELECT t, {S.percent(S.prefix('t'))} AS pct, {S.percent('(' + S.lenient('t') + ' * 100.0::DOUBLE)')} AS fraction_pct FROM texts2""")
def _(spark, sf):
    return texts(spark, sf).select(
        "t", num.percent_text(num.prefix_number("t")).alias("pct"),
        num.fraction_percent_text(num.lenient_number("t")).alias("fraction_pct"),
    )


@query("sc15_auto", S.with_(S.ITEMS, _SCALED) + f"SELECT value_raw, l_linenumber, coalesce({S.auto('x')}, '-') AS display FROM scaled")
def _(spark, sf):
    return _amounts(spark, sf).select("value_raw", "l_linenumber", F.coalesce(num.auto_text("x"), F.lit("-")).alias("display"))


@query("sc16_grouped", _TEXTS + f"SELECT t, {S.grouped(S.lenient('t'))} AS g3, {S.grouped(S.lenient('t'), 0)} AS g0 FROM texts2")
def _(spark, sf):
    x = num.lenient_number("t")
    return texts(spark, sf).select("t", num.grouped_text(x).alias("g3"), num.grouped_text(x, 0).alias("g0"))


@query("sc17_qlabel", S.with_(S.ITEMS) + f"SELECT DISTINCT last_update, {S.q_label('last_update')} AS label FROM items")
def _(spark, sf):
    return line_items(spark, sf).select("last_update").distinct().withColumn("label", per.quarter_label("last_update"))


@query("sc18_period", S.with_(S.ITEMS) + f"""
SELECT DISTINCT last_update, {S.to_mdy('last_update')} AS mdy, last_update AS key_again FROM items""")
def _(spark, sf):
    keys = line_items(spark, sf).select("last_update").distinct()
    return keys.withColumn("mdy", per.key_to_period("last_update")).withColumn("key_again", per.period_to_key("mdy"))


@query("sc19_year_quarter", """
SELECT DISTINCT year(l_shipdate)::INT AS y, quarter(l_shipdate)::INT AS q, strftime(last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)), '%m/%d/%Y') AS mdy,
  strftime(last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)), '%Y%m%d') AS ymd FROM lineitem""")
def _(spark, sf):
    yq = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).distinct()
    return yq.withColumn("mdy", per.quarter_period(F.col("y"), F.col("q"))).withColumn("ymd", per.quarter_key(F.col("y"), F.col("q")))


@query("sc26_split_list", S.with_(S.ITEMS) + """
SELECT DISTINCT s, array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts
FROM (SELECT item_code || ', ' || schedule || ',,' || value_raw AS s FROM items)""")
def _(spark, sf):
    s = F.concat("item_code", F.lit(", "), "schedule", F.lit(",,"), "value_raw")
    return line_items(spark, sf).select(s.alias("s")).distinct().withColumn("parts", F.array_join(txt.split_list("s"), "|"))


@query("sc27_agent_status", S.with_(S.FACTS, S.AGENT_THRESHOLDS) + """
SELECT code, quarter_date, CASE WHEN value_num >= well THEN 'WELL-CAPITALIZED' WHEN value_num >= adequate THEN 'ADEQUATELY CAPITALIZED' ELSE 'UNDERCAPITALIZED' END AS status,
  count(*) AS n FROM facts JOIN agent_thresholds USING (code) WHERE valid GROUP BY 1, 2, 3""")
def _(spark, sf):
    from finfacts.operators.regulatory import regulatory_status

    return regulatory_status(facts(spark, sf), "agent").groupBy("code", "quarter_date", "status").agg(F.count(F.lit(1)).alias("n"))


@query("sc28_ui_status", S.with_(S.FACTS, S.UI_THRESHOLDS) + """
SELECT code, quarter_date, CASE WHEN value_num < minimum THEN 'danger' WHEN value_num < well THEN 'warning' ELSE 'healthy' END AS status,
  count(*) AS n FROM facts JOIN ui_thresholds USING (code) WHERE valid GROUP BY 1, 2, 3""")
def _(spark, sf):
    from finfacts.operators.regulatory import regulatory_status

    return regulatory_status(facts(spark, sf), "ui").groupBy("code", "quarter_date", "status").agg(F.count(F.lit(1)).alias("n"))


@query("sc31_display_scale", S.with_(S.FACTS) + f"""
SELECT rssd_id, quarter_date, code, CASE WHEN abs(v) <= 200 THEN {S.percent('v')} ELSE {S.percent('(v * 100.0::DOUBLE)')} END AS pct,
  {S.money('v')} AS dollar, {S.fixed('v', 4)} AS plain FROM (SELECT *, {S.prefix('value_raw')} AS v FROM facts) WHERE v IS NOT NULL""")
def _(spark, sf):
    v = num.prefix_number("value_raw")
    rows = facts(spark, sf).withColumn("v", v).where(F.col("v").isNotNull())
    shown = lambda scale: num.custom_ratio_text(F.col("v"), F.lit(scale), F.abs("v") <= 200)
    return rows.select(
        "rssd_id", "quarter_date", "code", shown("percent").alias("pct"), shown("dollar").alias("dollar"), shown("raw").alias("plain")
    )
