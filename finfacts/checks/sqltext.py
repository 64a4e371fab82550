"""SQL text of the panel views and scalar rules, for cross-engine checks.

Written independently of the DataFrame code: plain ANSI-style SQL that an
embedded SQL engine runs over the same Parquet tables.
"""

from __future__ import annotations

from finfacts import reference_data as ref
from finfacts.sources import panel

NUM = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def lit_list(values) -> str:
    return "[" + ", ".join(ref.sql_literal(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(ref.sql_literal(v) for v in values) + ")"


def strict(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), '{NUM}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def lenient(x: str) -> str:
    return strict(f"regexp_replace({x}, '[,%]', '', 'g')")


def prefix(x: str) -> str:
    pat = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pat}', 1), '') AS DOUBLE)"


def is_ratio(x: str) -> str:
    return (
        f"coalesce(trim({x}) NOT IN {in_list(ref.NON_RATIO_TEXTS)}"
        f" AND regexp_matches(trim({x}), '{NUM}'), false)"
    )


def rnd(x: str, n: int) -> str:
    s = f"{10 ** n}.0::DOUBLE"
    return (
        f"(CASE WHEN abs({x}) * {s} < 9007199254740992.0::DOUBLE"
        f" THEN floor(({x}) * {s} + 0.5::DOUBLE) / {s} ELSE {x} END)"
    )


def fixed(x: str, n: int) -> str:
    s = 10 ** n
    units = f"CAST(floor(abs({x}) * {s}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    head = f"(CASE WHEN ({x}) < 0 THEN '-' ELSE '' END) || CAST({units} // {s} AS VARCHAR)"
    if n == 0:
        return f"({head})"
    return f"({head} || '.' || lpad(CAST({units} % {s} AS VARCHAR), {n}, '0'))"


def grouped(x: str, n: int = 3) -> str:
    s = 10 ** n
    units = f"CAST(floor(abs({x}) * {s}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    sign = f"(CASE WHEN ({x}) < 0 AND {units} > 0 THEN '-' ELSE '' END)"
    whole = f"format('{{:,}}', {units} // {s})"
    if n == 0:
        return f"({sign} || {whole})"
    frac = f"rtrim(lpad(CAST({units} % {s} AS VARCHAR), {n}, '0'), '0')"
    return f"({sign} || {whole} || (CASE WHEN {frac} <> '' THEN '.' || {frac} ELSE '' END))"


def _money(x: str, small: str) -> str:
    f = lambda d, u: f"WHEN abs({x}) >= {d} THEN '$' || {fixed(f'(({x}) / {d}::DOUBLE)', 2)} || '{u}'"
    return f"(CASE {f('1e12', 'T')} {f('1e9', 'B')} {f('1e6', 'M')} ELSE {small} END)"


def money(x: str) -> str:
    return f"coalesce({_money(x, chr(39) + '$' + chr(39) + ' || ' + fixed(x, 2))}, '-')"


def money_tool(x: str) -> str:
    whole = f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"
    return f"coalesce({_money(x, whole)}, 'N/A')"


def percent(x: str, n: int = 2) -> str:
    return f"coalesce({fixed(x, n)} || '%', '-')"


def auto(x: str) -> str:
    return f"(CASE WHEN abs({x}) >= 1e6 THEN {money(x)} ELSE {percent(x)} END)"


def schedule(x: str) -> str:
    s = f"upper(trim({x}))"
    return (
        f"(CASE WHEN {x} IS NULL OR {s} = '' THEN NULL WHEN {s} = 'RI' THEN 'RI'"
        f" WHEN {s} LIKE 'RC%' AND {s} NOT LIKE 'RCC%' THEN 'RC'"
        f" WHEN {s} LIKE 'RCC%' THEN 'RC-C' ELSE {s} END)"
    )


def q_end(d: str) -> str:
    return f"strftime(last_day(make_date(year({d}), quarter({d}) * 3, 1)), '%Y%m%d')"


def q_label(q: str) -> str:
    return (
        f"('Q' || CAST(((CAST(substr({q}, 5, 2) AS INT) + 2) // 3) AS VARCHAR) || ' ' || substr({q}, 1, 4))"
    )


def to_mdy(q: str) -> str:
    return f"(substr({q}, 5, 2) || '/' || substr({q}, 7, 2) || '/' || substr({q}, 1, 4))"


def any_of(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {ref.sql_literal(p)})" for p in phrases) + ")"


CELLS = f"""cells AS (
  SELECT l_suppkey, {q_end('l_shipdate')} AS quarter_date,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
    CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N'), 0) AS DOUBLE) AS price_n,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS DOUBLE) AS price_fa,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS price_r,
    CAST(sum(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) AS tax,
    CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS discount,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
    count(*) AS n_lines
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL
  GROUP BY 1, 2)"""

_SHARE = "100.0::DOUBLE / nullif(price, 0)"
_N = "CAST(n_lines AS DOUBLE)"
_VALUES = [
    "price",
    rnd(f"(tax * 100.0::DOUBLE / {_N})", 4),
    rnd(f"(discount * 100.0::DOUBLE / {_N})", 4),
    rnd("(price_n * 100.0::DOUBLE / nullif(price, 0))", 4),
    rnd("(price_fa * 100.0::DOUBLE / nullif(price, 0))", 4),
    rnd("(price_n * 100.0::DOUBLE / nullif(price, 0))", 4) + " + " + rnd(f"(tax * 100.0::DOUBLE / {_N})", 4),
    rnd(f"(quantity / {_N})", 4),
    rnd("(price_r * 100.0::DOUBLE / nullif(price, 0))", 4),
    f"CASE WHEN NOT (substr(quarter_date, 5, 2) = '06' AND l_suppkey % 7 = 0) THEN {_N} END",
]

FACTS = (
    CELLS
    + ", long_cells AS ("
    + " UNION ALL ".join(
        f"SELECT l_suppkey, quarter_date, '{code}' AS code, {i} AS ord, {v} AS v FROM cells"
        for i, (code, v) in enumerate(zip(panel.PANEL_CODES, _VALUES))
    )
    + """), texts AS (
  SELECT *, CAST(CAST(v AS DECIMAL(18,4)) AS VARCHAR) AS t,
    (l_suppkey * 31 + CAST(quarter_date AS INT) * 7 + ord * 13) % 97 AS h
  FROM long_cells WHERE v IS NOT NULL), raws AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS rssd_id, quarter_date, code,
    CASE h WHEN 0 THEN '0000' WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN '1,234'
      WHEN 4 THEN t || '%' WHEN 5 THEN ' ' || t || ' ' WHEN 6 THEN '0.0' WHEN 7 THEN 'nan'
      WHEN 8 THEN '1d' WHEN 9 THEN '1_000' WHEN 10 THEN '0' ELSE t END AS value_raw
  FROM texts), facts AS (
  SELECT *, """
    + strict("value_raw")
    + " AS value_num, "
    + is_ratio("value_raw")
    + " AS valid FROM raws)"
)

INSTITUTIONS = """institutions AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS rssd_id, trim(s_name) AS name, n_name AS city, r_name AS state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
_NI = len(panel.ITEM_CODES)
_NT = len(panel.ITEM_TEXTS)
ORD = "ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate)"
ITEMS = f"""items AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS rssd_id, {q_end('l_shipdate')} AS quarter_date,
    strftime(last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)), '%m/%d/%Y') AS reporting_period,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, {ORD} AS ord,
    {lit_list(panel.ITEM_CODES)}[(l_partkey + 3 * l_linenumber) % {_NI} + 1] AS item_code,
    CASE (l_orderkey + l_linenumber) % 29 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN {_AMOUNT} || '%'
      WHEN 3 THEN ' ' || {_AMOUNT} WHEN 4 THEN '12abc' WHEN 5 THEN '1,234'
      WHEN 6 THEN '-' || {_AMOUNT} ELSE {_AMOUNT} END AS value_raw,
    strftime(l_shipdate, '%Y%m%d') AS last_update,
    {lit_list(panel.ITEM_TEXTS)}[(l_partkey + l_linenumber) % {_NT} + 1] AS description,
    {lit_list(panel.ITEM_SCHEDULES)}[l_linenumber] AS schedule,
    {schedule(lit_list(panel.ITEM_SCHEDULES) + '[l_linenumber]')} AS section,
    CAST(l_linenumber AS VARCHAR) || '.' || l_returnflag AS line_number
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL)"""


def _question_text() -> str:
    t = f"{lit_list(panel.QUESTION_TEMPLATES)}[n % {len(panel.QUESTION_TEMPLATES)} + 1]"
    fills = [
        ("{name}", "'Bank ' || CAST(l_suppkey AS VARCHAR)"),
        ("{id}", "CAST(l_suppkey AS VARCHAR)"),
        ("{q}", q_label("quarter_date")),
        ("{q0}", "'Q3 ' || substr(quarter_date, 1, 4)"),
        ("{y}", "'20' || substr(quarter_date, 3, 2)"),
        ("{code}", f"{lit_list(panel.PANEL_CODES)}[l_suppkey % {len(panel.PANEL_CODES)} + 1]"),
    ]
    for mark, fill in fills:
        t = f"replace({t}, '{mark}', {fill})"
    return t


QUESTIONS = (
    CELLS
    + f""", numbered AS (
  SELECT *, l_suppkey * 11 + CAST(quarter_date AS INT) AS n FROM cells), questions AS (
  SELECT 'p-' || CAST(l_suppkey AS VARCHAR) || '-' || quarter_date AS question_id,
    {_question_text()} AS question,
    CASE WHEN n % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS rssd_id,
    CASE WHEN n % 5 <> 0 THEN quarter_date END AS quarter_date,
    CASE WHEN n % 5 <> 0 THEN {to_mdy('quarter_date')} END AS reporting_period
  FROM numbered
  UNION ALL
  SELECT 'c-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text, NULL, NULL, NULL
  FROM conversations)"""
)

RATIO_META = f"ratio_meta(code, label, category, higher_better) AS ({ref.values_sql(ref.RATIO_META)})"
UI_THRESHOLDS = f"ui_thresholds(code, minimum, well, rule_label) AS ({ref.values_sql(ref.UI_THRESHOLDS)})"
AGENT_THRESHOLDS = (
    f"agent_thresholds(code, rule_label, well, adequate, minimum) AS ({ref.values_sql(ref.AGENT_THRESHOLDS)})"
)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
