"""Fixed lookup values and their DataFrame form.

Everything in this module is a fixed value that results must agree with: code
lists, labels, thresholds and keyword phrases. The sizes are constants of the
domain, which is what makes these frames (and only these) safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: ratio codes, labels, categories, direction (None = neither) ---
RATIO_META = [
    ("UBPRD486", "Leverage Ratio", "Capital", True),
    ("UBPRD487", "Tier 1 Capital Ratio", "Capital", True),
    ("UBPRD488", "Total Capital Ratio", "Capital", True),
    ("UBPRR029", "CET1 Ratio (Advanced)", "Capital", True),
    ("UBPRR030", "CET1 Ratio (Adv. Col B)", "Capital", True),
    ("UBPRR031", "CET1 Ratio (Standardized)", "Capital", True),
    ("UBPRR032", "Tier 1 Ratio (Adv. Col B)", "Capital", True),
    ("UBPRR033", "Total Capital (Std. Col A)", "Capital", True),
    ("UBPRR034", "Total Capital (Adv. Col B)", "Capital", True),
    ("UBPR7308", "Equity to Assets", "Capital", True),
    ("UBPR7400", "Tier 1 (legacy)", "Capital", True),
    ("UBPR7402", "Total Capital (legacy)", "Capital", True),
    ("UBPR7408", "Leverage Ratio (legacy)", "Capital", True),
    ("UBPRE625", "Retained Earnings to Equity", "Capital", True),
    ("UBPRE626", "Net Loans to Equity (x)", "Capital", False),
    ("UBPRE635", "Equity Capital Growth", "Capital", True),
    ("UBPRE641", "Total Intangibles to Equity", "Capital", False),
    ("UBPRJ245", "Equity + Min Interests / Assets", "Capital", True),
    ("UBPRE001", "Interest Income (TE) / Assets", "Profitability", True),
    ("UBPRE002", "Interest Expense / Assets", "Profitability", False),
    ("UBPRE003", "Net Interest Income (TE) / Assets", "Profitability", True),
    ("UBPRE004", "Noninterest Income / Assets", "Profitability", True),
    ("UBPRE005", "Noninterest Expense / Assets", "Profitability", False),
    ("UBPRE006", "Provision for Credit Losses / Assets", "Profitability", False),
    ("UBPRE007", "Pretax Operating Income / Assets", "Profitability", True),
    ("UBPRE009", "Pretax Net Operating Income / Assets", "Profitability", True),
    ("UBPRE010", "Net Operating Income / Assets", "Profitability", True),
    ("UBPRE012", "ROA (Sub S Adjusted)", "Profitability", True),
    ("UBPRE013", "Return on Assets (ROA)", "Profitability", True),
    ("UBPRE014", "Avg Earning Assets / Avg Assets", "Profitability", True),
    ("UBPRE016", "Interest Income (TE) / Earning Assets", "Profitability", True),
    ("UBPRE017", "Interest Expense / Earning Assets", "Profitability", False),
    ("UBPRE018", "Net Interest Margin (NIM)", "Profitability", True),
    ("UBPRE630", "Return on Equity (ROE)", "Profitability", True),
    ("UBPRPG69", "Pre-Provision Net Revenue / Assets", "Profitability", True),
    ("UBPR7204", "ROA (raw input)", "Profitability", True),
    ("UBPR7205", "Total Capital input", "Profitability", True),
    ("UBPR7206", "Tier 1 input", "Profitability", True),
    ("UBPRE600", "Loan to Deposit Ratio", "Liquidity", False),
    ("UBPR7316", "Loan to Deposit (alt)", "Liquidity", False),
    ("UBPRE015", "Avg Int-Bearing Funds / Assets", "Liquidity", None),
    ("UBPR7414", "Non-Performing Loans (NPL %)", "Asset Quality", False),
    ("UBPRE019", "Net Charge-Off Rate", "Asset Quality", False),
    ("UBPRE020", "Earnings Coverage of Net Losses (x)", "Asset Quality", True),
    ("UBPRE021", "ACL to Net Losses (x)", "Asset Quality", True),
    ("UBPRE022", "ACL on Loans / Total Loans", "Asset Quality", None),
    ("UBPRE395", "ACL to Nonaccrual Loans (x)", "Asset Quality", True),
    ("UBPRE544", "30-89 Days Past Due %", "Asset Quality", False),
    ("UBPRE547", "Total Past Due + Nonaccrual %", "Asset Quality", False),
    ("UBPRE549", "Noncurrent + OREO / Loans + OREO", "Asset Quality", False),
    ("UBPR7316_growth", "Loan Growth", "Growth", True),
]

# --- fixed values: display order of the leading ratios ---
PRIORITY_CODES = [
    "UBPRD487", "UBPRR031", "UBPRR029", "UBPRD488", "UBPRD486", "UBPR7308",
    "UBPRE013", "UBPRE630", "UBPRE018", "UBPRE003",
    "UBPRE600", "UBPR7316",
    "UBPR7414", "UBPRE019", "UBPRE022",
]

# --- fixed values: summary groups, first available code of each group is shown ---
PRIORITY_GROUPS = [
    (["UBPRR031", "UBPRD487", "UBPR7400"], "Tier 1 Capital Ratio"),
    (["UBPRD488", "UBPRR033"], "Total Capital Ratio"),
    (["UBPRD486", "UBPR7408"], "Leverage Ratio"),
    (["UBPR7308"], "Equity to Assets"),
    (["UBPRE013", "UBPRE012"], "Return on Assets"),
    (["UBPRE630"], "Return on Equity"),
    (["UBPRE018", "UBPRE003"], "Net Interest Margin"),
    (["UBPRE600", "UBPR7316"], "Loan to Deposit"),
    (["UBPR7414"], "Non-Performing Loans"),
    (["UBPRE019"], "Net Charge-Off Rate"),
]

# --- fixed values: codes with peer averages ---
PEER_CODES = [
    "UBPRE013", "UBPRE018", "UBPRD487", "UBPRD486", "UBPRD488",
    "UBPR7308", "UBPR7414", "UBPRE019", "UBPRE600",
]

# --- fixed values: compare view, category -> codes in display order ---
COMPARE_CODES = [
    ("Capital", ["UBPRR031", "UBPRD487", "UBPRD488", "UBPRD486", "UBPR7308"]),
    ("Profitability", ["UBPRE013", "UBPRE630", "UBPRE018"]),
    ("Liquidity", ["UBPRE600", "UBPR7316"]),
    ("Asset Quality", ["UBPR7414", "UBPRE019"]),
]

# --- fixed values: dashboard thresholds (code, minimum, well-capitalized, label) ---
UI_THRESHOLDS = [
    ("UBPRD487", 6.0, 8.0, "Tier 1 Capital Ratio"),
    ("UBPRR031", 6.0, 8.0, "CET1 Ratio"),
    ("UBPRR029", 6.0, 8.0, "CET1 Advanced"),
    ("UBPRD486", 4.0, 5.0, "Leverage Ratio"),
    ("UBPRD488", 8.0, 10.0, "Total Capital Ratio"),
    ("UBPR7400", 4.0, 5.0, "Tier 1 (legacy)"),
]

# --- fixed values: assistant thresholds (code, label, well, adequate, printed minimum) ---
AGENT_THRESHOLDS = [
    ("UBPRD487", "CET1 Ratio", 8.0, 6.0, 4.5),
    ("UBPRR031", "CET1 Ratio", 8.0, 6.0, 4.5),
    ("UBPRD488", "Total Capital", 10.0, 8.0, 8.0),
    ("UBPRD486", "Leverage Ratio", 5.0, 4.0, 4.0),
]

# --- fixed values: definition changes, newest first ---
RULE_CHANGES = [
    ("20200101", "CECL adopted",
     "ASC 326 changed allowance methodology - pre/post not directly comparable"),
    ("20150101", "Basel III effective",
     "New capital ratio definitions - affects Tier 1 and CET1 comparisons"),
]

# --- fixed values: asset-size peer buckets in dollars, [low, high) ---
SIZE_CODE = "UBPR2170"
PEER_BUCKETS = [
    ("size:large", 100_000_000_000.0, None),
    ("size:mid", 10_000_000_000.0, 100_000_000_000.0),
    ("size:community", None, 10_000_000_000.0),
    ("size:small", None, 1_000_000_000.0),
]
PEER_GROUP_ALIASES = {
    "all": "all",
    "large": "size:large", "size:large": "size:large",
    "mid": "size:mid", "size:mid": "size:mid",
    "community": "size:community", "size:community": "size:community",
    "small": "size:small", "size:small": "size:small",
}

# --- fixed values: line-item codes tried in order for each measure ---
METRIC_VARIANTS = [
    ("total_assets", ["RCFD2170", "RCON2170", "RCOA2170", "RCFD3368"]),
    ("total_loans", ["RCFD2122", "RCON2122", "RCFD1400", "RCON1400"]),
    ("res_1_4", ["RCON1797", "RCFD1797"]),
    ("multifamily", ["RCON1460", "RCFD1460"]),
    ("construction", ["RCON1410", "RCFD1410", "RCFD1415", "RCON1415"]),
    ("total_equity", ["RCFD3210", "RCON3210"]),
    ("net_income", ["RIAD4340"]),
    ("total_deposits", ["RCFD2200", "RCON2200"]),
]

# --- fixed values: measure order, group, label and unit ($K amounts, fractions) ---
METRIC_META = [
    ("total_assets", "Balance Sheet", "Total Assets", "usd_thousands"),
    ("total_loans", "Balance Sheet", "Total Loans", "usd_thousands"),
    ("total_deposits", "Balance Sheet", "Total Deposits", "usd_thousands"),
    ("total_equity", "Balance Sheet", "Total Equity", "usd_thousands"),
    ("net_income", "Income", "Net Income", "usd_thousands"),
    ("residential_total", "Residential", "Residential Total", "usd_thousands"),
    ("residential_ratio", "Residential", "Residential Ratio", "fraction"),
    ("equity_to_assets", "Capital", "Equity / Assets", "fraction"),
    ("loans_to_deposits", "Capital", "Loans / Deposits", "fraction"),
]

# --- fixed values: schedule families ---
BALANCE_SHEET_SCHEDULES = [
    "RC", "RC-C", "RC-B", "RC-D", "RC-E", "RC-F", "RC-G", "RC-H", "RC-K", "RC-L", "RC-M",
    "RC-N", "RC-O", "RC-P", "RC-Q", "RC-R", "RC-S", "RC-T", "RC-U", "RC-V",
]
INCOME_SCHEDULES = ["RI", "RIA", "RIB", "RIBI", "RIBII", "RIC", "RID", "RIE"]

# --- fixed values: texts that never count as a ratio ---
NON_RATIO_TEXTS = ["", "0000", "0", "None", "nan", "NaN", "null"]

# --- fixed values: legal-form words dropped from institution names ---
NAME_STOP_WORDS = [
    "national", "association", "inc", "corp", "corporation", "trust", "financial", "savings",
    "community", "federal", "na", "fsb", "ssb", "bancorp", "bancshares", "holding", "holdings",
    "group", "co", "company", "ltd", "llc", "of", "the", "and", "dba",
]

# --- fixed values: phrase -> ratio code ---
METRIC_PHRASES = [
    ("npl", "UBPR7414"),
    ("non-performing loans", "UBPR7414"),
    ("nonperforming loans", "UBPR7414"),
    ("non performing loans", "UBPR7414"),
    ("npl %", "UBPR7414"),
    ("noncurrent loans", "UBPR7414"),
    ("roa", "UBPRE013"),
    ("return on assets", "UBPRE013"),
    ("roe", "UBPRE630"),
    ("return on equity", "UBPRE630"),
    ("nim", "UBPRE018"),
    ("net interest margin", "UBPRE018"),
    ("cet1", "UBPRR031"),
    ("cet1 ratio", "UBPRR031"),
    ("tier 1", "UBPRD487"),
    ("tier1", "UBPRD487"),
    ("tier 1 capital", "UBPRD487"),
    ("tier 1 capital ratio", "UBPRD487"),
    ("total capital ratio", "UBPRD488"),
    ("leverage ratio", "UBPRD486"),
    ("equity to assets", "UBPR7308"),
    ("charge-off", "UBPRE019"),
    ("net charge-off", "UBPRE019"),
    ("charge off", "UBPRE019"),
    ("loan to deposit", "UBPRE600"),
    ("loan-to-deposit", "UBPRE600"),
    ("loans to deposits", "UBPRE600"),
]

# --- fixed values: keyword sets of the question labels ---
ROUTE_OUT_OF_SCOPE = [
    "weather", "recipe", "sports score", "movie", "music", "song lyrics", "joke", "politics",
    "travel destination", "hotel booking", "flight", "stock price", "crypto", "bitcoin",
    "write me a poem", "write an essay", "translate this", "who are you", "what are you",
]
ROUTE_DATA = [
    "ratio", "roa", "roe", "nim", "net interest margin", "return on assets", "return on equity",
    "capital", "cet1", "tier 1", "tier1", "leverage", "peer", "benchmark", "compare",
    "well-capitalized", "adequately capitalized", "undercapitalized", "regulatory", "ubpr",
    "charge-off", "npl", "nonperforming", "non-performing", "loan-to-deposit", "liquidity",
    "profitability", "asset quality", "trend", "over time", "historical", "balance sheet",
    "income statement", "schedule rc", "schedule ri", "schedule rc-c", "total assets",
    "total deposits", "total loans", "net income", "equity", "filing", "call report", "period",
    "report", "facsimile", "deposits", "loans", "assets", "metrics", "performance", "show me",
    "what is this bank", "this bank", "for this bank", "show the", "show trend", "show ratio",
]
ROUTE_KNOWLEDGE = [
    "what is basel", "what is cet1", "what is tier 1", "what is leverage ratio", "explain ",
    "define ", "what does ", "how is roa", "how is roe", "how is nim", "difference between",
    "tell me about basel", "what are capital requirements", "how does capital",
    "why is capital ratio", "meaning of", "what is a call report", "what is ubpr",
    "what is ffiec",
]
RATIO_INTENT_TREND = [
    "trend", "over time", "history", "historical", "quarters", "quarter over", "change",
    "progression", "evolution",
]
RATIO_INTENT_PEER = [
    "peer", "benchmark", "compare", "comparison", "industry", "average", "similar banks",
    "peer group",
]
RATIO_INTENT_REGULATORY = [
    "regulatory", "well-capitalized", "adequately capitalized", "undercapitalized", "basel",
    "capital requirement", "capital adequacy", "compliant", "breach", "flag", "threshold",
]
REPORT_INTENT_PERIODS = [
    "available periods", "what periods", "which quarters", "all periods", "what dates",
    "filing dates",
]
REPORT_INTENT_SCHEDULES_LIST = [
    "available schedules", "which schedules", "what schedules", "list schedules",
]
REPORT_INTENT_SCHEDULE = [
    "schedule", "rc-c", "rc-b", "rc-r", "ri-a", "ri-b", "schedule rc", "schedule ri",
    "line item", "section",
]
ACTION_CALL = [
    "balance sheet", "income statement", "schedule", "call report", "filing", "deposits",
    "loans", "assets", "net income", "metrics",
]
ACTION_TREND = [
    "trend", "over time", "history", "historical", "quarterly", "quarters", "from q", "since q",
]
ACTION_PEER = ["peer", "compare", "benchmark", "industry average", "peer group"]
ACTION_PDF = ["pdf", "filing", "facsimile"]
ACTION_SECTIONS = [
    "schedule rc", "schedule ri", "schedule rc-c", "balance sheet sections", "line items",
    "schedule data",
]
DEFAULT_TREND_CODES = ["UBPRE013", "UBPRE018", "UBPRD487", "UBPRD486"]
DEFAULT_SCHEDULES = ["RC", "RI"]

# --- fixed values: quarter names in the order they are tried ---
QUARTER_NAMES = [
    ("q1", 1), ("q2", 2), ("q3", 3), ("q4", 4),
    ("first", 1), ("second", 2), ("third", 3), ("fourth", 4),
    ("1st", 1), ("2nd", 2), ("3rd", 3), ("4th", 4),
    ("march", 1), ("june", 2), ("september", 3), ("december", 4),
    ("mar", 1), ("jun", 2), ("sep", 3), ("dec", 4),
]

# --- fixed values: ingestion planning ---
BUDGET_GB = 9.0
MIN_REMAINING_GB = 0.05
PLANNED_QUARTER_MB = 32
FIRST_YEAR = 2001
RECENT_QUARTERS = 8
PUBLICATION_LAG_QUARTERS = 2


def sql_literal(value) -> str:
    """A SQL literal accepted by Spark and by other ANSI engines alike."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: Sequence[Sequence]) -> str:
    """``VALUES (..), (..)`` text for a constant table."""
    return "VALUES " + ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)


def constant_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A constant table as a LocalRelation, so its exact size is known to the optimizer.

    ``schema`` is a DDL list such as ``"code string, label string"``.
    """
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    names = ", ".join(f"_{i}" for i in range(len(columns)))
    casts = ", ".join(f"CAST(_{i} AS {t}) AS {n}" for i, (n, t) in enumerate(columns))
    literals = "VALUES " + ", ".join(
        "(" + ", ".join(_spark_literal(v) for v in r) + ")" for r in rows
    )
    return spark.sql(f"SELECT {casts} FROM {literals} AS t({names})")


def _spark_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return sql_literal(value)


def ratio_meta(spark: SparkSession) -> DataFrame:
    return constant_frame(
        spark, RATIO_META, "code string, label string, category string, higher_better boolean"
    )


def ui_thresholds(spark: SparkSession) -> DataFrame:
    return constant_frame(
        spark, UI_THRESHOLDS, "code string, minimum double, well double, rule_label string"
    )


def agent_thresholds(spark: SparkSession) -> DataFrame:
    return constant_frame(
        spark, AGENT_THRESHOLDS,
        "code string, rule_label string, well double, adequate double, minimum double",
    )


def priority_group_rows() -> list[tuple[int, int, str, str]]:
    return [
        (g, c, code, fallback)
        for g, (codes, fallback) in enumerate(PRIORITY_GROUPS, 1)
        for c, code in enumerate(codes, 1)
    ]


def metric_variant_rows() -> list[tuple[str, int, str]]:
    return [
        (metric, i, code) for metric, codes in METRIC_VARIANTS for i, code in enumerate(codes, 1)
    ]


def compare_code_rows() -> list[tuple[str, int, str]]:
    return [
        (category, i, code) for category, codes in COMPARE_CODES for i, code in enumerate(codes, 1)
    ]
