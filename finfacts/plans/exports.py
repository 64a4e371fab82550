"""File exports: quoted CSV and one markdown report per institution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finfacts.functions.numeric import (
    fixed_text, fraction_percent_text, money_tool_text, round_half_up,
)
from finfacts.functions.periods import quarter_label
from finfacts.operators import facts as fx, items as it, peers, regulatory
from finfacts.reference_data import AGENT_THRESHOLDS, PEER_BUCKETS


def write_csv(frame: DataFrame, path: str, missing: str = "-") -> None:
    """Every cell quoted, quotes doubled, missing cells as ``missing`` (a dash or empty)."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in frame.columns]
    (
        frame.select(*cells).write.mode("overwrite")
        .option("header", "true").option("quoteAll", "true").option("escape", '"')
        .option("emptyValue", "").option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def read_csv(spark, path: str, columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.read.schema(schema).option("header", "true").option("escape", '"')
        .option("multiLine", "true").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    )


def _pct(c: Column) -> Column:
    return F.coalesce(F.concat(fixed_text(c, 2), F.lit("%")), F.lit("N/A"))


def _status(code: str) -> Column:
    well, adequate = next((r[2], r[3]) for r in AGENT_THRESHOLDS if r[0] == code)
    status = regulatory.agent_status(F.col(code), F.lit(well), F.lit(adequate))
    return F.when(F.col(code).isNotNull(), status).otherwise("N/A")


def bank_analysis(
    facts: DataFrame, institutions: DataFrame, buckets: Sequence[peers.Bucket] = PEER_BUCKETS
) -> DataFrame:
    """Markdown analysis of each institution and quarter: ``rssd_id, quarter_date, report``.
    The generated date and free-text summary are left out, so equal data gives equal text."""
    codes = ["UBPRD487", "UBPRD488", "UBPRD486", "UBPRE013", "UBPRE630", "UBPRE018", "UBPR7414", "UBPRE019"]
    own = fx.wide(fx.valid_ratios(facts), codes, "value_num")
    peer = fx.wide(
        peers.leave_one_out(facts, ["UBPRE013", "UBPRE018"], buckets, ["all"]), ["UBPRE013", "UBPRE018"],
        "peer_average",
    ).select(*fx.CELL, F.col("UBPRE013").alias("peer_roa"), F.col("UBPRE018").alias("peer_nim"))
    rows = fx.with_bank_names(own.join(peer, fx.CELL, "left"), institutions)

    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def against(label: str, code: str, peer_column: str) -> Column:
        gap = fixed_text(round_half_up(F.col(code) - F.col(peer_column), 6), 2)
        diff = F.coalesce(F.concat(gap, F.lit("pp")), F.lit("N/A"))
        return line(f"| {label} | ", _pct(F.col(code)), " | ", _pct(F.col(peer_column)), " | ", diff, " |")

    quarter = quarter_label("quarter_date")
    text = F.concat_ws(
        "\n",
        F.lit("# Bank Financial Analysis Report"), F.lit(""),
        line("**Institution:** ", F.col("name"), " (RSSD: ", F.col("rssd_id"), ")"),
        line("**Period:** ", quarter), F.lit(""),
        F.lit("## Capital Adequacy"),
        line("- CET1 Ratio: ", _pct(F.col("UBPRD487")), " - ", _status("UBPRD487")),
        line("- Total Capital: ", _pct(F.col("UBPRD488")), " - ", _status("UBPRD488")),
        line("- Leverage Ratio: ", _pct(F.col("UBPRD486")), " - ", _status("UBPRD486")), F.lit(""),
        F.lit("## Profitability"),
        line("- Return on Assets (ROA): ", _pct(F.col("UBPRE013"))),
        line("- Return on Equity (ROE): ", _pct(F.col("UBPRE630"))),
        line("- Net Interest Margin (NIM): ", _pct(F.col("UBPRE018"))), F.lit(""),
        F.lit("## Asset Quality"),
        line("- Non-Performing Loan Ratio: ", _pct(F.col("UBPR7414"))),
        line("- Net Charge-Off Rate: ", _pct(F.col("UBPRE019"))), F.lit(""),
        F.lit("## Peer Comparison"),
        F.lit("| Metric | This Bank | Peer Avg | Difference |"), F.lit("| --- | --- | --- | --- |"),
        against("ROA", "UBPRE013", "peer_roa"),
        against("NIM", "UBPRE018", "peer_nim"),
    )
    return rows.select(*fx.CELL, text.alias("report"))


def call_summary(items: DataFrame, institutions: DataFrame) -> DataFrame:
    """Markdown call-report summary of each filing: ``rssd_id, reporting_period, report``."""
    rows = fx.with_bank_names(
        it.metrics(items).join(it.section_list(items), it.FILING, "left"), institutions
    )
    money = lambda label, c: F.concat(F.lit(f"| {label} | "), money_tool_text(c), F.lit(" |"))
    share = lambda label, c: F.concat(F.lit(f"| {label} | "), fraction_percent_text(c), F.lit(" |"))
    text = F.concat_ws(
        "\n",
        F.lit("# Call Report Summary"), F.lit(""),
        F.concat(F.lit("**Institution:** "), F.col("name")),
        F.concat(F.lit("**RSSD ID:** "), F.col("rssd_id")),
        F.concat(F.lit("**Reporting Period:** "), F.col("reporting_period")), F.lit(""),
        F.lit("## Key Metrics"), F.lit("| Metric | Value |"), F.lit("| --- | --- |"),
        money("Total Assets", "total_assets"), money("Total Loans", "total_loans"),
        money("Total Deposits", "total_deposits"), money("Total Equity", "total_equity"),
        money("Net Income", "net_income"), F.lit(""),
        F.lit("## Computed Ratios"), F.lit("| Ratio | Value |"), F.lit("| --- | --- |"),
        share("Equity-to-Assets", "equity_to_assets"), share("Loans-to-Deposits", "loans_to_deposits"),
        F.lit(""), F.lit("## Available Schedules"), F.coalesce("sections", F.lit("")),
    )
    return rows.select(*it.FILING, text.alias("report"))


def regulatory_alerts(facts: DataFrame, institutions: DataFrame) -> DataFrame:
    """Markdown alert of each capital ratio that is not well capitalized."""
    low = regulatory.regulatory_status(facts, "agent").where(F.col("status") != "WELL-CAPITALIZED")
    rows = fx.with_bank_names(low, institutions)
    text = F.concat_ws(
        "\n",
        F.lit("# Regulatory Alert"), F.lit(""),
        F.concat(F.lit("**Institution:** "), F.col("name")),
        F.concat(F.lit("**RSSD ID:** "), F.col("rssd_id")),
        F.concat(F.lit("**Quarter:** "), quarter_label("quarter_date")),
        F.concat(F.lit("**Alert Level:** "), F.col("status")), F.lit(""),
        F.lit("| Ratio | Current | Minimum | Well-Capitalized |"), F.lit("| --- | --- | --- | --- |"),
        F.concat(
            F.lit("| "), F.col("rule_label"), F.lit(" | "), _pct(F.col("value_num")), F.lit(" | "),
            fixed_text("minimum", 1), F.lit("% | "), fixed_text("well", 1), F.lit("% |"),
        ),
    )
    return rows.select(*fx.CELL, "code", text.alias("report"))


def write_markdown(reports: DataFrame, path: str, by: str) -> None:
    """Reports as text, one directory per quarter or period; ``by`` is made file-name safe."""
    (
        reports.select("report", F.replace(F.col(by), F.lit("/"), F.lit("-")).alias(by))
        .write.mode("overwrite").option("lineSep", "\n\f\n").partitionBy(by).text(path)
    )
