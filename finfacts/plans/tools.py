"""The assistant's documented tools as table functions.

Each takes whole frames and returns a DataFrame; ``rssd_id`` / ``quarter_date`` arguments are
optional filters that Spark pushes to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from finfacts.functions.numeric import fixed_text, fraction_percent_text, money_tool_text
from finfacts.functions.text import split_list
from finfacts.operators import facts as fx, items as it, peers, ranking
from finfacts.plans import reports
from finfacts.reference_data import PEER_BUCKETS, PEER_CODES


def _only(frame: DataFrame, **equals: str | None) -> DataFrame:
    for column, value in equals.items():
        if value is not None:
            frame = frame.where(F.col(column) == value)
    return frame


def get_ubpr_ratios(facts: DataFrame, rssd_id: str | None = None, quarter_date: str | None = None) -> DataFrame:
    """First 15 valid ratios in code order."""
    rows = _only(facts, rssd_id=rssd_id, quarter_date=quarter_date)
    return ranking.first_by_code(fx.valid_ratios(rows), 15).select(*fx.CELL, "pos", "code", "value_raw")


def get_peer_comparison(
    facts: DataFrame, peer_group: str = "all", rssd_id: str | None = None,
    quarter_date: str | None = None, buckets: Sequence[peers.Bucket] = PEER_BUCKETS,
) -> DataFrame:
    """Value, peer average and signed difference of the first 12 peer metrics, as two-decimal text."""
    one_quarter = _only(facts, quarter_date=quarter_date)  # peers stay in; the institution filter comes last
    rows = peers.top_peer_rows(peers.leave_one_out(one_quarter, PEER_CODES, buckets, [peer_group]))
    diff = F.col("bank_value") - F.col("peer_average")
    sign = F.when(diff >= 0, "+").otherwise("")
    return _only(rows, rssd_id=rssd_id).select(
        *fx.CELL, "peer_group", F.col("place").cast("bigint").alias("pos"), "code",
        fixed_text("bank_value", 2).alias("bank"), fixed_text("peer_average", 2).alias("peer_avg"),
        F.concat(sign, fixed_text(diff, 2)).alias("diff"),
    )


def get_ubpr_trend(
    facts: DataFrame, from_quarter: str, to_quarter: str, codes: str, rssd_id: str | None = None
) -> DataFrame:
    """Values of comma-listed codes over a range, one row per code and quarter."""
    names = fx.safe_codes([c.strip() for c in codes.split(",")])
    rows = fx.between_quarters(_only(facts, rssd_id=rssd_id), from_quarter, to_quarter)
    return rows.where(F.col("code").isin(names) & F.col("value_raw").isNotNull()).select(
        "rssd_id", "code", "quarter_date", "value_raw"
    )


def flag_regulatory_issues(
    facts: DataFrame, rssd_id: str | None = None, quarter_date: str | None = None
) -> DataFrame:
    return reports.regulatory_report(_only(facts, rssd_id=rssd_id, quarter_date=quarter_date))


def get_available_periods(periods: DataFrame, n: int = 12) -> DataFrame:
    """Newest ``n`` periods as one comma list, and the count of all. One row per period goes in."""
    ordered = F.sort_array(F.collect_list(F.struct("quarter_date", "period")), asc=False)
    return periods.agg(ordered.alias("all")).select(
        F.array_join(F.transform(F.slice("all", 1, n), lambda p: p["period"]), ", ").alias("periods"),
        F.size("all").cast("bigint").alias("n_periods"),
    )


def get_bank_metrics(
    items: DataFrame, rssd_id: str | None = None, reporting_period: str | None = None
) -> DataFrame:
    """Call-report measures as text. Amounts are money; fractions are percents, not dollars."""
    measured = it.metrics(_only(items, rssd_id=rssd_id, reporting_period=reporting_period))
    value = F.col("value")
    shown = F.when(F.col("unit") == "fraction", F.when(value.isNull(), "N/A").otherwise(fraction_percent_text(value)))
    return it.metric_rows(measured).select(
        *it.FILING, "metric_ord", "metric", shown.otherwise(money_tool_text(value)).alias("text")
    )


def get_schedule_data(
    items: DataFrame, schedules: str = "RC,RI", rssd_id: str | None = None,
    reporting_period: str | None = None,
) -> DataFrame:
    """First ten rows of each comma-listed schedule and how many more there are."""
    names = [s.strip() for s in schedules.split(",") if s.strip()]
    rows = it.select_sections(_only(items, rssd_id=rssd_id, reporting_period=reporting_period), names)
    return it.top_rows(rows)


def get_available_schedules(
    items: DataFrame, rssd_id: str | None = None, reporting_period: str | None = None
) -> DataFrame:
    return it.section_list(_only(items, rssd_id=rssd_id, reporting_period=reporting_period))


def listed(frame: DataFrame, column: str) -> DataFrame:
    """Explode a comma-list argument column to one row per item."""
    return frame.select("*", F.explode(split_list(column)).alias("item"))
