"""The reports users ask for, for every institution and quarter at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from finfacts.functions.numeric import auto_text, fixed_text, round_half_up
from finfacts.functions.periods import quarter_label
from finfacts.operators import facts as fx, items as it, peers, ranking, regulatory, trends
from finfacts.reference_data import PEER_BUCKETS, PEER_CODES, PRIORITY_GROUPS, RULE_CHANGES


def key_ratios(facts: DataFrame) -> DataFrame:
    """Valid ratios with label, category and display position."""
    return ranking.display_order(fx.valid_ratios(facts)).select(
        *fx.CELL, "display_pos", "code", "label", "category", "value_raw", "value_num"
    )


def trend(
    facts: DataFrame, codes: Sequence[str], start: str, end: str
) -> DataFrame:
    """Series of the chosen codes over an inclusive quarter range with quarter-over-quarter change.
    Range and codes are literal filters, so both reach the scan. No codes gives no rows."""
    wanted = fx.between_quarters(facts, start, end).where(F.col("code").isin(fx.safe_codes(codes)))
    changes = trends.quarter_change(wanted)
    return trends.with_direction(changes).select(
        "rssd_id", "code", "label", "quarter_date", quarter_label("quarter_date").alias("quarter"),
        "value_num", "prev_value", "change", "change_is",
    )


def peer_comparison(
    facts: DataFrame,
    codes: Sequence[str] = PEER_CODES,
    buckets: Sequence[peers.Bucket] = PEER_BUCKETS,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Each valid peer-code ratio against the average of the other group members, with position
    and threshold status."""
    rows = peers.with_difference(peers.leave_one_out(facts, codes, buckets, groups))
    return rows.where(F.col("peer_average").isNotNull()).select(
        *fx.CELL, "peer_group", "code", "label", "category", "bank_value", "peer_average",
        "n_peers", "difference", "position",
        regulatory.ui_status_of_code(F.col("code"), F.col("bank_value")).alias("status"),
    )


def executive_summary(
    facts: DataFrame, buckets: Sequence[peers.Bucket] = PEER_BUCKETS, group: str = "all"
) -> DataFrame:
    """The summary ratios of each institution and quarter: value, change, distance to peers, status.

    One aggregate gives a row per institution and quarter with every code that a summary needs: the change is a
    window over these rows and the picks are an expression. The peers' totals are a second, narrower scan.
    """
    codes = sorted({*PEER_CODES, *ranking.SUMMARY_CODES})
    rows = peers.peer_rows(facts, codes, buckets)
    name = peers.peer_group(group)
    totals = peers.one_group_totals(rows, PEER_CODES, name)
    before = W.partitionBy("rssd_id").orderBy("quarter_date").rowsBetween(W.unboundedPreceding, -1)
    wide = rows.select("*", peers.is_member(name).alias("member"), *[
        F.last(peers.counted(c), ignorenulls=True).over(before).alias(f"prev_{c}") for c in ranking.SUMMARY_CODES
    ]).join(totals, "quarter_date", "left")

    def pick(g: int, code: str):
        v = F.col(f"v_{code}")
        average = peers.others_average(code, v, F.col("member")) if code in PEER_CODES else F.lit(None).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v), F.struct(
            F.lit(g).cast("bigint").alias("group_ord"), F.lit(code).alias("code"), v.alias("value_num"),
            round_half_up(v - F.col(f"prev_{code}"), 6).alias("change"), average.alias("peer_average")))

    picks = F.array_compact(F.array(*[
        F.coalesce(*[pick(g, c) for c in group_codes]) for g, (group_codes, _) in enumerate(PRIORITY_GROUPS, 1)]))
    shown = fx.with_meta(wide.select(*fx.CELL, F.inline(picks)))
    status = regulatory.ui_status_of_code(F.col("code"), F.col("value_num"))
    return shown.select(
        *fx.CELL, "group_ord", "code", "label", "category", "value_num",
        auto_text("value_num").alias("display"),
        F.coalesce(fixed_text("change", 2), F.lit("-")).alias("qoq_change"),
        F.coalesce(
            fixed_text(round_half_up(F.col("value_num") - F.col("peer_average"), 6), 2), F.lit("-")
        ).alias("vs_peers"),
        status.alias("status"),
        F.coalesce(regulatory.ui_status_label(status), F.lit("N/A")).alias("status_label"),
    )


def summary_alerts(facts: DataFrame) -> DataFrame:
    """Summary ratios below a threshold."""
    picks = ranking.summary_picks(facts)
    status = regulatory.ui_status_of_code(F.col("code"), F.col("value_num"))
    rows = picks.withColumn("status", status).withColumn(
        "status_label", regulatory.ui_status_label(F.col("status"))
    )
    return fx.with_meta(regulatory.alerts(rows)).select(
        *fx.CELL, "group_ord", "code", "label", "value_num", "status", "status_label"
    )


def regulatory_report(facts: DataFrame) -> DataFrame:
    """Assistant-ruleset status line of every capital ratio."""
    rows = regulatory.status_line(regulatory.regulatory_status(facts, "agent"))
    return rows.select(
        *fx.CELL, "code", "rule_label", "value_num", "minimum", "well", "status", "line"
    )


def drill_down(
    facts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULE_CHANGES
) -> DataFrame:
    """Latest value, change, status and the definition change the series spans, per series."""
    kpi = trends.first_rule_change(trends.series_kpi(facts), rules, "oldest_quarter", "latest_quarter")
    rows = fx.with_meta(kpi)
    return rows.select(
        "rssd_id", "code", "label", "oldest_quarter", "latest_quarter", "n_values", "latest_value",
        "change", trends.is_good_change(F.col("change"), F.col("higher_better")).alias("change_is"),
        regulatory.ui_status_of_code(F.col("code"), F.col("latest_value")).alias("status"),
        F.coalesce("rule_label", F.lit("")).alias("rule_label"),
    )


def section_browser(items: DataFrame) -> DataFrame:
    """Sections of each filing with their size, and the filing totals."""
    from finfacts.functions.text import schedule_family

    sections = it.section_counts(items).withColumn("family", schedule_family("section"))
    totals = items.groupBy(*it.FILING).agg(F.count(F.lit(1)).alias("total_rows"))
    return sections.join(totals, it.FILING)
