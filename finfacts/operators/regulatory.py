"""Capital thresholds: two published rule sets that disagree, kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from finfacts.functions.numeric import fixed_text
from finfacts.operators.facts import valid_ratios
from finfacts.reference_data import AGENT_THRESHOLDS, UI_THRESHOLDS, agent_thresholds, ui_thresholds


def ui_status(value: Column, minimum: Column, well: Column) -> Column:
    return (
        F.when(value.isNull() | minimum.isNull(), F.lit(None).cast("string"))
        .when(value < minimum, "danger")
        .when(value < well, "warning")
        .otherwise("healthy")
    )


def ui_status_label(status: Column) -> Column:
    return (
        F.when(status == "danger", "Below Minimum")
        .when(status == "warning", "Below Well-Capitalized")
        .when(status == "healthy", "Well-Capitalized")
    )


def ui_status_of_code(code: Column, value: Column) -> Column:
    """Dashboard status straight from the fixed six-code table; NULL for other codes."""
    out = F.lit(None).cast("string")
    for known, minimum, well, _ in UI_THRESHOLDS:
        out = F.when(code == known, ui_status(value, F.lit(minimum), F.lit(well))).otherwise(out)
    return out


def agent_status(value: Column, well: Column, adequate: Column) -> Column:
    return (
        F.when(value >= well, "WELL-CAPITALIZED")
        .when(value >= adequate, "ADEQUATELY CAPITALIZED")
        .otherwise("UNDERCAPITALIZED")
    )


def regulatory_status(facts: DataFrame, ruleset: str = "ui") -> DataFrame:
    """Status of every capital ratio of every institution and quarter.

    ``ruleset`` is ``ui`` (danger / warning / healthy) or ``agent`` (well / adequately / under).
    """
    spark = facts.sparkSession
    # A literal list of codes reaches the scan; the join alone would read every code.
    listed = [r[0] for r in (UI_THRESHOLDS if ruleset == "ui" else AGENT_THRESHOLDS)]
    valid = valid_ratios(facts.where(F.col("code").isin(listed)))
    if ruleset == "ui":
        rows = valid.join(F.broadcast(ui_thresholds(spark)), "code")
        status = ui_status(F.col("value_num"), F.col("minimum"), F.col("well"))
        return rows.withColumn("status", status).withColumn("status_label", ui_status_label(F.col("status")))
    if ruleset == "agent":
        rows = valid.join(F.broadcast(agent_thresholds(spark)), "code")
        return rows.withColumn(
            "status", agent_status(F.col("value_num"), F.col("well"), F.col("adequate"))
        )
    raise ValueError(f"unknown ruleset {ruleset!r}")


def status_line(rows: DataFrame) -> DataFrame:
    """The assistant's one-line text for each checked ratio."""
    pct = lambda c: F.concat(fixed_text(c, 1), F.lit("%"))
    return rows.withColumn(
        "line",
        F.concat(
            F.col("rule_label"), F.lit(" ("), F.col("code"), F.lit("): "),
            fixed_text("value_num", 2), F.lit("% — "), F.col("status"),
            F.lit(" (min: "), pct("minimum"), F.lit(", well-cap: "), pct("well"), F.lit(")"),
        ),
    )


def alerts(rows: DataFrame) -> DataFrame:
    """Rows whose dashboard status is not healthy."""
    return rows.where(F.col("status").isin("danger", "warning"))
