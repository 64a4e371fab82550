"""Quarter-over-quarter series work. Every window is per (institution, code), which holds at
most one row per calendar quarter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from finfacts.functions.numeric import percent_text, prefix_number, round_half_up
from finfacts.functions.periods import quarter_keys
from finfacts.operators.facts import with_meta

SERIES = ["rssd_id", "code"]


def oldest_first() -> WindowSpec:
    return W.partitionBy(*SERIES).orderBy("quarter_date")


def newest_first() -> WindowSpec:
    return W.partitionBy(*SERIES).orderBy(F.col("quarter_date").desc())


def latest_quarters(facts: DataFrame, n: int = 8) -> DataFrame:
    """The newest ``n`` stored quarters, one row each."""
    return facts.select("quarter_date").distinct().orderBy(F.col("quarter_date").desc()).limit(n)


def in_latest_quarters(facts: DataFrame, n: int = 8) -> DataFrame:
    """Facts of the newest ``n`` quarters. The key side has ``n`` rows, so it is broadcast and
    prunes partitions of a stored table at run time."""
    return facts.join(F.broadcast(latest_quarters(facts, n)), "quarter_date", "left_semi")


def is_good_change(change: Column, higher_better: Column) -> Column:
    good = F.when(F.coalesce(higher_better, F.lit(False)), change >= 0).otherwise(change <= 0)
    return F.when(change.isNotNull(), F.when(good, "good").otherwise("bad"))


def quarter_change(facts: DataFrame) -> DataFrame:
    """Each numeric value beside the previous reported quarter's: ``prev_quarter, prev_value, change``."""
    return (
        facts.where(F.col("value_num").isNotNull())
        .withColumn("prev_quarter", F.lag("quarter_date").over(oldest_first()))
        .withColumn("prev_value", F.lag("value_num").over(oldest_first()))
        .withColumn("change", round_half_up(F.col("value_num") - F.col("prev_value"), 6))
    )


def with_direction(changes: DataFrame) -> DataFrame:
    return with_meta(changes).withColumn(
        "change_is", is_good_change(F.col("change"), F.col("higher_better"))
    )


def sparkline(facts: DataFrame, n: int = 4) -> DataFrame:
    """Last ``n`` numeric values per series, oldest first. The row-number limit is applied before
    the shuffle, so only ``n`` rows per series and task travel."""
    last = (
        facts.where(F.col("value_num").isNotNull())
        .withColumn("rn", F.row_number().over(newest_first()))
        .where(F.col("rn") <= n)
    )
    points = F.sort_array(F.collect_list(F.struct("quarter_date", "value_num")))
    return last.groupBy(*SERIES).agg(F.transform(points, lambda p: p["value_num"]).alias("values"))


def scaled(facts: DataFrame, floor: float = 0.001) -> DataFrame:
    """Min-max position of each value in its series; a flat series divides by ``floor``."""
    series = W.partitionBy(*SERIES)
    low, high = F.min("value_num").over(series), F.max("value_num").over(series)
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(floor))
    return facts.where(F.col("value_num").isNotNull()).withColumn(
        "scaled", round_half_up((F.col("value_num") - low) / span, 6)
    )


def series_kpi(facts: DataFrame) -> DataFrame:
    """Per series: latest value, its change, and the oldest and latest quarter reported.
    The collected points of a series are bounded by the calendar."""
    points = F.sort_array(
        F.collect_list(F.when(F.col("value_num").isNotNull(), F.struct("quarter_date", "value_num")))
    )
    last, before = F.get("points", F.size("points") - 1), F.get("points", F.size("points") - 2)
    return (
        facts.groupBy(*SERIES)
        .agg(
            points.alias("points"),
            F.min("quarter_date").alias("oldest_quarter"),
            F.max("quarter_date").alias("latest_quarter"),
        )
        .select(
            *SERIES, "oldest_quarter", "latest_quarter",
            F.size("points").cast("bigint").alias("n_values"),
            last["value_num"].alias("latest_value"),
            round_half_up(last["value_num"] - before["value_num"], 6).alias("change"),
        )
    )


def _crossed(rules: Sequence[tuple[str, str, str]], start: Column, end: Column) -> Column:
    low, high = F.least(start, end), F.greatest(start, end)
    listed = F.array(
        *[
            F.struct(F.lit(d).alias("rule_date"), F.lit(l).alias("rule_label"), F.lit(t).alias("rule_note"))
            for d, l, t in rules
        ]
    )
    return F.filter(listed, lambda r: (r["rule_date"] > low) & (r["rule_date"] <= high))


def rule_changes_crossed(
    frame: DataFrame, rules: Sequence[tuple[str, str, str]], start: str, end: str
) -> DataFrame:
    """One row per definition change inside the row's window (start excluded, end included)."""
    return frame.select("*", F.inline(_crossed(rules, F.col(start), F.col(end))))


def first_rule_change(
    frame: DataFrame, rules: Sequence[tuple[str, str, str]], start: str, end: str
) -> DataFrame:
    """The first listed definition change inside the row's window, NULL when none."""
    hit = F.get(_crossed(rules, F.col(start), F.col(end)), F.lit(0))
    return frame.withColumn("rule_label", hit["rule_label"]).withColumn("rule_note", hit["rule_note"])


def calendar_filled(facts: DataFrame, quarters: Sequence[str] | None = None) -> DataFrame:
    """Every series on every listed quarter as percent text, ``-`` where nothing was reported; by default every
    quarter between the first and the last of the facts (one row is read for them).
    A series is gathered once (bounded by the calendar); no series-by-calendar join is needed."""
    if quarters is None:
        span = facts.agg(F.min("quarter_date").alias("a"), F.max("quarter_date").alias("b")).first()
        quarters = quarter_keys(span.a, span.b) if span.a else []
    cells = F.map_from_entries(F.collect_list(F.struct("quarter_date", F.col("value_raw"))))
    listed = F.array(*map(F.lit, quarters))
    return (
        facts.where(F.col("quarter_date").isin(list(quarters)) & F.col("value_raw").isNotNull())
        .groupBy(*SERIES)
        .agg(cells.alias("cells"))
        .select(*SERIES, "cells", F.explode(listed).alias("quarter_date"))
        .select(
            *SERIES, "quarter_date",
            percent_text(prefix_number(F.try_element_at("cells", F.col("quarter_date")))).alias("display"),
        )
    )
