"""Which quarters to ingest, keep or delete.

Frames here have one row per calendar quarter, so single-partition ordering is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from finfacts.reference_data import (
    BUDGET_GB, FIRST_YEAR, MIN_REMAINING_GB, PLANNED_QUARTER_MB, PUBLICATION_LAG_QUARTERS,
    RECENT_QUARTERS,
)
from finfacts.functions.periods import quarter_calendar


def published_quarters(
    spark: SparkSession, as_of: str, start_year: int = FIRST_YEAR,
    lag_quarters: int = PUBLICATION_LAG_QUARTERS,
) -> DataFrame:
    return quarter_calendar(spark, as_of, start_year, lag_quarters)


def newest(quarters: DataFrame, n: int = RECENT_QUARTERS) -> DataFrame:
    return quarters.orderBy(F.col("quarter_date").desc()).limit(n)


def to_ingest(published: DataFrame, stored: DataFrame, recent: int | None = None) -> DataFrame:
    """Published but not stored; only among the newest ``recent`` when given."""
    window = newest(published, recent) if recent else published
    return window.join(stored.select("quarter_date").distinct(), "quarter_date", "left_anti")


def to_delete(stored: DataFrame, published: DataFrame) -> DataFrame:
    """Stored but not (or not yet) published."""
    return stored.join(published.select("quarter_date"), "quarter_date", "left_anti")


def quarter_lists(facts: DataFrame) -> DataFrame:
    """The stored quarters as comma lists, oldest first and newest first; one row."""
    keys = F.collect_list("quarter_date")
    return facts.select("quarter_date").distinct().agg(
        F.array_join(F.sort_array(keys), ",").alias("oldest_first"),
        F.array_join(F.sort_array(keys, asc=False), ",").alias("newest_first"),
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("n_quarters"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        (F.coalesce(F.sum("bytes"), F.lit(0)).cast("double") / float(1024**3)).alias("total_gb"),
    )


def with_planned_bytes(plan: DataFrame) -> DataFrame:
    return plan.withColumn("bytes", F.lit(PLANNED_QUARTER_MB * 1024 * 1024).cast("bigint"))


def admit(
    plan: DataFrame, budget_gb: float = BUDGET_GB, min_remaining_gb: float = MIN_REMAINING_GB
) -> DataFrame:
    """Newest first: a quarter is admitted while the budget left before it is at least the minimum.
    The budget left only shrinks, so this equals stopping at the first one that does not fit."""
    before = W.orderBy(F.col("quarter_date").desc()).rowsBetween(W.unboundedPreceding, -1)
    prior = F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("bigint"))
    left = F.lit(budget_gb) - prior.cast("double") / float(1024**3)
    return (
        plan.withColumn("prior_bytes", prior.cast("bigint"))
        .withColumn("remaining_gb", left)
        .withColumn("decision", F.when(left >= min_remaining_gb, "admitted").otherwise("deferred"))
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Run summary from per-quarter outcomes ``(quarter_date, outcome, bytes)``."""

    def listed(kind: str):
        some = F.sort_array(F.collect_list(F.when(F.col("outcome") == kind, F.col("quarter_date"))), asc=False)
        return F.array_join(some, ",")

    failed = F.count(F.when(F.col("outcome") == "failed", 1))
    return outcomes.agg(
        listed("succeeded").alias("succeeded"),
        listed("failed").alias("failed"),
        listed("deferred").alias("deferred"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "succeeded", F.col("bytes"))), F.lit(0))
        .cast("bigint").alias("bytes_written"),
        F.when(failed > 0, "completed_with_errors")
        .when(F.count(F.lit(1)) == 0, "up_to_date")
        .otherwise("completed").alias("result"),
    )
