"""Which ratios to show, and in what order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from finfacts.operators.facts import CELL, valid_ratios, wide, with_meta
from finfacts.reference_data import PRIORITY_CODES, PRIORITY_GROUPS


SUMMARY_CODES = sorted({c for group, _ in PRIORITY_GROUPS for c in group})


def summary_picks(facts: DataFrame) -> DataFrame:
    """First available valid code of each summary group, per institution and quarter:
    ``group_ord, code, value_num, fallback_label``. One aggregate to a row of candidate values."""
    codes = [c for group, _ in PRIORITY_GROUPS for c in group]
    rows = wide(valid_ratios(facts), codes, "value_num")
    picks = []
    for g, (group, fallback) in enumerate(PRIORITY_GROUPS, 1):
        candidates = [
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.lit(g).cast("bigint").alias("group_ord"), F.lit(c).alias("code"),
                    F.col(c).alias("value_num"), F.lit(fallback).alias("fallback_label"),
                ),
            )
            for c in group
        ]
        picks.append(F.coalesce(*candidates))
    return rows.select(*CELL, F.explode(F.filter(F.array(*picks), lambda p: p.isNotNull())).alias("p")).select(
        *CELL, "p.*"
    )


def display_order(ratios: DataFrame) -> DataFrame:
    """Metadata plus ``display_pos``: priority codes in list order, then by category and code."""
    place = F.array_position(F.array(*map(F.lit, PRIORITY_CODES)), F.col("code"))
    order = W.partitionBy(*CELL).orderBy(
        F.nullif(place, F.lit(0)).asc_nulls_last(), F.col("category"), F.col("code")
    )
    return with_meta(ratios).withColumn("display_pos", F.row_number().over(order).cast("bigint"))


def first_by_code(ratios: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` ratios of each institution and quarter in code order."""
    order = W.partitionBy(*CELL).orderBy("code")
    return ratios.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= n)


def first_by_value(frame: DataFrame, n: int = 40, keys: list[str] | None = None) -> DataFrame:
    """The ``n`` smallest values per key, ties by code."""
    order = W.partitionBy(*(keys or CELL)).orderBy("value_num", "code")
    return frame.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= n)
