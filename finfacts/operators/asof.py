"""Nearest and latest rows in time within a key, by one sort instead of comparing dates pairwise.

Wanted dates and filed dates are stacked, sorted within (key, year), and each wanted date takes the last filed date
before it and the first one after it. Wanted dates are made distinct first, so a key that many requests name
costs no more than its calendar; a year takes in the last date filed before it and the first one after it, so
a key's years are separate groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _year(date: str) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def _with_edges(stacked: DataFrame, keys: list[str]) -> DataFrame:
    """``stacked`` and, for each (key, year) in it, the nearest filed dates outside the year as rows of their own."""
    filed = F.when(F.col("__filed"), F.col("__date"))
    years = stacked.groupBy(*keys, "__year").agg(F.min(filed).alias("a"), F.max(filed).alias("b"))
    # One row a year: a key's calendar.
    order = W.partitionBy(*keys).orderBy("__year")
    before = F.last("b", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("a", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    near = years.select(*keys, "__year", F.array_compact(F.array(before, after)).alias("near"))
    edges = near.select(*keys, "__year", F.explode("near").alias("__date"), F.lit(True).alias("__filed"))
    return stacked.unionByName(edges.select(*stacked.columns))


def nearest_dates(wanted: DataFrame, filed: DataFrame, keys: Sequence[str], date: str, filed_date: str) -> DataFrame:
    """``(keys, date, before, after)`` of each distinct wanted date (YYYYMMDD): the last date filed by then, the date
    itself included, and the first one from then on. NULL where there is none; null keys and dates are left out."""
    keys = list(keys)
    ask = wanted.select(*keys, F.col(date).alias("__date")).distinct().withColumn("__filed", F.lit(False))
    have = filed.select(*keys, F.col(filed_date).alias("__date")).distinct().withColumn("__filed", F.lit(True))
    stacked = ask.unionByName(have).withColumn("__year", _year("__date"))
    stacked = stacked.where(F.col("__year").isNotNull()).dropna(subset=keys)
    every = _with_edges(stacked, keys)
    # Filed dates come first among equal ones in one direction, and last in the other: both see the date itself.
    group = W.partitionBy(*keys, "__year")
    value = F.when(F.col("__filed"), F.col("__date"))
    upto = group.orderBy("__date", F.col("__filed").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    since = group.orderBy(F.col("__date").desc(), F.col("__filed").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = every.withColumn("before", F.last(value, ignorenulls=True).over(upto)).withColumn(
        "after", F.last(value, ignorenulls=True).over(since))
    return found.where(~F.col("__filed")).select(*keys, F.col("__date").alias(date), "before", "after")


def _day(date: Column) -> Column:
    return F.try_to_date(date, "yyyyMMdd")


def nearest_filing(requests: DataFrame, filed: DataFrame, keys: Sequence[str], date: str, filed_date: str) -> DataFrame:
    """``requests`` with ``nearest`` (the filed date fewest days away, the later of two) and ``gap_days``.

    Requests without a key or date, and keys that never filed, get NULLs. The answers have one row for each distinct
    (key, date), so the join back can split a key that many requests name.
    """
    keys = list(keys)
    dates = nearest_dates(requests, filed, keys, date, filed_date)
    to_before, to_after = (F.abs(F.datediff(_day(F.col(date)), _day(F.col(c)))) for c in ("before", "after"))
    nearest = F.when(F.col("before").isNull() | (to_after <= to_before), F.coalesce("after", "before")).otherwise(F.col("before"))
    answers = dates.select(*keys, date, nearest.alias("nearest"))
    return requests.join(answers, [*keys, date], "left").withColumn(
        "gap_days", F.datediff(_day(F.col("nearest")), _day(F.col(date))).cast("bigint"))


def latest_values(requests: DataFrame, filed: DataFrame, keys: Sequence[str], date: str, filed_date: str) -> DataFrame:
    """``requests`` with the columns of the newest filed row at or before their date (as-of); one filed row a key and date."""
    keys = list(keys)
    answers = nearest_dates(requests, filed, keys, date, filed_date).select(*keys, date, F.col("before").alias(filed_date))
    values = answers.join(filed, [*keys, filed_date], "left")
    return requests.join(values, [*keys, date], "left").select(
        *requests.columns, *[c for c in filed.columns if c not in keys])
