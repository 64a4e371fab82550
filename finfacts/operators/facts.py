"""Selections and reshapes of the long facts frame.

``facts``: ``rssd_id, quarter_date, code, value_raw, value_num`` with at most one
row per (institution, quarter, code).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finfacts.functions.numeric import is_ratio
from finfacts.functions.text import SAFE_CODE
from finfacts.operators.intervals import band_join
from finfacts.reference_data import ratio_meta

CELL = ["rssd_id", "quarter_date"]


def safe_codes(codes: Sequence[str]) -> list[str]:
    """Requested codes that are plain identifiers, first mention order, no repeats."""
    ok = [c for c in codes if c and all(ch.isascii() and (ch.isalnum() or ch == "_") for ch in c)]
    return list(dict.fromkeys(ok))


def safe_code_rows(requests: DataFrame, column: str = "code") -> DataFrame:
    """The same whitelist for a frame of requested codes."""
    return requests.where(F.col(column).rlike(SAFE_CODE))


def valid_ratios(facts: DataFrame) -> DataFrame:
    return facts.where(is_ratio("value_raw"))


def between_quarters(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive range on the text key; reversed bounds are swapped. A literal range on the
    partition column, so it prunes partitions of a stored table."""
    return facts.where(F.col("quarter_date").between(min(start, end), max(start, end)))


def for_banks(facts: DataFrame, rssd_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Many institutions in one scan: a pushed-down IN list, or a semi join for a frame of ids."""
    if isinstance(rssd_ids, DataFrame):
        return facts.join(rssd_ids.select("rssd_id").distinct(), "rssd_id", "left_semi")
    return facts.where(F.col("rssd_id").isin(list(rssd_ids)))


def code_catalog(facts: DataFrame) -> DataFrame:
    """Codes reported in each quarter, all quarters at once."""
    return facts.select("quarter_date", "code").distinct()


def all_codes(facts: DataFrame) -> DataFrame:
    return facts.select("code").distinct()


def wide(
    facts: DataFrame, codes: Sequence[str], value: str | Column = "value_raw", keys: Sequence[str] = CELL
) -> DataFrame:
    """One row per key with a column per requested code; an absent code is a NULL column.

    The explicit code list avoids the extra job a value-less pivot runs, and numeric
    values keep this a hash aggregate with map-side combine.
    """
    codes = safe_codes(codes)
    value = F.col(value) if isinstance(value, str) else value
    return (
        facts.where(F.col("code").isin(codes))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("code") == c, value)).alias(c) for c in codes])
    )


def long(wide_rows: DataFrame, codes: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Back to one row per non-null cell."""
    return (
        wide_rows.unpivot(list(keys), [c for c in codes if c in wide_rows.columns], "code", "value_raw")
        .where(F.col("value_raw").isNotNull())
    )


def union_quarters(*frames: DataFrame) -> DataFrame:
    """Stack wide quarter tables by column name; a column a quarter lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_meta(facts: DataFrame) -> DataFrame:
    """Label, category and direction; unknown codes keep the code as label and fall under Other."""
    meta = F.broadcast(ratio_meta(facts.sparkSession))
    return (
        facts.join(meta, "code", "left")
        .withColumn("label", F.coalesce("label", "code"))
        .withColumn("category", F.coalesce("category", F.lit("Other")))
    )


def with_bank_names(frame: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institution name, or the id text when unknown. The dimension grows with the data, so
    the join strategy is left to the optimizer's size check."""
    names = institutions.select("rssd_id", "name")
    return frame.join(names, "rssd_id", "left").withColumn("name", F.coalesce("name", "rssd_id"))


def code_presence(facts: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """For each key: is each required code present? One aggregate of flags, no code list is collected."""
    required = list(required)
    found = facts.where(F.col("code").isin(required)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("code") == c, 1).otherwise(0)).alias(f"p{i}") for i, c in enumerate(required)]
    )
    flags = facts.select(*keys).distinct().join(found, list(keys), "left")
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("code"), (F.coalesce(f"p{i}", F.lit(0)) == 1).alias("present"))
            for i, c in enumerate(required)
        ]
    )
    return flags.select(*keys, F.inline(rows))


def codes_in_value_bands(facts: DataFrame, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Which codes hold a value inside each named band. Row-wise, so no join."""
    hits = F.filter(
        F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands]),
        lambda b: (F.col("value_num") >= b["lo"]) & (F.col("value_num") <= b["hi"]),
    )
    return facts.select("rssd_id", "quarter_date", "code", "value_num", F.explode(hits).alias("b")).select(
        "rssd_id", "quarter_date", "code", "value_num", F.col("b.band").alias("band")
    )


def values_in_bands(facts: DataFrame, bands: DataFrame) -> DataFrame:
    """Facts beside each band of a table ``(band, lo, hi)`` that holds their value, both ends included, null open."""
    return band_join(facts, F.col("value_num"), bands)


def find_codes(catalog: DataFrame, prefix: str | None = None, any_of: Sequence[str] = ()) -> DataFrame:
    """Codes starting with a prefix or containing any of some substrings."""
    test = F.lit(False)
    if prefix is not None:
        test = test | F.col("code").startswith(prefix)
    for part in any_of:
        test = test | F.col("code").contains(part)
    return catalog.where(test)


def category_map(facts: DataFrame) -> DataFrame:
    """Codes in use by category: how many, and ``code=label`` entries in code order."""
    used = with_meta(all_codes(facts))
    entry = F.concat_ws("=", "code", "label")
    return used.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_codes"), F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("codes")
    )


def listed_codes(facts: DataFrame, codes: Sequence[str], name: str = "codes") -> DataFrame:
    """The listed codes that each cell has, in list order, as one comma text."""
    have = wide(facts, codes, "value_num")
    own = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in safe_codes(codes)]))
    return have.select(*CELL, F.array_join(own, ",").alias(name))


def castable_average(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of the values that are numbers; the others are skipped, none at all gives NULL.
    Summed as decimal, so the result does not depend on task order."""
    value, large = F.col("value_num"), F.abs("value_num") >= 1e21
    # Values too large for the decimal are summed apart.
    total = (F.sum(F.when(large, F.lit(0.0)).otherwise(value).cast("decimal(30,8)")).cast("double")
             + F.sum(F.when(large, value).otherwise(F.lit(0.0))))
    return facts.groupBy(*keys).agg(
        (total / F.nullif(F.count("value_num"), F.lit(0))).alias("avg_value"),
        F.count("value_num").alias("n_values"),
    )
