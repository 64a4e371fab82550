"""Filing line items: sections, metrics, pivoted reports.

``items``: ``rssd_id, reporting_period, ord, item_code, value_raw, description, section, ...``.
``ord`` is any orderable filing position (a source line number, or a struct of source keys).
A filing may be arbitrarily large: everything here combines map-side or keeps a bounded top-n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from finfacts.functions.numeric import (
    fraction_percent_text, grouped_text, lenient_number, safe_divide,
)
from finfacts.functions.text import column_header, column_key, field_id, normalize_schedule
from finfacts.reference_data import METRIC_META, METRIC_VARIANTS

FILING = ["rssd_id", "reporting_period"]


def with_section(items: DataFrame) -> DataFrame:
    return items.withColumn("section", normalize_schedule("schedule"))


def first_values(items: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """First occurrence of each item code in a filing (code trimmed, upper case, blanks dropped).
    The first occurrence wins even when its value is blank."""
    rows = items.withColumn("item_code", F.upper(F.trim("item_code"))).where(F.col("item_code") != "")
    if codes is not None:
        rows = rows.where(F.col("item_code").isin(list(codes)))
    return rows.groupBy(*FILING, "item_code").agg(F.min_by("value_raw", "ord").alias("value_raw"))


def last_values(items: DataFrame) -> DataFrame:
    """Last occurrence of each item code in a filing, codes as written."""
    return items.groupBy(*FILING, "item_code").agg(F.max_by("value_raw", "ord").alias("value_raw"))


def variant_values(items: DataFrame) -> DataFrame:
    """One row per filing with a column per base measure: the first code variant that holds a number.

    Two aggregates: the first keyed by (filing, code) shrinks any filing to a handful of rows
    before the second turns them into columns.
    """
    wanted = [c for _, codes in METRIC_VARIANTS for c in codes]
    return _variant_columns(first_values(items, wanted))


def _variant_columns(firsts: DataFrame, *more: Column) -> DataFrame:
    """First values of known codes to a column per base measure, beside other aggregates of a filing."""
    return firsts.withColumn("num", lenient_number("value_raw")).groupBy(*FILING).agg(
        *more,
        *[
            F.coalesce(*[F.max(F.when(F.col("item_code") == c, F.col("num"))) for c in codes]).alias(metric)
            for metric, codes in METRIC_VARIANTS
        ]
    )


def sum_of_present(*columns: Column) -> Column:
    """Sum of the non-null values; NULL only when all are NULL."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def metrics(items: DataFrame) -> DataFrame:
    """The nine measures of each filing; missing inputs and zero denominators give NULL.
    Filings without any known code still get a row.

    Rows and measures come from one scan: the first aggregate keeps each known code and all the others of a filing
    as one more row, the second adds up their rows and turns the codes into columns."""
    c = F.col
    code = F.upper(F.trim("item_code"))
    wanted = [x for _, codes in METRIC_VARIANTS for x in codes]
    known = F.when(code.isin(wanted), code)
    firsts = items.groupBy(*FILING, known.alias("item_code")).agg(
        F.min_by(F.when(known.isNotNull(), F.col("value_raw")), "ord").alias("value_raw"), F.count(F.lit(1)).alias("n"))
    based = _variant_columns(firsts, F.sum("n").alias("total_rows"))
    residential = sum_of_present(c("res_1_4"), c("multifamily"), c("construction"))
    return based.withColumn("residential_total", residential).select(
        *FILING, "total_rows", "total_assets", "total_loans", "total_deposits", "total_equity", "net_income",
        "residential_total",
        safe_divide(c("residential_total"), c("total_loans")).alias("residential_ratio"),
        safe_divide(c("total_equity"), c("total_assets")).alias("equity_to_assets"),
        safe_divide(c("total_loans"), c("total_deposits")).alias("loans_to_deposits"),
    )


def metric_rows(measured: DataFrame) -> DataFrame:
    """Long form: ``metric, grp, label, unit, value, display`` in display order."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("metric_ord"), F.lit(m).alias("metric"),
                F.lit(group).alias("metric_group"), F.lit(label).alias("label"),
                F.lit(unit).alias("unit"), F.col(m).alias("value"),
            )
            for i, (m, group, label, unit) in enumerate(METRIC_META, 1)
        ]
    )
    money, share = grouped_text("value", 0), fraction_percent_text("value")
    return measured.select(*FILING, F.inline(cells)).withColumn(
        "display", F.coalesce(F.when(F.col("unit") == "fraction", share).otherwise(money), F.lit("-"))
    )


def metric_matrix(measured: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Metric rows by listed periods, one block per institution."""
    return (
        metric_rows(measured)
        .groupBy("rssd_id", "metric_group", "metric_ord", "metric", "label")
        .pivot("reporting_period", list(periods))
        .agg(F.first("display"))
    )


def section_counts(items: DataFrame) -> DataFrame:
    return (
        items.where(F.col("section").isNotNull())
        .groupBy(*FILING, "section")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def section_list(items: DataFrame) -> DataFrame:
    """Sorted sections of each filing as text. Sections are made distinct before they are gathered."""
    return section_counts(items).groupBy(*FILING).agg(
        F.array_join(F.sort_array(F.collect_list("section")), ", ").alias("sections")
    )


def all_sections(items: DataFrame) -> DataFrame:
    return items.where(F.col("section").isNotNull()).select("section").distinct()


def requested_sections(items: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Row count of every requested section of every filing, 0 when the filing lacks it."""
    flags = items.groupBy(*FILING).agg(
        *[F.count(F.when(F.col("section") == s, 1)).alias(f"s{i}") for i, s in enumerate(sections)]
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias("section"), F.col(f"s{i}").alias("n_rows")) for i, s in enumerate(sections)]
    )
    return flags.select(*FILING, F.inline(rows))


def select_sections(items: DataFrame, sections: Sequence[str]) -> DataFrame:
    return items.where(F.col("section").isin(list(sections)))


def filing_counts(items: DataFrame) -> DataFrame:
    """Rows, distinct item codes and distinct sections per filing, through one pre-aggregate."""
    cells = items.groupBy(*FILING, "section", "item_code").agg(F.count(F.lit(1)).alias("n"))
    codes = cells.groupBy(*FILING, "item_code").agg(
        F.sum("n").alias("n"), F.collect_set("section").alias("in_sections")
    )
    return codes.groupBy(*FILING).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_codes"),
        F.size(F.array_distinct(F.flatten(F.collect_set("in_sections")))).cast("bigint").alias("n_sections"),
    )


def field_catalog(items: DataFrame) -> DataFrame:
    """Selectable fields with a ``section::code`` id; rows outside any section are left out."""
    return items.where(F.col("section").isNotNull()).select(
        *FILING, field_id("section", "item_code").alias("id"), "item_code", "description",
        F.col("value_raw").alias("value"), "line_number", "section", "last_update",
    )


def top_rows(items: DataFrame, n: int = 10, text_width: int = 48) -> DataFrame:
    """First ``n`` rows of every section of every filing, description cut for display, and how many
    more there are. The row limit is applied map-side; counts come from a combining aggregate."""
    order = W.partitionBy(*FILING, "section").orderBy("ord")
    rows = items.where(F.col("section").isNotNull())
    heads = rows.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= n)
    return heads.join(section_counts(items), [*FILING, "section"]).select(
        *FILING, "section", "pos", "item_code",
        F.substring("description", 1, text_width).alias("description"),
        F.col("value_raw").alias("value"), F.col("n_rows").alias("section_rows"),
        F.greatest(F.col("n_rows") - n, F.lit(0).cast("bigint")).alias("n_more"),
    )


def search(items: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows whose code, description or value contains a term, once per matching term. Row-wise."""
    fields = [F.lower(c) for c in ("item_code", "description", "value_raw")]

    def hit(term: Column) -> Column:
        needle = F.lower(F.trim(term))
        test = F.lit(False)
        for f in fields:
            test = test | F.coalesce(F.contains(f, needle), F.lit(False))
        return test

    return items.select("*", F.explode(F.filter(F.array(*map(F.lit, terms)), hit)).alias("term"))


def bank_period_grid(institutions: DataFrame, items: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Every institution on every listed period; a combination without filing is kept and flagged.
    The grid is the requested output itself, made by exploding the period list in place."""
    grid = institutions.select("rssd_id", "name", F.explode(F.array(*map(F.lit, periods))).alias("reporting_period"))
    filed = items.groupBy(*FILING).agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(filed, FILING, "left").select(
        *FILING, "name", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"),
        F.col("n_rows").isNull().alias("is_missing"),
    )


def select_fields(
    items: DataFrame, codes: Sequence[str], overrides: DataFrame | None = None
) -> DataFrame:
    """Selected item codes; ``overrides (rssd_id, item_code)`` replaces the selection for the
    institutions it names, within the general selection."""
    rows = items.where(F.col("item_code").isin(list(codes)))
    if overrides is None:
        return rows
    allowed = overrides.select("rssd_id", "item_code").distinct().withColumn("allowed", F.lit(True))
    limited = overrides.select("rssd_id").distinct().withColumn("limited", F.lit(True))
    return (
        rows.join(limited, "rssd_id", "left")
        .join(allowed, ["rssd_id", "item_code"], "left")
        .where(F.col("limited").isNull() | F.col("allowed").isNotNull())
        .drop("limited", "allowed")
    )


def report_cells(
    items: DataFrame, institutions: DataFrame, many_banks: bool = True, many_periods: bool = True
) -> DataFrame:
    """Custom report in long form: ``section, item_code, col_key, header, description, value``.

    Cells are keyed by institution id; the label is the name, or ``name (id)`` when several
    institutions share it, so equal names never collide. The last occurrence of a code gives the
    value, the first one the description. Long form has no limit on the number of columns.
    """
    cells = (
        items.where(F.col("section").isNotNull())
        .groupBy("section", "item_code", *FILING)
        .agg(F.min_by("description", "ord").alias("description"), F.max_by("value_raw", "ord").alias("value"))
    )
    shared = institutions.groupBy("name").agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1")
    labels = institutions.join(shared, "name", "left").select(
        "rssd_id",
        F.when(F.col("n_same").isNotNull(), F.concat("name", F.lit(" ("), F.col("rssd_id"), F.lit(")")))
        .otherwise(F.col("name")).alias("bank_label"),
    )
    named = cells.join(labels, "rssd_id", "left").withColumn(
        "bank_label", F.coalesce("bank_label", "rssd_id")
    )
    key = column_key(F.col("bank_label"), F.col("reporting_period"), many_banks, many_periods)
    return named.select(
        "section", "item_code", *FILING, key.alias("col_key"), column_header(key).alias("header"),
        "description", "value",
    )


def report_by_period(items: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Custom report pivoted on listed periods: one row per institution, section and item code."""
    rows = items.where(F.col("section").isNotNull() & F.col("reporting_period").isin(list(periods)))
    keys = ["rssd_id", "section", "item_code"]
    cells = rows.groupBy(*keys, "reporting_period").agg(
        F.min(F.struct("ord", "description")).alias("first_text"), F.max_by("value_raw", "ord").alias("value")
    )
    return (
        cells.groupBy(*keys)
        .agg(
            F.min("first_text")["description"].alias("description"),
            *[F.max(F.when(F.col("reporting_period") == p, F.col("value"))).alias(p) for p in periods],
        )
    )


def wanted_codes(items: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Per institution: which wanted codes any of its filings has, and which it lacks."""
    flags = items.groupBy("rssd_id").agg(
        *[F.max(F.when(F.col("item_code") == c, 1).otherwise(0)).alias(f"w{i}") for i, c in enumerate(wanted)]
    )
    pick = lambda v: F.array_join(
        F.filter(
            F.array(*[F.when(F.col(f"w{i}") == v, F.lit(c)) for i, c in enumerate(wanted)]),
            lambda x: x.isNotNull(),
        ),
        ",",
    )
    n = sum((F.col(f"w{i}") for i in range(len(wanted))), F.lit(0))
    return flags.select(
        "rssd_id", pick(1).alias("present"), pick(0).alias("missing"),
        n.cast("bigint").alias("n_present"), (F.lit(len(wanted)) - n).cast("bigint").alias("n_missing"),
    )
