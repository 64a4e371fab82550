"""Side-by-side comparison of chosen (institution, quarter) pairs, in any number of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from finfacts.functions.numeric import auto_text, is_ratio
from finfacts.functions.periods import quarter_label
from finfacts.functions.text import short_name
from finfacts.operators.facts import CELL, wide
from finfacts.operators.regulatory import ui_status_of_code
from finfacts.reference_data import COMPARE_CODES, RATIO_META


def _listed() -> list[tuple[str, int, str]]:
    return [(category, i, c) for category, codes in COMPARE_CODES for i, c in enumerate(codes, 1)]


def _grid(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Every member with a column for each compare code."""
    codes = [c for _, _, c in _listed()]
    return members.join(wide(facts.where(is_ratio("value_raw")), codes, "value_num"), CELL, "left")


def _extremes(grid: DataFrame) -> DataFrame:
    codes = [c for _, _, c in _listed()]
    return grid.groupBy("set_id").agg(
        *[F.max(c).alias(f"max_{c}") for c in codes],
        *[F.min(c).alias(f"min_{c}") for c in codes],
        *[F.count(c).alias(f"n_{c}") for c in codes],
    )


def set_extremes(members: DataFrame, facts: DataFrame) -> DataFrame:
    """``set_id, category, code, max_value, min_value, n_values`` of the codes that some member reports."""
    cells = F.array(*[
        F.struct(F.lit(category).alias("category"), F.lit(c).alias("code"), F.col(f"max_{c}").alias("max_value"),
                 F.col(f"min_{c}").alias("min_value"), F.col(f"n_{c}").alias("n_values"))
        for category, _, c in _listed()
    ])
    return _extremes(_grid(members, facts)).select("set_id", F.inline(cells)).where("n_values > 0")


def compare(members: DataFrame, facts: DataFrame, direction_aware: bool = False) -> DataFrame:
    """``members``: ``set_id, rssd_id, quarter_date, name``. One output row per member and
    compare code that at least one member of the set reports.

    Best is the set maximum and worst the minimum; with ``direction_aware`` lower-better ratios
    swap. Set extremes come from a combining aggregate and are looked up again, so a set of any
    size never has to fit one task; a hot set is split by the adaptive skew join.
    """
    meta = {m[0]: m for m in RATIO_META}
    grid = _grid(members, facts)
    extremes = _extremes(grid)
    cells = F.array(
        *[
            F.struct(
                F.lit(category).alias("category"), F.lit(i).cast("bigint").alias("code_ord"),
                F.lit(c).alias("code"), F.lit(meta[c][1]).alias("label"),
                F.lit(meta[c][3] is False).alias("lower_better"),
                F.col(c).alias("value_num"), F.col(f"max_{c}").alias("max_value"),
                F.col(f"min_{c}").alias("min_value"), F.col(f"n_{c}").alias("n_values"),
            )
            for category, i, c in _listed()
        ]
    )
    v, top, low = F.col("value_num"), F.col("max_value"), F.col("min_value")
    ranked = F.col("n_values") > 1
    at_top = F.coalesce((v == top) & ranked, F.lit(False))
    at_low = F.coalesce((v == low) & ranked, F.lit(False))
    if direction_aware:
        flip = F.col("lower_better")
        at_top, at_low = (
            F.when(flip, at_low).otherwise(at_top), F.when(flip, at_top).otherwise(at_low),
        )
    return (
        grid.join(extremes, "set_id")
        .select("set_id", *CELL, "name", F.inline(cells))
        .where(F.col("n_values") > 0)
        .select(
            "set_id", *CELL, short_name("name").alias("bank"), quarter_label("quarter_date").alias("quarter"),
            "category", "code_ord", "code", "label", "value_num",
            F.coalesce(auto_text("value_num"), F.lit("-")).alias("display"),
            "max_value", "min_value", at_top.alias("is_best"), (at_low & (top != low)).alias("is_worst"),
            ui_status_of_code(F.col("code"), v).alias("status"),
        )
    )
