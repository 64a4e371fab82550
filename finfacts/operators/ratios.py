"""User-defined numerator / denominator ratios."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from finfacts.functions.numeric import custom_ratio_text, prefix_number
from finfacts.functions.text import SAFE_CODE
from finfacts.operators.facts import CELL, safe_codes

#: Definitions carried together as one array; more of them become more arrays, joined by their number.
BLOCK = 1000


class RatioDef(NamedTuple):
    label: str
    numerator: str
    denominator: str | None = None
    scale: str = "percent"


def custom_ratios(facts: DataFrame, definitions: Sequence[RatioDef]) -> DataFrame:
    """Every definition for every institution and quarter that reports anything.

    ``(rssd_id, quarter_date, label, numerator, denominator, raw, display, error)``. A missing
    numerator and a missing or zero denominator are error rows, not dropped rows. All codes are
    gathered in one aggregate instead of one self join per definition.
    """
    definitions = [
        d._replace(numerator=d.numerator.strip(), denominator=(d.denominator or "").strip() or None) for d in definitions
    ]
    codes = safe_codes([c for d in definitions for c in (d.numerator, d.denominator) if c])
    number = prefix_number("value_raw")
    # One aggregate over all cells: a cell without any asked code keeps its error rows.
    found = [F.max(F.when(F.col("code") == c, number)).alias(c) for c in codes]
    rows = facts.groupBy(*CELL).agg(*found) if codes else facts.select(*CELL).distinct()
    out = []
    for d in definitions:
        num = F.col(d.numerator) if d.numerator in codes else F.lit(None).cast("double")
        den = None if not d.denominator else (
            F.col(d.denominator) if d.denominator in codes else F.lit(None).cast("double")
        )
        error = F.when(num.isNull(), F.lit("numerator not found"))
        raw = num
        if den is not None:
            error = error.when(den.isNull() | (den == 0), F.lit("denominator is zero or not found"))
            raw = num / F.nullif(den, F.lit(0.0))
        percent_already = (
            (F.abs(raw) <= 200) & F.lit(d.numerator.startswith("UBPR")) if den is None else F.lit(False)
        )
        out.append(
            F.struct(
                F.lit(d.label).alias("label"), F.lit(d.numerator).alias("numerator"),
                F.lit(d.denominator or "").alias("denominator"), raw.alias("raw"),
                custom_ratio_text(raw, F.lit(d.scale), percent_already).alias("display"),
                error.alias("error"),
            )
        )
    return rows.select(*CELL, F.inline(F.array(*out))).withColumn(
        "display", F.when(F.col("error").isNull(), F.col("display"))
    )


def _code(column: str) -> Column:
    """A requested code without blanks around it, NULL if empty."""
    return F.nullif(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit(""))


def _cell_values(facts: DataFrame, codes: DataFrame) -> DataFrame:
    """One map code -> number for each cell that reports anything, of the wanted codes only. One scan, one shuffle:
    facts of other codes end in the map-side part of the aggregate."""
    wanted = codes.withColumn("__wanted", F.lit(True))
    entry = F.struct(F.col("code").alias("code"), prefix_number("value_raw").alias("v"))
    gathered = facts.join(wanted, "code", "left").groupBy(*CELL).agg(
        F.sort_array(F.collect_list(F.when(F.col("__wanted"), entry))).alias("e"))
    # Of a code that a cell repeats, the greatest number counts: the last of its sorted entries.
    last = F.filter("e", lambda x, i: (i == F.size("e") - 1) | (F.get("e", i + 1)["code"] != x["code"]))
    return gathered.select(*CELL, F.map_from_entries(last).alias("__values"))


def saved_ratios(facts: DataFrame, definitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`custom_ratios` for definitions that are rows ``(label, numerator, denominator, scale)`` of a table.

    The plan is the same for any number of definitions: one scan of the facts, one map for each cell, and the
    definitions laid out in place, in blocks, without comparing cells and definitions. Definitions are answered as
    often as they are listed; a null or blank denominator means the numerator alone.
    """
    listed = definitions.select(
        "label", _code("numerator").alias("numerator"), _code("denominator").alias("denominator"), "scale")
    # A few rows each: the cells look up a block by its number.
    count = listed.count()
    blocks = max(1, -(-count // block))
    spread = F.pmod(F.xxhash64("label", "numerator", "denominator", "scale"), F.lit(blocks)).cast("int")
    arrays = listed.groupBy(spread.alias("__block")).agg(F.collect_list(F.struct(*listed.columns)).alias("__defs"))
    codes = listed.select(F.explode(F.array("numerator", "denominator")).alias("code"))
    codes = codes.where(F.col("code").rlike(SAFE_CODE)).distinct()
    cells = _cell_values(facts, codes).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = cells.join(arrays, "__block").select(*CELL, "__values", F.inline("__defs"))
    rows = rows.withColumn("__n", F.try_element_at("__values", F.coalesce("numerator", F.lit(""))))
    rows = rows.withColumn("__d", F.try_element_at("__values", F.coalesce("denominator", F.lit(""))))
    alone = F.col("denominator").isNull()
    raw = F.when(alone, F.col("__n")).otherwise(F.col("__n") / F.nullif(F.col("__d"), F.lit(0.0)))
    error = F.when(F.col("__n").isNull(), "numerator not found").when(
        ~alone & F.coalesce(F.col("__d") == 0, F.lit(True)), "denominator is zero or not found")
    judged = rows.withColumn("raw", raw).withColumn("error", error)
    percent_already = alone & (F.abs("raw") <= 200) & F.startswith("numerator", F.lit("UBPR"))
    shown = custom_ratio_text(F.col("raw"), F.col("scale"), F.coalesce(percent_already, F.lit(False)))
    return judged.select(
        *CELL, "label", F.coalesce("numerator", F.lit("")).alias("numerator"),
        F.coalesce("denominator", F.lit("")).alias("denominator"), "raw",
        F.when(F.col("error").isNull(), shown).alias("display"), "error")
