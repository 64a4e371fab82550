"""Custom reports as wide CSV, with columns that the data gives: a bank, a period, or both, for each column.

A dictionary numbers the distinct columns. The cells of a report row are gathered by column number, in shards of
columns, and written as lines: gaps between two cells are filled with the missing mark, so a line costs its cells and
not the square of its columns. The plan does not grow with the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finfacts.functions.periods import period_to_key
from finfacts.operators import items as it
from finfacts.operators.numbering import numbered

SHARD_COLUMNS = 1000
KEYS = ("section", "item_code", "description")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def column_dictionary(cells: DataFrame) -> DataFrame:
    """``(col_key, header, col)``: the distinct columns of report cells, numbered by bank label, then time."""
    listed = cells.select("col_key", "header", "bank_order", "period_order").distinct()
    return numbered(listed, ["bank_order", "period_order", "col_key"], "col").select("col_key", "header", "col")


def _line(cells: Column, width: Column, missing: str) -> Column:
    """``,"a","-","b"``: the values of ``(pos, value)`` entries sorted by pos, and the mark in all other places."""
    gap = F.lit(f',"{missing}"')
    before = lambda i: F.when(i > 0, F.get(cells, i - 1)["pos"]).otherwise(F.lit(-1))
    parts = F.transform(cells, lambda e, i: F.concat(
        F.repeat(gap, (e["pos"] - before(i) - 1).cast("int")), F.lit(","), _quoted(e["value"])))
    last = F.coalesce(F.get(cells, F.size(cells) - 1)["pos"], F.lit(-1))
    return F.concat(F.array_join(parts, ""), F.repeat(gap, (width - 1 - last).cast("int")))


def report_lines(
    items: DataFrame, institutions: DataFrame, many_banks: bool = True, many_periods: bool = True,
    shard_columns: int = SHARD_COLUMNS, missing: str = "-",
) -> DataFrame:
    """``(shard, place, line)``: CSV lines of the report, every cell quoted; place 0 is a shard's header.

    Each shard holds ``shard_columns`` columns beside section, item code and description, and has every report row. The
    description of a row is its least text. Items without a section are left out; a bank with several filings in a
    column (one column a bank, many periods) shows the last filing's value.
    """
    # A column names the bank, the period, or both when both vary or neither does.
    by_bank, by_period = many_banks or not many_periods, many_periods or not many_banks
    cells = it.report_cells(items, institutions, many_banks, many_periods).withColumn(
        "bank_order", F.substring_index("col_key", "\n", 1) if by_bank else F.lit("")).withColumn(
        "period_order", period_to_key("reporting_period") if by_period else F.lit(""))
    columns = column_dictionary(cells)
    n = columns.count()
    shards = -(-n // shard_columns)
    width = F.least(F.lit(shard_columns), F.lit(n) - F.col("shard") * shard_columns)
    rows = cells.groupBy("section", "item_code").agg(F.coalesce(F.min("description"), F.lit("")).alias("description"))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1)))) if shards else rows.where("false").withColumn("shard", F.lit(0))
    newest = F.max_by(F.coalesce("value", F.lit(missing)), F.struct(period_to_key("reporting_period"), "rssd_id"))
    placed = cells.join(columns.select("col_key", "col"), "col_key").groupBy("section", "item_code", "col").agg(newest.alias("value"))
    gathered = placed.groupBy("section", "item_code", F.floor(F.col("col") / shard_columns).cast("int").alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("col") % shard_columns).alias("pos"), "value"))).alias("cells"))
    full = rows.join(gathered, ["section", "item_code", "shard"], "left")
    none = F.array().cast("array<struct<pos:bigint,value:string>>")
    keys = F.concat_ws(",", *[_quoted(F.col(k)) for k in KEYS])
    body = full.withColumn("cells", F.coalesce("cells", none)).select(
        "shard", F.lit(1).alias("place"), F.concat(keys, _line(F.col("cells"), width, missing)).alias("line"))
    # A header is as long as a line.
    names = columns.groupBy(F.floor(F.col("col") / shard_columns).cast("int").alias("shard")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("col", "header"))), lambda c: _quoted(c["header"])).alias("names"))
    first = F.lit(",".join(f'"{k}"' for k in KEYS))
    head = names.select("shard", F.lit(0).alias("place"), F.concat_ws(",", first, F.array_join("names", ",")).alias("line"))
    return head.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """One CSV file with a header for each shard of columns, ``path/shard=k``; its rows are sorted."""
    one = lines.repartition("shard").sortWithinPartitions("shard", "place", "line")
    one.select("shard", "line").write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").text(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard as a table of text columns."""
    return (spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("emptyValue", "")
            .csv(f"{path}/shard={shard}"))
