"""Snapshot files of the institution panel and of the reporting periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PANEL = "ID_RSSD bigint, Name string, City string, State string"


def _parsed(text: Column, element: str) -> Column:
    """The records of a JSON value or list of them (a comma may follow); null unless all of the text parses."""
    body = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r",\s*$", "")
    # In brackets of its own, text behind the first value is read too instead of being left out.
    inner = F.concat(F.lit("["), body, F.lit("]"))
    return F.when(body.startswith("["), F.flatten(F.from_json(inner, f"array<array<{element}>>"))).otherwise(
        F.from_json(inner, f"array<{element}>"))


def _records(spark: SparkSession, path: str, element: str) -> DataFrame:
    """``path, block, id, records, corrupt``: one row for each non-blank line, in file order by ``block, id``. A file
    holds JSON values one a line (records or lists of them) or one list over any number of lines. Only a file whose
    first line opens a list and does not close it is read as a whole; if that fails, its lines are read one by one.
    ``corrupt`` has the lines that do not parse; the others stay."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.btrim("value", F.lit(" \t\r")).alias("line"),
    ).where("line <> ''")
    rows = lines.withColumn("records", _parsed(F.col("line"), element))
    first = rows.groupBy("path").agg(F.min_by(F.struct("line", "records"), F.struct("block", "id")).alias("first"))
    opened = first.where(F.col("first.line").startswith("[") & F.col("first.records").isNull())
    paths = [r.path for r in opened.select("path").collect()]
    if paths:
        texts = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(paths))
        whole = texts.select(
            F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("id"),
            F.col("value").alias("line"), _parsed(F.col("value"), element).alias("records")).where("records is not null")
        rows = rows.join(whole.select("path"), "path", "left_anti").unionByName(whole)
    return rows.select("path", "block", "id", "records", F.when(F.col("records").isNull(), F.col("line")).alias("corrupt"))


def read_institutions(spark: SparkSession, path: str) -> DataFrame:
    """Panel JSON (one record per line, or a list) to trimmed institutions."""
    rows = _records(spark, path, f"struct<{PANEL.replace(' ', ':').replace(',:', ',')}>").select(F.inline("records"))
    return rows.where(F.col("ID_RSSD").isNotNull()).select(
        F.col("ID_RSSD").cast("string").alias("rssd_id"),
        F.trim("Name").alias("name"), F.trim("City").alias("city"), F.trim("State").alias("state"),
    )


def unreadable(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """path, n_lines: the files with lines that do not parse, and how many; their other lines are read."""
    return _records(spark, path, element).where("corrupt is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """Period lists (``["12/31/2025", ...]``) to one row per valid period, listed order kept."""
    # A file's positions run on over its lines; period lists are bounded by the calendar.
    before = Window.partitionBy("path").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
    lists = _records(spark, path, "string").where("records is not null")
    lists = lists.withColumn("start", F.coalesce(F.sum(F.size("records")).over(before), F.lit(0)))
    return lists.select("start", F.posexplode("records").alias("pos", "period")).select(
        "period",
        (F.col("start") + F.col("pos")).cast("bigint").alias("pos"),
        F.date_format(F.try_to_timestamp("period", F.lit("MM/dd/yyyy")), "yyyyMMdd").alias("quarter_date"),
    ).where(F.col("quarter_date").isNotNull())
