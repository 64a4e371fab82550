"""The stored facts table: long Parquet under ``year=YYYY/quarter=YYYYMMDD``, and the run log."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from finfacts.functions.numeric import strict_number

LAYOUT = "rssd_id string, code string, value_raw string, year string, quarter string"
RUN_LOG = (
    "run_ts timestamp, mode string, succeeded array<string>, failed array<string>,"
    " deferred array<string>, bytes_written bigint, duration_seconds bigint, total_quarters bigint,"
    " total_gb double, result string, n_members bigint, n_facts bigint, rejects map<string,bigint>"
)
ROWS_PER_FILE = 20_000_000


def observed(frame: DataFrame, metrics: Sequence[Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Run ``write`` on ``frame`` and return the counts ``metrics`` that the same job observed: no second scan. They
    belong to the last stage before the write, whose tasks count once however often they are tried."""
    seen = Observation()
    write(frame.observe(seen, *metrics))
    return {name: value or 0 for name, value in seen.get.items()}


def write_quarters(facts: DataFrame, path: str) -> int:
    """Overwrite exactly the quarters present in ``facts``; return the number of facts written.

    The rows are rebalanced by quarter: adaptive execution splits a quarter by its bytes and joins small
    ones, so a heavy quarter becomes many tasks at any size. Rows are sorted so that the column statistics
    of each file narrow a look-up by institution.
    """
    rows = facts.select(
        "rssd_id", "code", "value_raw",
        F.substring("quarter_date", 1, 4).alias("year"), F.col("quarter_date").alias("quarter"),
    )
    ordered = rows.hint("rebalance", "year", "quarter").sortWithinPartitions("quarter", "rssd_id", "code")

    def write(frame: DataFrame) -> None:
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .option("parquet.bloom.filter.enabled#rssd_id", "true")
            .partitionBy("year", "quarter")
            .parquet(path)
        )

    return observed(ordered, [F.count(F.lit(1)).alias("n_facts")], write).get("n_facts", 0)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The stored facts. The declared schema keeps partition keys as text (no inference)."""
    return (
        spark.read.schema(LAYOUT).parquet(path)
        .select("rssd_id", F.col("quarter").alias("quarter_date"), "code", "value_raw")
        .withColumn("value_num", strict_number("value_raw"))
    )


def read_wide(spark: SparkSession, path: str, codes: Sequence[str] | None = None) -> DataFrame:
    """Wide quarter tables (``rssd_id, quarter_date``, one text column for each code; columns differ between
    quarters) as long facts. The column names come from the files' schemas; no data is read for them.
    ``codes`` narrows the columns that are scanned."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    names = [c for c in rows.columns if c not in ("rssd_id", "quarter_date", "year", "quarter")]
    if codes is not None:
        names = [c for c in names if c in set(codes)]
    quarter = F.col("quarter_date" if "quarter_date" in rows.columns else "quarter").cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").cast("string").alias("value_raw")) for c in names])
    if not names:
        cells = F.array().cast("array<struct<code:string,value_raw:string>>")
    return (
        rows.select(F.col("rssd_id").cast("string").alias("rssd_id"), quarter.alias("quarter_date"), F.inline(cells))
        .where(F.col("value_raw").isNotNull())
        .withColumn("value_num", strict_number("value_raw"))
    )


def scan_quarter(spark: SparkSession, path: str, quarter_date: str) -> DataFrame:
    """One quarter: both partition keys are fixed, so only its directory is listed and read."""
    return (
        spark.read.schema(LAYOUT).parquet(path)
        .where((F.col("year") == quarter_date[:4]) & (F.col("quarter") == quarter_date))
        .select("rssd_id", F.col("quarter").alias("quarter_date"), "code", "value_raw")
        .withColumn("value_num", strict_number("value_raw"))
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Stored quarters and bytes, from file listings only. Any file under a
    ``quarter=<8 digits>`` directory counts, whatever its name."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(path)
        .select("path", "length")
    )
    quarter = F.regexp_extract("path", "/quarter=([0-9]{8})/", 1)
    return (
        files.select(quarter.alias("quarter_date"), "length")
        .where(F.col("quarter_date") != "")
        .groupBy("quarter_date")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n_files"))
    )


def estimated_bytes(facts: DataFrame) -> DataFrame:
    """Planning size per quarter: institutions x (codes + 2 id columns) x 8 bytes."""
    codes = facts.groupBy("quarter_date", "code").agg(F.count(F.lit(1)).alias("n"))
    banks = facts.groupBy("quarter_date", "rssd_id").agg(F.count(F.lit(1)).alias("n"))
    n_codes = codes.groupBy("quarter_date").agg(F.count(F.lit(1)).alias("n_codes"))
    n_banks = banks.groupBy("quarter_date").agg(F.count(F.lit(1)).alias("n_banks"))
    return n_codes.join(n_banks, "quarter_date").select(
        "quarter_date", "n_banks", "n_codes",
        (F.col("n_banks") * (F.col("n_codes") + 2) * 8).alias("bytes"),
    )


def field_counts(facts: DataFrame) -> DataFrame:
    """Fields of each institution's quarter row: the quarter's code catalog plus two id columns,
    and how many of them the institution fills."""
    catalog = (
        facts.select("quarter_date", "code").distinct()
        .groupBy("quarter_date").agg((F.count(F.lit(1)) + 2).alias("total_fields"))
    )
    filled = facts.groupBy("rssd_id", "quarter_date").agg(F.count(F.lit(1)).alias("n_reported"))
    return filled.join(catalog, "quarter_date")


def append_run(spark: SparkSession, path: str, run: dict) -> bool:
    """Append one run to the log. A log that cannot be written is no reason to fail a run that is done:
    a warning is raised and False returned."""
    names = [part.strip().split(" ", 1)[0] for part in RUN_LOG.split(", ")]
    row = tuple(run.get(n) for n in names)
    try:
        spark.createDataFrame([row], RUN_LOG).write.mode("append").parquet(path)
    except Exception as error:
        warnings.warn(f"run log {path} not written: {error}", stacklevel=2)
        return False
    return True


def last_run(spark: SparkSession, path: str) -> DataFrame:
    """The newest log row; no rows when nothing ever ran."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_LOG)
    return spark.read.schema(RUN_LOG).parquet(path).orderBy(F.col("run_ts").desc()).limit(1)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a table that this library wrote for its own use."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_quarters(spark: SparkSession, path: str, plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Delete the partition directories of the planned quarters, newest first.

    ``(quarter_date, outcome)`` with ``planned`` / ``deleted`` / ``failed``. The plan has at most
    one row per calendar quarter, which is what is looped over here; no data rows move.
    """
    quarters = [r[0] for r in plan.select("quarter_date").orderBy(F.col("quarter_date").desc()).collect()]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    outcomes = []
    for q in quarters:
        if dry_run:
            outcomes.append((q, "planned"))
            continue
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/year={q[:4]}/quarter={q}")
        try:
            done = target.getFileSystem(conf).delete(target, True)
        except Exception:  # one quarter that cannot be deleted must not stop the others
            done = False
        outcomes.append((q, "deleted" if done else "failed"))
    return spark.createDataFrame(outcomes, "quarter_date string, outcome string")
