"""Arrival-driven ingestion: archives dropped in a landing folder become stored quarters.

A file stream finds what is new (its checkpoint replaces comparing inventories). Each archive is parsed
once, into a staging table beside the store; a touched quarter is then rebuilt from all its staged rows
and overwrites its own partition, so a re-published archive or a replayed batch gives the same table.
What the store holds of institutions that are not staged (any more) is staged first, as their oldest archive, so
a rebuild never loses stored rows, and stops half-way without losing any.
"""

from __future__ import annotations

import warnings
from collections.abc import Collection
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from finfacts.functions.periods import is_quarter_key, last_published_key
from finfacts.reference_data import PUBLICATION_LAG_QUARTERS
from finfacts.sources import store, xbrl

OUTCOMES = (
    "run_ts timestamp, quarter_date string, path string, n_institutions bigint, n_skipped bigint,"
    " n_facts bigint, outcome string"
)


def _log(rows: DataFrame, log_path: str) -> None:
    names = [part.strip().split(" ", 1)[0] for part in OUTCOMES.split(", ")]
    rows.withColumn("run_ts", F.lit(datetime.now(timezone.utc))).select(
        *[F.col(n) for n in names]
    ).write.mode("append").parquet(log_path)


def _note(spark: SparkSession, rows: list[tuple[str, str]], outcome: str, log_path: str) -> None:
    """Log ``(quarter_date, path)`` entries that brought no rows."""
    if rows:
        _log(spark.createDataFrame(
            [(q, path, 0, 0, 0, outcome) for q, path in rows],
            "quarter_date string, path string, n_institutions bigint, n_skipped bigint, n_facts bigint, outcome string",
        ), log_path)


#: The archive name of rows that come from the store itself; older than any archive.
STORED = "stored"


def _stage_stored(spark: SparkSession, store_path: str, staging: str, quarters: Collection[str]) -> None:
    """Stage the stored rows of institutions that staging does not hold in these quarters."""
    if not quarters or not store.path_exists(spark, store_path):
        return
    keys = ["rssd_id", "quarter_date"]
    stored = store.read_facts(spark, store_path).where(F.col("quarter_date").isin(sorted(quarters)))
    if store.path_exists(spark, staging):
        staged = spark.read.schema(xbrl.FACT_ROWS).parquet(staging).where(
            F.col("quarter_date").isin(sorted(quarters)) & (F.col("status") == "ok") & F.col("code").isNotNull())
        stored = stored.join(staged.select(*keys).distinct(), keys, "left_anti")
    none = F.lit(None).cast("timestamp")
    rows = stored.select(
        F.lit(STORED).alias("path"), none.alias("modified"), "quarter_date", F.lit("").alias("member"), "rssd_id", "code",
        "value_raw", F.lit(0).cast("long").alias("ord"), F.lit("ok").alias("status"))
    rows.write.mode("append").partitionBy("quarter_date").parquet(staging)


def prune_staging(spark: SparkSession, store_path: str, log_path: str) -> list[str]:
    """Delete the staged rows of quarters whose newest log entry says they are stored; return those quarters.

    Stored rows are kept by later rebuilds all the same. With its staged rows an archive's age is forgotten: one that
    is delivered again later counts as new.
    """
    staging = f"{store_path.rstrip('/')}__staged"
    if not store.path_exists(spark, staging) or not store.path_exists(spark, log_path):
        return []
    last = spark.read.schema(OUTCOMES).parquet(log_path).where("quarter_date <> ''").groupBy("quarter_date").agg(
        F.max_by("outcome", "run_ts").alias("outcome"))
    done = sorted(r[0] for r in last.where("outcome = 'succeeded'").select("quarter_date").collect())
    stored = {r[0] for r in store.inventory(spark, store_path).select("quarter_date").collect()}
    return [q for q in done if q in stored and store.delete_path(spark, f"{staging}/quarter_date={q}")]


def _build(spark: SparkSession, parsed: DataFrame, store_path: str, log_path: str, quarters: Collection[str]) -> int:
    """Overwrite each of ``quarters`` from its parsed rows; return the number of facts written. If the write fails,
    quarters are tried one by one: a quarter that cannot be built is logged as failed, stays as it was, and stops
    no other."""

    def build(names: list[str]) -> int:
        rows = parsed.where(F.col("quarter_date").isin(names))
        n_facts = store.write_quarters(xbrl.facts_of(rows), store_path)
        _log(xbrl.archive_outcomes(rows.where(F.col("path") != STORED)), log_path)
        return n_facts

    names = sorted(quarters)
    n_facts = 0
    if not names:
        return n_facts
    try:
        n_facts = build(names)
    except Exception as error:
        warnings.warn(f"quarters are built one by one: {error}", stacklevel=2)
        for name in names:
            try:
                n_facts += build([name])
            except Exception as reason:
                warnings.warn(f"quarter {name} is not built: {reason}", stacklevel=2)
                _note(spark, [(name, "")], "failed", log_path)
    return n_facts


def load_quarters(
    spark: SparkSession, landing: str, store_path: str, log_path: str, quarters: list[str],
    spread: int | None = None,
) -> None:
    """Rebuild the given quarters, and no others, from every archive of theirs in the landing folder.

    The file-name pattern only narrows the listing: a name may hold several dates, and the quarter that is
    parsed from it decides. An archive that yields nothing is logged as failed and leaves the stored quarter
    untouched.
    """
    if not quarters:
        return
    pattern = "{" + ",".join(f"*{q}*.zip" for q in quarters) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(landing)
    asked = xbrl.with_quarter(files).where(F.col("quarter_date").isin(quarters))
    staging = f"{store_path.rstrip('/')}__reload_{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
    xbrl.parse_archives(asked, spread).write.parquet(staging)
    try:
        _build(spark, spark.read.parquet(staging), store_path, log_path, quarters)
    finally:
        store.delete_path(spark, staging)


def deferred_quarters(spark: SparkSession, log_path: str) -> list[str]:
    """Quarters whose newest log entry says they arrived before they could be stored."""
    if not store.path_exists(spark, log_path):
        return []
    last = spark.read.schema(OUTCOMES).parquet(log_path).where("quarter_date <> ''").groupBy("quarter_date").agg(
        F.max_by("outcome", "run_ts").alias("outcome")
    )
    return [r[0] for r in last.where("outcome = 'deferred'").select("quarter_date").collect()]


def ingest_new(
    spark: SparkSession, landing: str, store_path: str, log_path: str, checkpoint: str, as_of: str,
    lag_quarters: int = PUBLICATION_LAG_QUARTERS, spread: int | None = None,
    max_files_per_trigger: int = 64, admitted: Collection[str] | None = None,
) -> dict:
    """Process every archive that arrived since the last call, then stop; a no-op when none did.

    A quarter younger than the publication lag, or outside ``admitted`` when that is given, is logged as
    deferred; its staged rows are stored by the first later call that may. Archives without a quarter in
    their name are logged as failed.

    Returns what this call's own writes observed: ``n_members`` staged, ``n_facts`` stored, and ``rejects``, the
    number of archives and members of each kind that gave nothing. A batch that is replayed counts once.
    """
    newest_eligible = last_published_key(as_of, lag_quarters)
    staging = f"{store_path.rstrip('/')}__staged"

    def may_store(q: str) -> bool:
        return q <= newest_eligible and (admitted is None or q in admitted)

    waiting = [q for q in deferred_quarters(spark, log_path) if may_store(q)]
    touched: set[str] = set()
    late: set[str] = set()
    counts: dict[int, dict[str, int]] = {}

    def on_arrival(batch: DataFrame, batch_id: int) -> None:
        # Names only: the content column is not read here.
        named = batch.select("path", xbrl.quarter_of("path").alias("q"))
        usable = F.coalesce(is_quarter_key("q"), F.lit(False))
        lost = [(r.q or "", r.path) for r in named.where(~usable).collect()]
        _note(spark, lost, "failed", log_path)
        counts[batch_id] = {"no_quarter": len(lost)}
        keys = sorted(r[0] for r in named.where(usable).select("q").distinct().collect())
        if not keys:
            return
        archives = xbrl.with_quarter(batch).where(F.col("quarter_date").isin(keys))
        counts[batch_id] |= store.observed(
            xbrl.parse_archives(archives, spread), xbrl.parse_metrics(),
            lambda rows: rows.write.mode("append").partitionBy("quarter_date").parquet(staging))
        touched.update(q for q in keys if may_store(q))
        late.update(q for q in keys if not may_store(q))

    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", max_files_per_trigger)
        .load(landing)
    )
    query = (
        stream.writeStream.foreachBatch(on_arrival)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # Built once, after all batches: a backfill parses every archive once and writes every quarter once.
    # A call that dies in between leaves its quarters staged and unlogged; they count as waiting then.
    staged_only = _staged_unlogged(spark, staging, log_path)
    todo = touched | set(waiting) | {q for q in staged_only if may_store(q)}
    _note(spark, [(q, "") for q in sorted(late)], "deferred", log_path)
    n_facts = 0
    if todo:
        _stage_stored(spark, store_path, staging, todo)
        n_facts = _build(spark, spark.read.schema(xbrl.FACT_ROWS).parquet(staging), store_path, log_path, todo)
    total = lambda name: sum(seen.get(name, 0) for seen in counts.values())
    rejects = {kind: total(kind) for kind in ("no_quarter", *xbrl.REJECTS)}
    return {"n_members": total("n_members"), "n_facts": n_facts, "rejects": {k: n for k, n in rejects.items() if n}}


def _staged_unlogged(spark: SparkSession, staging: str, log_path: str) -> list[str]:
    """Staged quarters (partition names only) that no log row mentions."""
    if not store.path_exists(spark, staging):
        return []
    staged = spark.read.schema(xbrl.FACT_ROWS).parquet(staging).select("quarter_date").distinct()
    if store.path_exists(spark, log_path):
        logged = spark.read.schema(OUTCOMES).parquet(log_path).select("quarter_date").distinct()
        staged = staged.join(logged, "quarter_date", "left_anti")
    return [r[0] for r in staged.collect()]
