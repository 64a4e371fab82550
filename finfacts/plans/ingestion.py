"""One ingestion run: what is missing, what fits the budget, the load, and the run log."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from finfacts.operators import lifecycle
from finfacts.reference_data import BUDGET_GB, FIRST_YEAR, PUBLICATION_LAG_QUARTERS
from finfacts.sources import store
from finfacts.streaming import incremental


def stored_inventory(spark: SparkSession, store_path: str) -> DataFrame:
    if not store.path_exists(spark, store_path):
        return spark.createDataFrame([], "quarter_date string, bytes bigint, n_files bigint")
    return store.inventory(spark, store_path)


def run(
    spark: SparkSession, landing: str, store_path: str, log_path: str, runs_path: str, checkpoint: str, as_of: str,
    budget_gb: float = BUDGET_GB, start_year: int = FIRST_YEAR, recent: int | None = None,
    lag_quarters: int = PUBLICATION_LAG_QUARTERS, dry_run: bool = False, max_files_per_trigger: int = 64,
) -> DataFrame:
    """Ingest what was published and is missing, newest first while the budget lasts; return the plan.

    Quarters outside the budget wait for a later run. Quarters that are stored already may be restated at any
    time. A quarter that fails is logged and stops no other. The run ends with a row in the run log; a dry run
    changes nothing. The frames handled here have one row for each calendar quarter.
    """
    began = time.time()
    stored = stored_inventory(spark, store_path)
    missing = lifecycle.to_ingest(lifecycle.published_quarters(spark, as_of, start_year, lag_quarters), stored, recent)
    plan = lifecycle.admit(lifecycle.with_planned_bytes(missing), budget_gb)
    decisions = {r.quarter_date: r.decision for r in plan.select("quarter_date", "decision").collect()}
    if dry_run:
        return plan
    admitted = {q for q, d in decisions.items() if d == "admitted"}
    known = {r[0] for r in stored.select("quarter_date").collect()}
    started = datetime.now(timezone.utc)
    seen = incremental.ingest_new(
        spark, landing, store_path, log_path, checkpoint, as_of, lag_quarters,
        max_files_per_trigger=max_files_per_trigger, admitted=admitted | known,
    )
    after = stored_inventory(spark, store_path)
    outcomes = _outcomes(spark, log_path, started).join(after.select("quarter_date", "bytes"), "quarter_date", "left")
    summary = lifecycle.outcome_summary(outcomes).first()
    totals = lifecycle.inventory_totals(after).first()
    split = lambda text: [q for q in (text or "").split(",") if q]
    store.append_run(spark, runs_path, {
        "run_ts": started, "mode": "incremental" if recent else "full", "succeeded": split(summary.succeeded),
        "failed": split(summary.failed), "deferred": split(summary.deferred), "bytes_written": summary.bytes_written,
        "duration_seconds": int(time.time() - began), "total_quarters": totals.n_quarters, "total_gb": totals.total_gb,
        "result": summary.result, **seen,
    })
    return plan


def _outcomes(spark: SparkSession, log_path: str, since: datetime) -> DataFrame:
    """The newest outcome that this run logged for each quarter; one good archive makes it succeed."""
    if not store.path_exists(spark, log_path):
        return spark.createDataFrame([], "quarter_date string, outcome string")
    rows = spark.read.schema(incremental.OUTCOMES).parquet(log_path).where(
        (F.col("run_ts") >= F.lit(since)) & (F.col("quarter_date") != ""))
    rank = F.when(F.col("outcome") == "succeeded", 2).when(F.col("outcome") == "failed", 1).otherwise(0)
    return rows.groupBy("quarter_date").agg(F.max_by("outcome", rank).alias("outcome"))
