"""The assistant's tools as table functions that SQL can call.

``register`` gives a session temporary views of the whole results and SQL functions over them. The optimizer puts a
function's body in place of its call, so its arguments become filters that reach the scan. A NULL argument means all.

    SELECT * FROM get_ubpr_ratios('480228', '20251231')
    SELECT b.name, t.* FROM banks b, LATERAL get_ubpr_trend('UBPRE013,UBPRE018', '20230331', '20251231', b.rssd_id) t
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from finfacts.functions.numeric import fixed_text
from finfacts.operators import facts as fx, peers
from finfacts.plans import tools
from finfacts.reference_data import PEER_BUCKETS, PEER_CODES

_BANK = "(for_bank IS NULL OR rssd_id = for_bank)"
_QUARTER = "(for_quarter IS NULL OR quarter_date = for_quarter)"
_PERIOD = "(for_period IS NULL OR reporting_period = for_period)"


def _list(argument: str) -> str:
    return f"transform(split({argument}, ','), x -> trim(x))"


def _define(spark: SparkSession, name: str, arguments: str, rows: DataFrame, where: str) -> str:
    """A view of ``rows`` and the function ``name`` over it; its columns are those of the rows."""
    view = f"{name}_rows"
    rows.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = ", ".join(f"`{c}`" for c in rows.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns})"
        f" RETURN SELECT {names} FROM {view} WHERE {where}")
    return name


def _all_peer_comparisons(facts: DataFrame, buckets: Sequence[peers.Bucket]) -> DataFrame:
    rows = peers.top_peer_rows(peers.leave_one_out(facts, PEER_CODES, buckets))
    diff = F.col("bank_value") - F.col("peer_average")
    return rows.select(
        *fx.CELL, "peer_group", F.col("place").cast("bigint").alias("pos"), "code",
        fixed_text("bank_value", 2).alias("bank"), fixed_text("peer_average", 2).alias("peer_avg"),
        F.concat(F.when(diff >= 0, "+").otherwise(""), fixed_text(diff, 2)).alias("diff"))


def register(
    spark: SparkSession, facts: DataFrame | None = None, items: DataFrame | None = None, periods: DataFrame | None = None,
    buckets: Sequence[peers.Bucket] = PEER_BUCKETS,
) -> list[str]:
    """Define the functions whose frames are given; their names are returned. ``items`` carry their ``section``."""
    names = []

    def define(*parts) -> None:
        names.append(_define(spark, *parts))

    cell = "for_bank STRING DEFAULT NULL, for_quarter STRING DEFAULT NULL"
    filing = "for_bank STRING DEFAULT NULL, for_period STRING DEFAULT NULL"
    if facts is not None:
        define("get_ubpr_ratios", cell, tools.get_ubpr_ratios(facts), f"{_BANK} AND {_QUARTER}")
        define("get_peer_comparison", f"for_group STRING DEFAULT 'all', {cell}", _all_peer_comparisons(facts, buckets),
               f"peer_group IN (for_group, 'size:' || for_group) AND {_BANK} AND {_QUARTER}")
        define("get_ubpr_trend", "for_codes STRING, from_quarter STRING, to_quarter STRING, for_bank STRING DEFAULT NULL",
               facts.where(F.col("value_raw").isNotNull()).select("rssd_id", "code", "quarter_date", "value_raw"),
               f"quarter_date BETWEEN least(from_quarter, to_quarter) AND greatest(from_quarter, to_quarter) AND "
               f"array_contains({_list('for_codes')}, code) AND {_BANK}")
        define("flag_regulatory_issues", cell, tools.flag_regulatory_issues(facts), f"{_BANK} AND {_QUARTER}")
    if periods is not None:
        periods.createOrReplaceTempView("get_available_periods_rows")
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION get_available_periods(newest INT DEFAULT 12)"
            " RETURNS TABLE (periods STRING, n_periods BIGINT) RETURN"
            " SELECT array_join(transform(slice(listed, 1, newest), x -> x.period), ', '), CAST(size(listed) AS BIGINT) FROM"
            " (SELECT sort_array(collect_list(struct(quarter_date, period)), false) AS listed FROM get_available_periods_rows)")
        names.append("get_available_periods")
    if items is not None:
        define("get_bank_metrics", filing, tools.get_bank_metrics(items), f"{_BANK} AND {_PERIOD}")
        define("get_schedule_data", f"for_schedules STRING DEFAULT 'RC,RI', {filing}", tools.it.top_rows(items),
               f"array_contains({_list('for_schedules')}, section) AND {_BANK} AND {_PERIOD}")
        define("get_available_schedules", filing, tools.get_available_schedules(items), f"{_BANK} AND {_PERIOD}")
    return names
