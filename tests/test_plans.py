"""The physical plans that matter at scale."""

import pytest

from finfacts.checks.catalog import QUERIES
from finfacts.operators import peers, trends
from finfacts.plans import reports
from finfacts.session import scratch_path
from finfacts.sources import store
from finfacts.sources.panel import PANEL_BUCKETS, facts, line_items, table


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = scratch_path(spark, "plans")
    store.write_quarters(facts(spark, sf_dir), path)
    return path


def test_quarter_scan_prunes_partitions_and_columns(spark, stored):
    text = plan(store.scan_quarter(spark, stored, "19981231").where("code = 'UBPRE013'").select("rssd_id", "value_raw"))
    assert "PartitionFilters: [" in text and "quarter" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(code,UBPRE013)" in text


def test_trend_range_reaches_the_scan(spark, stored):
    text = plan(reports.trend(store.read_facts(spark, stored), ["UBPRE013"], "19970331", "19981231"))
    head = text.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 19970331" in head and "<= 19981231" in head
    assert text.count("Exchange hashpartitioning") == 1


def test_peers_use_no_pairwise_join(spark, stored):
    text = plan(peers.leave_one_out(store.read_facts(spark, stored), buckets=PANEL_BUCKETS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["rep10_regulatory", "jn07_reg_ui"])
def test_code_filter_of_thresholds_reaches_a_stored_scan(spark, stored, name):
    from finfacts.operators import regulatory

    rules = "agent" if name == "rep10_regulatory" else "ui"
    text = plan(regulatory.regulatory_status(store.read_facts(spark, stored), rules))
    assert "In(code, [" in text.split("PushedFilters: [")[1].split("\n")[0]


def test_peers_scan_once(spark, stored):
    frame = peers.leave_one_out(store.read_facts(spark, stored), buckets=PANEL_BUCKETS)
    frame.collect()
    # The totals and the institutions' own rows come from one shuffled aggregate.
    assert frame._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1


def test_summary_scans_twice_at_most(spark, stored):
    frame = reports.executive_summary(store.read_facts(spark, stored), PANEL_BUCKETS)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    # The second scan reads the peers' codes only, for the totals.
    assert final.count("FileScan parquet") <= 2
    assert all("In(code, [" in part.split("\n")[0] for part in final.split("PushedFilters: [")[1:])


def test_top_rows_limit_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["srt05_top10_schedule"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(trends.sparkline(facts(spark, sf_dir)))


def test_panel_reads_only_needed_columns(spark, sf_dir):
    schema = plan(line_items(spark, sf_dir).select("rssd_id", "line_number")).split("ReadSchema: struct<")[1].split(">")[0]
    assert schema == "l_suppkey:bigint,l_linenumber:int,l_returnflag:string,l_shipdate:timestamp_ntz"
    assert len(table(spark, sf_dir, "lineitem").columns) == 11


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_anywhere(spark, sf_dir, name):
    if name.startswith(("snk", "str", "src01_stored", "src07", "src08", "src09", "tf05", "rep08_bank")):
        pytest.skip("writes files; covered by the oracle test")
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
