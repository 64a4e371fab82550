"""Queries over ingestion, storage, exports, planning and question labels.

Queries that store data write below the session's shared scratch folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts import reference_data as ref
from finfacts.checks import roundtrip, sqltext as S
from finfacts.checks.registry import query
from finfacts.functions import periods as per, text as txt
from finfacts.operators import facts as fx, items as it, lifecycle as life, questions as qn
from finfacts.plans import exports, ingestion, tools
from finfacts.session import scratch_path
from finfacts.sources import snapshots, store, xbrl
from finfacts.sources.panel import PANEL_BUCKETS, facts, institutions, line_items, panel_cells, questions
from finfacts.streaming import incremental

AS_OF = "2001-11-15"
START_YEAR = 1993

# ---------------------------------------------------------------- archives

# Every document plants an earlier UBPR2170 that loses to a later one, unless that one is blank.
_PARSED = S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, CASE WHEN trim(value_raw) = '' THEN 'first duplicate' ELSE trim(value_raw) END AS value_raw
FROM facts WHERE (trim(value_raw) <> '' OR code = 'UBPR2170')"""


def _archives(spark, sf):
    return roundtrip.archives(roundtrip.xbrl_documents(facts(spark, sf)))


@query("src04_xbrl_roundtrip", _PARSED)
def _(spark, sf):
    return xbrl.facts_of(xbrl.parse_archives(_archives(spark, sf)))


@query("src03_archive_members", S.with_(S.FACTS) + """
SELECT DISTINCT quarter_date, 'FI ' || rssd_id || '(ID RSSD) ' || quarter_date || '.xml' AS member, rssd_id, 'ok' AS status FROM facts
UNION ALL SELECT DISTINCT quarter_date, 'summary.xml', NULL, 'no_entity_id' FROM facts""")
def _(spark, sf):
    # One archive per id range and quarter carries its own stray member; distinct lists it once.
    members = xbrl.list_members(_archives(spark, sf))
    return members.select("quarter_date", "member", "rssd_id", "status").distinct()


@query("prj08_current_context", S.with_(S.FACTS) + """
SELECT quarter_date, count(*) AS n_facts, count(*) FILTER (WHERE trim(value_raw) = '999') AS n_prior FROM facts
WHERE trim(value_raw) <> '' OR code = 'UBPR2170' GROUP BY 1""")
def _(spark, sf):
    """Prior-period facts (value 999) and foreign elements of every document are left out."""
    rows = xbrl.facts_of(xbrl.parse_archives(_archives(spark, sf)))
    return rows.groupBy("quarter_date").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count(F.when(F.col("value_raw") == "999", 1)).alias("n_prior")
    )


# ---------------------------------------------------------------- store

def _stored(spark, sf):
    path = scratch_path(spark, "facts")
    store.write_quarters(facts(spark, sf), path)
    return path


@query("snk01_roundtrip", S.with_(S.FACTS) + "SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts")
def _(spark, sf):
    return store.read_facts(spark, _stored(spark, sf))


@query("src01_stored_quarter", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw, value_num FROM facts WHERE quarter_date = '20000930'""")
def _(spark, sf):
    return store.scan_quarter(spark, _stored(spark, sf), "20000930")


@query("src07_inventory", S.with_(S.FACTS) + "SELECT DISTINCT quarter_date, true AS has_bytes FROM facts")
def _(spark, sf):
    inv = store.inventory(spark, _stored(spark, sf))
    return inv.select("quarter_date", (F.col("bytes") > 0).alias("has_bytes"))


@query("snk01_size_estimate", S.with_(S.FACTS) + """
SELECT quarter_date, count(DISTINCT rssd_id) AS n_banks, count(DISTINCT code) AS n_codes,
  count(DISTINCT rssd_id) * (count(DISTINCT code) + 2) * 8 AS bytes FROM facts GROUP BY 1""")
def _(spark, sf):
    return store.estimated_bytes(facts(spark, sf))


@query("snk04_cleanup", S.with_(S.FACTS) + """
SELECT rssd_id, quarter_date, code, value_raw FROM facts WHERE quarter_date <= '20010630'""")
def _(spark, sf):
    """Unpublished quarters are deleted from the stored table; what is left is read back."""
    path = _stored(spark, sf)
    published = life.published_quarters(spark, AS_OF, START_YEAR)
    plan = life.to_delete(store.inventory(spark, path), published)
    store.delete_quarters(spark, path, plan, dry_run=False)
    return store.read_facts(spark, path).drop("value_num")


@query("snk02_run_log", S.with_(S.FACTS) + """
SELECT 'incremental' AS mode, 'completed' AS result, string_agg(quarter_date, ',' ORDER BY quarter_date DESC) AS succeeded, count(*) AS total_quarters
FROM (SELECT DISTINCT quarter_date FROM facts)""")
def _(spark, sf):
    """Two runs are appended; the newest is read back (SRC-10)."""
    from datetime import datetime, timezone

    path = scratch_path(spark, "runs")
    # One row per calendar quarter.
    quarters = sorted((r[0] for r in facts(spark, sf).select("quarter_date").distinct().collect()), reverse=True)
    base = {"mode": "incremental", "failed": [], "deferred": [], "bytes_written": 0, "duration_seconds": 0, "total_gb": 0.0}
    store.append_run(spark, path, {**base, "run_ts": datetime(2001, 1, 1, tzinfo=timezone.utc), "succeeded": [], "total_quarters": 0, "result": "up_to_date"})
    store.append_run(spark, path, {**base, "run_ts": datetime(2001, 11, 15, tzinfo=timezone.utc), "succeeded": quarters, "total_quarters": len(quarters), "result": "completed"})
    return store.last_run(spark, path).select(
        "mode", "result", F.array_join("succeeded", ",").alias("succeeded"), "total_quarters"
    )


# ---------------------------------------------------------------- exports

@query("snk03_csv_roundtrip", S.with_(S.ITEMS) + """
SELECT rssd_id, reporting_period, item_code, coalesce(nullif(value_raw, ''), '') AS value_raw, description, coalesce(section, '-') AS section FROM items""")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    columns = ["rssd_id", "reporting_period", "item_code", "value_raw", "description", "section"]
    exports.write_csv(it.with_section(line_items(spark, sf)).select(*columns), path)
    return exports.read_csv(spark, path, columns)


_STATUS = lambda c: f"(CASE WHEN {c} IS NULL THEN 'N/A' WHEN {c} >= {{w}} THEN 'WELL-CAPITALIZED' WHEN {c} >= {{a}} THEN 'ADEQUATELY CAPITALIZED' ELSE 'UNDERCAPITALIZED' END)"
_P = lambda c: f"coalesce({S.fixed(c, 2)} || '%', 'N/A')"


def _bank_analysis_sql() -> str:
    from finfacts.checks.catalog_facts import LOO_SQL, MEMBERS_SQL

    cols = ["UBPRD487", "UBPRD488", "UBPRD486", "UBPRE013", "UBPRE630", "UBPRE018", "UBPR7414", "UBPRE019"]
    own = ", ".join(f"max(value_num) FILTER (WHERE code = '{c}') AS {c}" for c in cols)
    gap = lambda c, p: f"coalesce({S.fixed(S.rnd(f'({c} - {p})', 6), 2)} || 'pp', 'N/A')"
    status = lambda c: _STATUS(c).format(
        w=next(r[2] for r in ref.AGENT_THRESHOLDS if r[0] == c), a=next(r[3] for r in ref.AGENT_THRESHOLDS if r[0] == c))
    return S.with_(S.FACTS, MEMBERS_SQL, LOO_SQL, S.INSTITUTIONS, f"""own AS (SELECT rssd_id, quarter_date, {own} FROM facts
      WHERE valid AND code IN {S.in_list(cols)} GROUP BY 1, 2),
    peer AS (SELECT rssd_id, quarter_date, max(peer_average) FILTER (WHERE code = 'UBPRE013') AS peer_roa,
      max(peer_average) FILTER (WHERE code = 'UBPRE018') AS peer_nim FROM loo WHERE peer_group = 'all' GROUP BY 1, 2)""") + f"""
    SELECT o.rssd_id, o.quarter_date, concat_ws(chr(10), '# Bank Financial Analysis Report', '',
      '**Institution:** ' || coalesce(name, o.rssd_id) || ' (RSSD: ' || o.rssd_id || ')', '**Period:** ' || {S.q_label('o.quarter_date')}, '',
      '## Capital Adequacy', '- CET1 Ratio: ' || {_P('UBPRD487')} || ' - ' || {status('UBPRD487')},
      '- Total Capital: ' || {_P('UBPRD488')} || ' - ' || {status('UBPRD488')},
      '- Leverage Ratio: ' || {_P('UBPRD486')} || ' - ' || {status('UBPRD486')}, '',
      '## Profitability', '- Return on Assets (ROA): ' || {_P('UBPRE013')}, '- Return on Equity (ROE): ' || {_P('UBPRE630')},
      '- Net Interest Margin (NIM): ' || {_P('UBPRE018')}, '', '## Asset Quality',
      '- Non-Performing Loan Ratio: ' || {_P('UBPR7414')}, '- Net Charge-Off Rate: ' || {_P('UBPRE019')}, '',
      '## Peer Comparison', '| Metric | This Bank | Peer Avg | Difference |', '| --- | --- | --- | --- |',
      '| ROA | ' || {_P('UBPRE013')} || ' | ' || {_P('peer_roa')} || ' | ' || {gap('UBPRE013', 'peer_roa')} || ' |',
      '| NIM | ' || {_P('UBPRE018')} || ' | ' || {_P('peer_nim')} || ' | ' || {gap('UBPRE018', 'peer_nim')} || ' |') AS report
    FROM own o LEFT JOIN peer p ON p.rssd_id = o.rssd_id AND p.quarter_date = o.quarter_date LEFT JOIN institutions i ON i.rssd_id = o.rssd_id"""


@query("snk05_markdown", _bank_analysis_sql())
def _(spark, sf):
    return exports.bank_analysis(facts(spark, sf), institutions(spark, sf), PANEL_BUCKETS)


@query("snk05_alert_files", S.with_(S.FACTS, S.AGENT_THRESHOLDS) + """
SELECT quarter_date, count(*) AS n_alerts FROM facts JOIN agent_thresholds USING (code) WHERE valid AND value_num < well GROUP BY 1""")
def _(spark, sf):
    """Alert reports are written as text per quarter; headings are counted back from the files."""
    path = scratch_path(spark, "alerts")
    exports.write_markdown(exports.regulatory_alerts(facts(spark, sf), institutions(spark, sf)), path, "quarter_date")
    lines = spark.read.schema("value string, quarter_date string").text(path)
    return lines.where(F.col("value") == "# Regulatory Alert").groupBy("quarter_date").agg(F.count(F.lit(1)).alias("n_alerts"))


# ---------------------------------------------------------------- snapshots

@query("src08_institutions", S.with_(S.INSTITUTIONS) + "SELECT rssd_id, name, city, state FROM institutions")
def _(spark, sf):
    path = scratch_path(spark, "panel")
    institutions(spark, sf).select(
        F.col("rssd_id").cast("bigint").alias("ID_RSSD"), F.concat(F.lit("  "), "name", F.lit("   ")).alias("Name"),
        F.concat("city", F.lit("  ")).alias("City"), F.concat("state", F.lit(" ")).alias("State"),
    ).write.json(path)
    return snapshots.read_institutions(spark, path)


@query("src08_lost_lines", S.with_(S.INSTITUTIONS) + """
SELECT count(*) FILTER (WHERE NOT ends_with(rssd_id, '7')) AS n_read, count(*) FILTER (WHERE ends_with(rssd_id, '7')) AS n_lost
FROM institutions""")
def _(spark, sf):
    """Lines that break off (here those of ids ending in 7) are counted; all others are read."""
    path = scratch_path(spark, "panel")
    line = F.to_json(F.struct(F.col("rssd_id").cast("bigint").alias("ID_RSSD"), F.col("name").alias("Name"),
                              F.col("city").alias("City"), F.col("state").alias("State")))
    broken = F.when(F.col("rssd_id").endswith("7"), F.substring(line, 1, 20)).otherwise(line)
    institutions(spark, sf).select(broken.alias("value")).write.text(path)
    read = snapshots.read_institutions(spark, path).agg(F.count(F.lit(1)).alias("n_read"))
    lost = snapshots.unreadable(spark, path, "struct<ID_RSSD:bigint>")
    lost = lost.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("n_lost"))
    # Both sides have one row.
    return read.select("n_read", lost.scalar().alias("n_lost"))


_PERIODS_SQL = f"""periods AS (SELECT DISTINCT strftime(last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)), '%m/%d/%Y') AS period,
  {S.q_end('l_shipdate')} AS quarter_date FROM lineitem)"""


def _period_snapshot(spark, sf):
    path = scratch_path(spark, "periods")
    listed = qn.available_periods(panel_cells(spark, sf).select("quarter_date").distinct())
    listed.select(F.to_json(F.array_append("periods", F.lit("not a date"))).alias("value")).write.text(path)
    return snapshots.read_periods(spark, path)


@query("src09_periods", S.with_(_PERIODS_SQL) + "SELECT period, row_number() OVER (ORDER BY quarter_date DESC) - 1 AS pos, quarter_date FROM periods")
def _(spark, sf):
    return _period_snapshot(spark, sf)


@query("tf05_available_periods", S.with_(_PERIODS_SQL) + """
SELECT string_agg(period, ', ' ORDER BY quarter_date DESC) FILTER (WHERE pos <= 12) AS periods, count(*) AS n_periods
FROM (SELECT *, row_number() OVER (ORDER BY quarter_date DESC) AS pos FROM periods)""")
def _(spark, sf):
    return tools.get_available_periods(_period_snapshot(spark, sf))


# ---------------------------------------------------------------- planning

_CAL = """cal AS (SELECT strftime(last_day(make_date(y, q * 3, 1)), '%Y%m%d') AS quarter_date,
   strftime(last_day(make_date(y, q * 3, 1)), '%m/%d/%Y') AS period_mdy
  FROM range(1993, 2002) t(y), range(1, 5) u(q) WHERE y * 4 + q <= 2001 * 4 + 2)"""
_INV = """inv AS (SELECT quarter_date, CAST(sum(n_lines) * 9 * 8 AS BIGINT) AS bytes FROM cells GROUP BY 1)"""


def _inventory(spark, sf):
    return panel_cells(spark, sf).groupBy("quarter_date").agg((F.sum("n_lines") * 9 * 8).alias("bytes"))


@query("sc20_calendar", S.with_(S.CELLS, _INV, _CAL) + """
SELECT c.quarter_date, period_mdy, coalesce(bytes, 0) AS bytes FROM cal c LEFT JOIN inv USING (quarter_date)""")
def _(spark, sf):
    cal = life.published_quarters(spark, AS_OF, START_YEAR)
    return cal.join(_inventory(spark, sf), "quarter_date", "left").select(
        "quarter_date", "period_mdy", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes")
    )


@query("sc21_fallback", S.with_(S.CELLS, _INV) + """
SELECT quarter_date, coalesce(bytes, 0) AS bytes FROM (VALUES ('19991231'), ('20000331'), ('20000630'), ('20000930'), ('20001231'), ('20010331'), ('20010630'), ('20010930')) v(quarter_date)
LEFT JOIN inv USING (quarter_date)""")
def _(spark, sf):
    cal = per.recent_calendar(spark, AS_OF)
    return cal.join(_inventory(spark, sf), "quarter_date", "left").select(
        "quarter_date", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes")
    )


@query("jn05_delta", S.with_(S.CELLS, _INV, _CAL) + "SELECT quarter_date, period_mdy FROM cal WHERE quarter_date NOT IN (SELECT quarter_date FROM inv)")
def _(spark, sf):
    return life.to_ingest(life.published_quarters(spark, AS_OF, START_YEAR), _inventory(spark, sf))


# Seen a year and a half later, the newest quarters are published but not stored.
LATER = "2003-05-15"


@query("set02_recent_delta", S.with_(S.CELLS, _INV) + """
SELECT strftime(d, '%Y%m%d') AS quarter_date, strftime(d, '%m/%d/%Y') AS period_mdy FROM (
  SELECT last_day(make_date(y, q * 3, 1)) AS d FROM range(1993, 2004) t(y), range(1, 5) u(q) WHERE y * 4 + q <= 2002 * 4 + 4 ORDER BY d DESC LIMIT 8)
WHERE strftime(d, '%Y%m%d') NOT IN (SELECT quarter_date FROM inv)""")
def _(spark, sf):
    return life.to_ingest(life.published_quarters(spark, LATER, START_YEAR), _inventory(spark, sf), recent=8)


_CLEANUP = S.with_(S.CELLS, _INV, _CAL) + "SELECT quarter_date, bytes FROM inv WHERE quarter_date NOT IN (SELECT quarter_date FROM cal)"


@query("jn06_cleanup", _CLEANUP)
def _(spark, sf):
    return life.to_delete(_inventory(spark, sf), life.published_quarters(spark, AS_OF, START_YEAR))


@query("set03_to_delete", _CLEANUP)
def _(spark, sf):
    return life.to_delete(_inventory(spark, sf), life.published_quarters(spark, AS_OF, START_YEAR))


@query("agg10_inventory_totals", S.with_(S.CELLS, _INV) + """
SELECT count(*) AS n_quarters, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes) AS DOUBLE) / 1073741824.0::DOUBLE AS total_gb FROM inv""")
def _(spark, sf):
    return life.inventory_totals(_inventory(spark, sf))


_BUDGET = 0.051
_ADMIT = f"""admitted AS (SELECT *, {_BUDGET}::DOUBLE - CAST(prior_bytes AS DOUBLE) / 1073741824.0::DOUBLE AS remaining_gb FROM (
  SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY quarter_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_bytes FROM inv)),
decided AS (SELECT *, CASE WHEN remaining_gb >= 0.05::DOUBLE THEN 'admitted' ELSE 'deferred' END AS decision FROM admitted)"""


@query("win05_budget", S.with_(S.CELLS, _INV, _ADMIT) + "SELECT quarter_date, bytes, prior_bytes, remaining_gb, decision FROM decided")
def _(spark, sf):
    return life.admit(_inventory(spark, sf), budget_gb=_BUDGET)


_OUTCOME = """CASE WHEN decision = 'deferred' THEN 'deferred' WHEN quarter_date LIKE '%0331' THEN 'failed' ELSE 'succeeded' END"""
_RUN = S.with_(S.CELLS, _INV, _ADMIT) + f"""SELECT coalesce(string_agg(quarter_date, ',' ORDER BY quarter_date DESC) FILTER (WHERE o = 'succeeded'), '') AS succeeded,
  coalesce(string_agg(quarter_date, ',' ORDER BY quarter_date DESC) FILTER (WHERE o = 'failed'), '') AS failed,
  coalesce(string_agg(quarter_date, ',' ORDER BY quarter_date DESC) FILTER (WHERE o = 'deferred'), '') AS deferred,
  CAST(coalesce(sum(bytes) FILTER (WHERE o = 'succeeded'), 0) AS BIGINT) AS bytes_written,
  CASE WHEN count(*) FILTER (WHERE o = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS result
FROM (SELECT *, {_OUTCOME} AS o FROM decided)"""


@query("agg15_run_summary", _RUN)
def _(spark, sf):
    decided = life.admit(_inventory(spark, sf), budget_gb=_BUDGET)
    outcome = (
        F.when(F.col("decision") == "deferred", "deferred")
        .when(F.col("quarter_date").endswith("0331"), "failed").otherwise("succeeded")
    )
    return life.outcome_summary(decided.withColumn("outcome", outcome))


@query("rep12_ingestion_plan", S.with_(S.CELLS, _INV, _CAL) + """
, plan AS (SELECT quarter_date, period_mdy, CAST(33554432 AS BIGINT) AS bytes FROM cal
  WHERE quarter_date NOT IN (SELECT quarter_date FROM inv)),
priored AS (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY quarter_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_bytes FROM plan)
SELECT *, 0.2::DOUBLE - CAST(prior_bytes AS DOUBLE) / 1073741824.0::DOUBLE AS remaining_gb,
  CASE WHEN 0.2::DOUBLE - CAST(prior_bytes AS DOUBLE) / 1073741824.0::DOUBLE >= 0.05::DOUBLE THEN 'admitted' ELSE 'deferred' END AS decision FROM priored""".lstrip())
def _(spark, sf):
    missing = life.to_ingest(life.published_quarters(spark, AS_OF, START_YEAR), _inventory(spark, sf))
    return life.admit(life.with_planned_bytes(missing), budget_gb=0.2)


# ---------------------------------------------------------------- streaming

def _landed(spark, sf):
    root = scratch_path(spark, "landing")
    roundtrip.write_archives(_archives(spark, sf), f"{root}/in")
    return root


@query("str01_incremental", _PARSED + " AND quarter_date <= '20010630'")
def _(spark, sf):
    """Archives land, a run ingests what is old enough, a second run finds nothing new."""
    root = _landed(spark, sf)
    for _ in range(2):
        incremental.ingest_new(
            spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/checkpoint", AS_OF, max_files_per_trigger=512
        )
    return store.read_facts(spark, f"{root}/facts").drop("value_num")


@query("str02_publication_lag", S.with_(S.FACTS) + """
SELECT DISTINCT quarter_date, CASE WHEN quarter_date <= '20010630' THEN 'succeeded' ELSE 'deferred' END AS first_run, 'succeeded' AS second_run FROM facts""")
def _(spark, sf):
    """Quarters inside the publication lag wait; a run two quarters later takes them in."""
    root = _landed(spark, sf)
    run = lambda as_of: incremental.ingest_new(
        spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/checkpoint", as_of, max_files_per_trigger=512
    )
    last = lambda: spark.read.schema(incremental.OUTCOMES).parquet(f"{root}/log").groupBy("quarter_date").agg(
        F.max_by("outcome", "run_ts").alias("outcome")
    )
    run(AS_OF)
    first_path = scratch_path(spark, "first")
    last().withColumnRenamed("outcome", "first_run").write.parquet(first_path)
    run("2002-05-15")
    return spark.read.parquet(first_path).join(last().withColumnRenamed("outcome", "second_run"), "quarter_date")


@query("rep12_run", S.with_(S.FACTS) + """
, q AS (SELECT DISTINCT quarter_date FROM facts)
SELECT 'completed' AS result, string_agg(quarter_date, ',' ORDER BY quarter_date DESC) FILTER (WHERE quarter_date <= '20010630') AS succeeded,
  coalesce(string_agg(quarter_date, ',' ORDER BY quarter_date DESC) FILTER (WHERE quarter_date > '20010630'), '') AS deferred,
  count(*) FILTER (WHERE quarter_date <= '20010630') AS total_quarters FROM q""".lstrip())
def _(spark, sf):
    """Plan, budget, load and run log in one run; the run log is read back."""
    root = _landed(spark, sf)
    ingestion.run(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/runs", f"{root}/checkpoint", AS_OF,
                  start_year=START_YEAR, max_files_per_trigger=512)
    return store.last_run(spark, f"{root}/runs").select(
        "result", F.array_join("succeeded", ",").alias("succeeded"), F.array_join("deferred", ",").alias("deferred"),
        "total_quarters")


@query("rep12_observed", S.with_(S.FACTS) + """
, d AS (SELECT DISTINCT rssd_id, quarter_date FROM facts)
SELECT count(*) AS n_members,
  (SELECT count(*) FROM facts WHERE quarter_date <= '20010630' AND (trim(value_raw) <> '' OR code = 'UBPR2170')) AS n_facts,
  count(DISTINCT quarter_date || '-' || CAST(floor(CAST(rssd_id AS BIGINT) / 256) AS BIGINT)) AS n_strays
FROM d""".lstrip())
def _(spark, sf):
    """What the run's own writes observed, from the run log: members staged, facts stored, stray members of archives."""
    root = _landed(spark, sf)
    ingestion.run(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/runs", f"{root}/checkpoint", AS_OF,
                  start_year=START_YEAR, max_files_per_trigger=512)
    return store.last_run(spark, f"{root}/runs").select(
        "n_members", "n_facts", F.col("rejects")["no_entity_id"].alias("n_strays"))


@query("src10_last_run", S.with_(S.FACTS) + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT quarter_date FROM facts)) AS total_quarters, 0::BIGINT AS rows_when_absent""")
def _(spark, sf):
    """The newest run of several, and no row when no log exists."""
    from datetime import datetime, timezone

    path = scratch_path(spark, "runs")
    absent = store.last_run(spark, path).count()
    # One row per calendar quarter.
    n = facts(spark, sf).select("quarter_date").distinct().count()
    for year, total in ((2001, n), (1999, 0)):
        store.append_run(spark, path, {"run_ts": datetime(year, 1, 1, tzinfo=timezone.utc), "total_quarters": total})
    return store.last_run(spark, path).select("total_quarters", F.lit(absent).cast("bigint").alias("rows_when_absent"))


@query("src01_wide_quarter", S.with_(S.FACTS) + "SELECT rssd_id, quarter_date, code, value_raw FROM facts")
def _(spark, sf):
    """Wide quarter tables with drifting columns, read back as long facts."""
    path = scratch_path(spark, "wide")
    rows = facts(spark, sf)
    for name, part in (("old", "quarter_date <= '19981231'"), ("new", "quarter_date > '19981231'")):
        some = rows.where(part)
        codes = sorted(r[0] for r in some.select("code").distinct().collect())
        fx.wide(some, codes).write.parquet(f"{path}/part={name}")
    return store.read_wide(spark, path).where("code <> 'part'").select("rssd_id", "quarter_date", "code", "value_raw")


# ---------------------------------------------------------------- questions

Q = S.with_(S.QUESTIONS)


def any_sql(phrases) -> str:
    return S.any_of("question", phrases)


_ROUTE = f"""CASE WHEN {any_sql(ref.ROUTE_OUT_OF_SCOPE)} THEN 'out_of_scope' WHEN {any_sql(ref.ROUTE_DATA)} THEN 'data'
  WHEN {any_sql(ref.ROUTE_KNOWLEDGE)} THEN 'knowledge' WHEN coalesce(rssd_id, '') <> '' THEN 'data' ELSE 'knowledge' END"""


@query("qr01_route", Q + f"SELECT question_id, {_ROUTE} AS route FROM questions")
def _(spark, sf):
    return questions(spark, sf).select("question_id", qn.route("question", F.col("rssd_id")).alias("route"))


def word_sql(phrases) -> str:
    return "regexp_matches(lower(question), '\\b(" + "|".join(p.strip() for p in phrases) + ")\\b')"


@query("qr01_route_words", Q + f"""
SELECT question_id, CASE WHEN {word_sql(ref.ROUTE_OUT_OF_SCOPE)} THEN 'out_of_scope' WHEN {word_sql(ref.ROUTE_DATA)} THEN 'data'
  WHEN {word_sql(ref.ROUTE_KNOWLEDGE)} THEN 'knowledge' WHEN coalesce(rssd_id, '') <> '' THEN 'data' ELSE 'knowledge' END AS route
FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", qn.route("question", F.col("rssd_id"), word_boundary=True).alias("route"))


@query("qr02_intent", Q + f"""
SELECT question_id, CASE WHEN {any_sql(ref.RATIO_INTENT_TREND)} THEN 'trend' WHEN {any_sql(ref.RATIO_INTENT_PEER)} THEN 'peer'
  WHEN {any_sql(ref.RATIO_INTENT_REGULATORY)} THEN 'regulatory' ELSE 'ratios' END AS intent FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", qn.ratio_intent("question").alias("intent"))


@query("qr03_intent", Q + f"""
SELECT question_id, CASE WHEN {any_sql(ref.REPORT_INTENT_PERIODS)} THEN 'periods' WHEN {any_sql(ref.REPORT_INTENT_SCHEDULES_LIST)} THEN 'schedules_list'
  WHEN {any_sql(ref.REPORT_INTENT_SCHEDULE)} THEN 'schedule' ELSE 'metrics' END AS intent FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", qn.report_intent("question").alias("intent"))


@query("qr04_peer_hint", Q + """
SELECT question_id, CASE WHEN contains(lower(question), 'large') THEN 'large' WHEN contains(lower(question), 'community') OR contains(lower(question), 'small') THEN 'community'
  WHEN contains(lower(question), 'mid') THEN 'mid' ELSE 'all' END AS hint FROM questions""")
def _(spark, sf):
    return questions(spark, sf).select("question_id", qn.peer_group_hint("question").alias("hint"))


_PHRASES = "(CASE " + " ".join(
    f"WHEN contains(lower(question), {ref.sql_literal(p)}) THEN '{c}'" for p, c in sorted(ref.METRIC_PHRASES, key=lambda x: -len(x[0]))
) + " END)"
_CODE_RE = r"regexp_extract(upper(question), '\bUBPR[A-Z0-9]{4,}\b', 0)"
_METRIC = f"coalesce(nullif({_CODE_RE}, ''), {_PHRASES})"


@query("sc24_metric_text", Q + f"SELECT question_id, coalesce({_METRIC}, '-') AS code FROM questions")
def _(spark, sf):
    return questions(spark, sf).select("question_id", F.coalesce(qn.metric_code("question"), F.lit("-")).alias("code"))


_RANGE = """ranged AS (SELECT *, list_transform(regexp_extract_all(lower(question), 'q([1-4])\\s*([0-9]{4})', 1), lambda x: x) AS qs,
   regexp_extract_all(lower(question), 'q([1-4])\\s*([0-9]{4})', 2) AS ys FROM questions),
keyed AS (SELECT *, CASE WHEN len(qs) >= 2 THEN ys[1] || ['0331', '0630', '0930', '1231'][CAST(qs[1] AS INT)] END AS k1,
   CASE WHEN len(qs) >= 2 THEN ys[2] || ['0331', '0630', '0930', '1231'][CAST(qs[2] AS INT)] END AS k2 FROM ranged)"""


@query("sc23_quarter_range", Q.rstrip() + ", " + _RANGE + """
SELECT question_id, coalesce(least(k1, k2), '-') AS from_quarter, coalesce(greatest(k1, k2), '-') AS to_quarter FROM keyed""")
def _(spark, sf):
    span = per.quarter_range_in_text("question")
    return questions(spark, sf).select(
        "question_id", F.coalesce(span["from_quarter"], F.lit("-")).alias("from_quarter"),
        F.coalesce(span["to_quarter"], F.lit("-")).alias("to_quarter"),
    )


@query("qr05_action", Q.rstrip() + ", " + _RANGE + f"""
, avail AS (SELECT max(quarter_date) AS newest, min(quarter_date) AS eighth FROM (SELECT DISTINCT quarter_date FROM cells ORDER BY 1 DESC LIMIT 8)),
tabbed AS (SELECT *, {any_sql(ref.ACTION_CALL)} AS is_call, CASE WHEN {any_sql(ref.ACTION_TREND)} THEN 'trends' WHEN {any_sql(ref.ACTION_PEER)} THEN 'peers'
  WHEN {any_sql(ref.ACTION_PDF)} THEN 'pdf' WHEN {any_sql(ref.ACTION_SECTIONS)} THEN 'sections'
  WHEN {any_sql(ref.ACTION_CALL)} THEN 'metrics' ELSE 'summary' END AS tab FROM keyed)
SELECT question_id, CASE WHEN is_call THEN 'load_report' ELSE 'load_ubpr' END AS type, tab,
  CASE WHEN tab = 'trends' AND rssd_id IS NOT NULL THEN {_METRIC} END AS metric_code,
  CASE WHEN tab = 'trends' AND rssd_id IS NOT NULL THEN coalesce(least(k1, k2), eighth) END AS from_quarter,
  CASE WHEN tab = 'trends' AND rssd_id IS NOT NULL THEN coalesce(greatest(k1, k2), newest) END AS to_quarter
FROM tabbed, avail""".lstrip())
def _(spark, sf):
    newest = panel_cells(spark, sf).select("quarter_date").distinct()
    # Two scalar subqueries: the eighth newest stored quarter, or the oldest, and the newest.
    keys = qn.available_periods(newest)
    ends = {"eighth": F.get("keys", F.least(F.lit(7), F.size("keys") - 1)), "newest": F.get("keys", F.lit(0))}
    asked = questions(spark, sf).withColumns({name: keys.select(end).scalar() for name, end in ends.items()})
    act = qn.action("question", F.col("rssd_id"), F.col("eighth"), F.col("newest"))
    return asked.select("question_id", act.alias("a")).select("question_id", "a.*")


_NAMES = " ".join(f"WHEN contains(t, '{n}') THEN {q}" for n, q in ref.QUARTER_NAMES)


def _asked_sql(year: int, quarter: int) -> str:
    """What the questions ask for in a given current quarter."""
    last_year, last_quarter = (year, quarter - 1) if quarter > 1 else (year - 1, 4)
    return f"""asked AS (SELECT question_id, CASE WHEN lastq THEN {last_year} WHEN thisq THEN {year} WHEN lasty THEN {year - 1}
    ELSE coalesce(CAST(nullif(yt, '') AS INT), {year}) END AS y,
  CASE WHEN lastq THEN {last_quarter} WHEN thisq THEN {quarter} WHEN lasty THEN 4
    ELSE coalesce(CASE {_NAMES} END, CASE WHEN yt <> '' THEN 4 ELSE {quarter} END) END AS q FROM (
  SELECT question_id, lower(trim(question)) AS t, regexp_extract(lower(trim(question)), '\\b(20[0-9]{{2}})\\b', 1) AS yt,
    contains(lower(question), 'last quarter') OR contains(lower(question), 'previous quarter') AS lastq,
    contains(lower(question), 'this quarter') OR contains(lower(question), 'current quarter') AS thisq,
    contains(lower(question), 'last year') AS lasty FROM questions)),
wanted AS (SELECT *, last_day(make_date(y, q * 3, 1)) AS d FROM asked)"""


_ASKED = _asked_sql(2001, 4)


@query("sc22_period_text", Q.rstrip() + ", " + _ASKED + """
SELECT question_id, strftime(d, '%m/%d/%Y') AS period, strftime(d, '%Y%m%d') AS quarter_date, 'Q' || CAST(q AS VARCHAR) || ' ' || CAST(y AS VARCHAR) AS label FROM wanted""")
def _(spark, sf):
    r = qn.resolved_period("question", AS_OF)
    return questions(spark, sf).select(
        "question_id", r["period"].alias("period"), r["quarter_date"].alias("quarter_date"), r["label"].alias("label")
    )


# Asked a year and a half after the last stored quarter, so that many wanted periods are not there.
@query("jn09_nearest", Q.rstrip() + ", " + _asked_sql(2003, 2) + """
, avail AS (SELECT DISTINCT strptime(quarter_date, '%Y%m%d')::DATE AS a FROM cells),
near AS (SELECT question_id, arg_min(a, ROW(abs(a - d), -epoch(a))) AS a, any_value(d) AS d FROM wanted, avail GROUP BY 1)
SELECT question_id, strftime(a, '%m/%d/%Y') AS period, strftime(a, '%Y%m%d') AS quarter_date, a = d AS exact FROM near""".lstrip())
def _(spark, sf):
    some = panel_cells(spark, sf).select("quarter_date").distinct()
    # One array of calendar quarters, newest first, as a scalar subquery.
    available = qn.available_periods(some).select("periods").scalar()
    asked = qn.resolved_period("question", LATER, F.col("available"))
    return questions(spark, sf).withColumn("available", available).select("question_id", asked.alias("r")).select(
        "question_id", "r.period", "r.quarter_date", "r.exact"
    )


@query("sc25_code_lists", Q + r"""
SELECT question_id, coalesce(nullif(array_to_string(list_filter(rc, lambda x, i: list_position(rc, x) = i), ','), ''), 'UBPRE013,UBPRE018,UBPRD487,UBPRD486') AS codes,
  coalesce(nullif(array_to_string(list_filter(sc, lambda x, i: list_position(sc, x) = i), ','), ''), 'RC,RI') AS schedules
FROM (SELECT question_id, regexp_extract_all(upper(question), '\bUBPR[A-Z0-9]{4,}\b') AS rc,
  regexp_extract_all(upper(question), '\bRC(?:-[A-Z]+)?\b|\bRI(?:-[A-Z]+)?\b') AS sc FROM questions)""")
def _(spark, sf):
    return questions(spark, sf).select(
        "question_id", F.array_join(qn.trend_codes("question"), ",").alias("codes"),
        F.array_join(qn.asked_schedules("question"), ",").alias("schedules"),
    )
