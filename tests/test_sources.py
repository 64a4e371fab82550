"""Payload, archive and store behaviour on literal inputs."""

import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from finfacts.session import scratch_path
from finfacts.sources import sdf, store, xbrl
from finfacts.streaming import incremental


def decode(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(sdf.decode_payload("t")).collect()]


def test_decode_payload(spark):
    b64 = base64.b64encode("naïve;text".encode()).decode()
    latin = base64.b64encode("naïve;text".encode("latin-1")).decode()
    got = decode(spark, [b64, json.dumps(b64), f'  "{b64}"  ', latin, "plain; text", "abc", json.dumps("a;b\nc"), '{"a": 1}', ""])
    assert got == ["naïve;text", "naïve;text", "naïve;text", "naïve;text", "plain; text", "abc", "a;b\nc", '{"a": 1}', ""]


def parse(spark, text):
    frame = spark.createDataFrame([("d", text)], "doc string, text string")
    return sdf.parse_documents(frame).orderBy("source_line_number").collect()


def test_parse_records(spark):
    text = 'h1;h2\r\n d ; 7 ;RCFD2170;1;x;"a ""quoted""; text";RCB;1.\n\nshort;8\nd;9;C;2;x;"two\nlines";RI;2'
    rows = parse(spark, text)
    assert [r["source_line_number"] for r in rows] == [2, 3, 4, 5]
    assert (rows[0]["call_date"], rows[0]["bank_rssd"], rows[0]["description"], rows[0]["section"]) == ("d", "7", 'a "quoted"; text', "RC")
    assert rows[1]["columns"] == [""] * 8 and rows[1]["section"] is None
    assert (rows[2]["bank_rssd"], rows[2]["line_number"], rows[2]["raw"]) == ("8", "", "short;8;;;;;;")
    assert (rows[3]["description"], rows[3]["section"]) == ("two\nlines", "RI")


def test_header_only_and_empty(spark):
    assert parse(spark, "just;a;header") == []
    assert parse(spark, "") == []


def test_whole_long_document_is_parsed(spark):
    body = "\n".join(f"d;1;C{i};{i};x;{'long text ' * 20};RC;{i}" for i in range(20_000))
    frame = spark.createDataFrame([("d", "header\n" + body)], "doc string, text string")
    row = sdf.parse_documents(frame).agg(F.count("*").alias("n"), F.max("source_line_number").alias("m")).first()
    assert (row["n"], row["m"]) == (20_000, 20_001)


def zip_of(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        for name, content in members.items():
            out.writestr(name, content)
    return buffer.getvalue()


def report(*facts):
    body = "".join(f'<{t} contextRef="{c}">{v}</{t}>' for t, c, v in facts)
    return f'<x xmlns:u="http://e/u" xmlns:o="http://e/o" xmlns:UBPRns="http://e/UBPR">{body}</x>'


def test_archive_rules(spark):
    now, old = "C_1_2020-03-31", "C_1_2019-12-31"
    good = report(
        ("u:UBPRE013", now, " 1 "), ("u:UBPRE013", now, "2"), ("u:UBPRE018", old, "3"), ("u:UBPRE019", now, "  "),
        ("o:Name", now, "x"), ("UBPRns:Other", now, "4"),
    )
    content = zip_of({
        "FI 11(ID RSSD) 20200331.xml": good, "FI 12(ID RSSD) 20200331.xml": "<x><broken", "stray.xml": good,
        "FI 13(ID RSSD) 20200331.xml": report(("u:UBPRE013", old, "9")), "FI 14(ID RSSD) 20200331.txt": good,
    })
    archives = spark.createDataFrame(
        [("a.zip", content, "20200331"), ("b.zip", b"not a zip", "20200630")], "path string, content binary, quarter_date string"
    )
    parsed = xbrl.parse_archives(archives, spread=3)
    facts = {(r["rssd_id"], r["code"]): r["value_raw"] for r in xbrl.facts_of(parsed).collect()}
    # The later duplicate wins; a namespace that mentions the prefix admits its elements.
    assert facts == {("11", "UBPRE013"): "2", ("11", "Other"): "4"}
    status = sorted(r["status"] for r in parsed.where("code IS NULL").collect())
    assert status == ["malformed_xml", "no_entity_id", "no_facts", "unreadable_archive"]
    outcome = {r["path"]: (r["outcome"], r["n_institutions"]) for r in xbrl.archive_outcomes(parsed).collect()}
    assert outcome == {"a.zip": ("succeeded", 1), "b.zip": ("failed", 0)}


def test_store_overwrites_only_written_quarters(spark, facts_of):
    path = scratch_path(spark, "store")
    store.write_quarters(facts_of([("1", "20200331", "A", "1"), ("2", "20200331", "A", "2"), ("1", "20200630", "A", "3")]), path)
    store.write_quarters(facts_of([("1", "20200331", "A", "9")]), path)
    rows = {(r["rssd_id"], r["quarter_date"], r["value_raw"]) for r in store.read_facts(spark, path).collect()}
    assert rows == {("1", "20200331", "9"), ("1", "20200630", "3")}
    assert {r["quarter_date"] for r in store.inventory(spark, path).collect()} == {"20200331", "20200630"}
    assert store.scan_quarter(spark, path, "20200630").count() == 1


def test_last_run_absent(spark):
    assert store.last_run(spark, scratch_path(spark, "nothing")).count() == 0


def test_restated_archive_replaces_its_quarter(spark, tmp_path):
    root = scratch_path(spark, "land")
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(f"file://{root}")
    system.create_dir(f"{base}/in", recursive=True)

    def drop(name, members):
        with system.open_output_stream(f"{base}/in/{name}") as out:
            out.write(zip_of(members))

    def run():
        incremental.ingest_new(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/cp", "2021-01-15")
        return {(r["rssd_id"], r["quarter_date"], r["value_raw"]) for r in store.read_facts(spark, f"{root}/facts").collect()}

    doc = lambda rssd, day, v: {f"FI {rssd}(ID RSSD) x.xml": report(("u:UBPRE013", f"C_{day}", v))}
    drop("20200331-a.zip", doc("1", "2020-03-31", "1"))
    drop("20200630-a.zip", doc("1", "2020-06-30", "5"))
    drop("20200930-a.zip", {"FI 1(ID RSSD) x.xml": "<broken"})
    assert run() == {("1", "20200331", "1"), ("1", "20200630", "5")}
    # A second archive of a stored quarter joins the first one; the bad quarter stopped nothing.
    drop("20200331-b.zip", doc("2", "2020-03-31", "7"))
    assert run() == {("1", "20200331", "1"), ("2", "20200331", "7"), ("1", "20200630", "5")}
    log = spark.read.schema(incremental.OUTCOMES).parquet(f"{root}/log")
    assert {r[0] for r in log.where("outcome = 'failed'").select("quarter_date").collect()} == {"20200930"}


def _folder(spark, name):
    from pyarrow import fs

    root = scratch_path(spark, name)
    system, base = fs.FileSystem.from_uri(f"file://{root}")
    system.create_dir(f"{base}/in", recursive=True)

    def drop(file, content):
        with system.open_output_stream(f"{base}/in/{file}") as out:
            out.write(content)

    return root, drop


def _one(rssd, day, *facts):
    return {f"FI {rssd}(ID RSSD) x.xml": report(*[(f"u:{c}", f"C_{day}", v) for c, v in facts])}


def test_a_name_with_two_dates_stays_in_its_own_quarter(spark):
    root, drop = _folder(spark, "two-dates")
    drop("20200331-a.zip", zip_of({**_one("1", "2020-03-31", ("UBPRE013", "1")), **_one("2", "2020-03-31", ("UBPRE013", "2"))}))
    drop("20200331-restated-20200630.zip", zip_of(_one("3", "2020-03-31", ("UBPRE013", "3"))))
    drop("20200630-a.zip", zip_of(_one("1", "2020-06-30", ("UBPRE013", "5"))))
    read = lambda: {(r.rssd_id, r.quarter_date, r.value_raw) for r in store.read_facts(spark, f"{root}/facts").collect()}
    incremental.ingest_new(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/cp", "2021-01-15")
    first = {("1", "20200331", "1"), ("2", "20200331", "2"), ("3", "20200331", "3"), ("1", "20200630", "5")}
    assert read() == first
    incremental.load_quarters(spark, f"{root}/in", f"{root}/facts", f"{root}/log", ["20200630"])
    assert read() == first


def test_stored_rows_outlive_their_staging(spark):
    root, drop = _folder(spark, "pruned")
    read = lambda: {(r.rssd_id, r.code, r.value_raw) for r in store.read_facts(spark, f"{root}/facts").collect()}
    run = lambda: incremental.ingest_new(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/cp", "2021-01-15")
    three = {k: v for i in "123" for k, v in _one(i, "2020-03-31", ("UBPRE013", i), ("UBPRE018", "8")).items()}
    drop("20200331-a.zip", zip_of(three))
    run()
    assert incremental.prune_staging(spark, f"{root}/facts", f"{root}/log") == ["20200331"]
    assert not store.path_exists(spark, f"{root}/facts__staged/quarter_date=20200331")
    # One institution is restated, with a code less; the others are kept from the store.
    drop("20200331-b.zip", zip_of(_one("2", "2020-03-31", ("UBPRE013", "9"))))
    run()
    kept = {(i, c, v) for i in "13" for c, v in (("UBPRE013", i), ("UBPRE018", "8"))}
    assert read() == kept | {("2", "UBPRE013", "9")}
    # A third archive, with all of it staged again; and the store's own rows are no archive in the log.
    drop("20200331-c.zip", zip_of(_one("3", "2020-03-31", ("UBPRE013", "7"))))
    run()
    assert read() == {("1", "UBPRE013", "1"), ("1", "UBPRE018", "8"), ("2", "UBPRE013", "9"), ("3", "UBPRE013", "7")}
    log = spark.read.schema(incremental.OUTCOMES).parquet(f"{root}/log")
    assert log.where("path = 'stored'").count() == 0


def test_rows_staged_twice_count_once(spark):
    archive = spark.createDataFrame([("a-20200331.zip", None, zip_of(_one("1", "2020-03-31", ("UBPRE013", "1"), ("UBPRE018", "2"))), "20200331")],
                                    "path string, modified timestamp, content binary, quarter_date string")
    rows = xbrl.parse_archives(archive)
    assert xbrl.archive_outcomes(rows.union(rows)).first().n_facts == 2
    assert str(xbrl.facts_of(rows)._jdf.queryExecution().executedPlan()).split("== Initial")[0].count("MapInPandas") == 2


def test_newest_archive_of_an_institution_wins_whole(spark):
    import datetime as dt

    old, new = dt.datetime(2020, 5, 1), dt.datetime(2020, 6, 1)
    archives = spark.createDataFrame([
        # The path text of the older one is the greater.
        ("z-20200331.zip", old, zip_of(_one("1", "2020-03-31", ("UBPRE013", "1"), ("UBPRE018", "8"))), "20200331"),
        ("a-20200331.zip", new, zip_of(_one("1", "2020-03-31", ("UBPRE013", "9"))), "20200331"),
        ("y-20200331.zip", old, zip_of(_one("2", "2020-03-31", ("UBPRE013", "7"))), "20200331"),
    ], "path string, modified timestamp, content binary, quarter_date string")
    facts = {(r.rssd_id, r.code, r.value_raw) for r in xbrl.facts_of(xbrl.parse_archives(archives)).collect()}
    assert facts == {("1", "UBPRE013", "9"), ("2", "UBPRE013", "7")}


def test_archive_without_a_quarter_is_logged(spark):
    root, drop = _folder(spark, "no-quarter")
    drop("restated.zip", zip_of(_one("1", "2020-03-31", ("UBPRE013", "1"))))
    incremental.ingest_new(spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/cp", "2021-01-15")
    rows = spark.read.schema(incremental.OUTCOMES).parquet(f"{root}/log").collect()
    assert [(r.outcome, r.path.endswith("restated.zip")) for r in rows] == [("failed", True)]


def test_budget_defers_and_a_later_run_takes_in(spark):
    from finfacts.plans import ingestion

    root, drop = _folder(spark, "budget")
    drop("20200331-a.zip", zip_of(_one("1", "2020-03-31", ("UBPRE013", "1"))))
    drop("20200630-a.zip", zip_of(_one("1", "2020-06-30", ("UBPRE013", "5"))))
    run = lambda gb, dry=False: ingestion.run(
        spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/runs", f"{root}/cp", "2021-01-15",
        budget_gb=gb, start_year=2020, dry_run=dry)
    stored = lambda: {r.quarter_date for r in store.read_facts(spark, f"{root}/facts").collect()}
    # The newest published quarter has no archive; it takes its share of the budget all the same.
    assert run(0.085, dry=True).where("decision = 'admitted'").count() == 2
    assert not store.path_exists(spark, f"{root}/runs")
    run(0.085)
    assert stored() == {"20200630"}
    assert store.last_run(spark, f"{root}/runs").first().deferred == ["20200331"]
    run(9.0)
    assert stored() == {"20200331", "20200630"}


def test_a_run_logs_what_its_writes_observed(spark):
    from finfacts.plans import ingestion

    root, drop = _folder(spark, "observed")
    run = lambda: ingestion.run(
        spark, f"{root}/in", f"{root}/facts", f"{root}/log", f"{root}/runs", f"{root}/cp", "2021-01-15", start_year=2020,
        max_files_per_trigger=1)
    seen = lambda: store.last_run(spark, f"{root}/runs").select("n_members", "n_facts", "rejects").first()
    drop("20200331-a.zip", zip_of({
        **_one("1", "2020-03-31", ("UBPRE013", "1"), ("UBPRE018", "2"), ("UBPRE013", "3")),
        "FI 2(ID RSSD) x.xml": "<broken", "summary.xml": "<none/>", "FI 3(ID RSSD) x.xml": report()}))
    drop("20200630-a.zip", zip_of(_one("1", "2020-06-30", ("UBPRE013", "5"))))
    drop("20200930-a.zip", b"no archive")
    drop("undated.zip", zip_of(_one("1", "2020-06-30", ("UBPRE013", "5"))))
    run()
    # Of the two facts of a code the later one is stored.
    assert tuple(seen()) == (2, 3, {
        "no_quarter": 1, "unreadable_archive": 1, "no_entity_id": 1, "malformed_xml": 1, "no_facts": 1})
    run()
    assert tuple(seen()) == (0, 0, {})
    # A restated quarter is written whole, with what it had before.
    drop("20200331-b.zip", zip_of(_one("4", "2020-03-31", ("UBPRE013", "9"))))
    run()
    assert tuple(seen()) == (1, 3, {})


def test_counts_of_an_empty_write(spark):
    empty = spark.createDataFrame([], "rssd_id string, quarter_date string, code string, value_raw string")
    assert store.write_quarters(empty, scratch_path(spark, "empty")) == 0


def test_an_old_run_log_is_still_read(spark):
    path = scratch_path(spark, "oldlog")
    spark.sql("SELECT timestamp'2020-01-01' AS run_ts, 'full' AS mode").write.parquet(path)
    assert store.last_run(spark, path).select("mode", "rejects").first() == ("full", None)


def test_a_run_log_that_cannot_be_written_fails_nothing(spark):
    import pytest

    with pytest.warns(UserWarning):
        assert store.append_run(spark, "nosuchscheme://x/runs", {"mode": "full"}) is False


def test_a_heavy_quarter_becomes_many_tasks(spark):
    from pyspark.sql import functions as F

    path = scratch_path(spark, "heavy")
    rows = spark.range(0, 400_000, 1, 32).select(
        F.col("id").cast("string").alias("rssd_id"), F.lit("20200331").alias("quarter_date"), F.lit("A").alias("code"),
        F.sha2(F.col("id").cast("string"), 256).alias("value_raw"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        store.write_quarters(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert store.inventory(spark, path).first().n_files > 8
    assert store.read_facts(spark, path).count() == 400_000


def test_long_and_unclosed_records_keep_every_field(spark):
    from finfacts.sources import sdf

    text = 'h\na;b;c;d;e;f;RC;1;nine;ten\n1;"x;y";"say ""hi""";\t4 \na;"b;c'
    rows = sdf.parse_documents(spark.createDataFrame([("d", text)], "id string, text string")).orderBy("source_line_number").collect()
    assert rows[0].columns == ["a", "b", "c", "d", "e", "f", "RC", "1", "nine", "ten"]
    assert rows[0].raw.endswith(";nine;ten")
    assert rows[1].columns == ["1", "x;y", 'say "hi"', "4", "", "", "", ""]
    assert rows[2].columns[:2] == ["a", "b;c"]


def test_filing_files_to_items(spark):
    from finfacts.sources import sdf

    root, drop = _folder(spark, "filing")
    drop("f.txt", b"header\n12/31/2020;42;RCFD2170;5;20210101;Total;RC;12\n")
    items = sdf.to_items(sdf.parse_documents(sdf.read_documents(spark, f"{root}/in"))).collect()
    assert [(r.rssd_id, r.item_code, r.value_raw, r.section) for r in items] == [("42", "RCFD2170", "5", "RC")]


def test_json_lists_over_several_lines(spark):
    from finfacts.sources import snapshots

    root, drop = _folder(spark, "snapshots")
    drop("panel.json", b'[\n {"ID_RSSD": 1, "Name": " A "},\n {"ID_RSSD": 2,\n  "Name": "B"}\n]\n')
    drop("more.json", b'{"ID_RSSD": 3, "Name": "C"}\n{"ID_RSSD": 4, "Name": "D"}\n')
    assert {(r.rssd_id, r.name) for r in snapshots.read_institutions(spark, f"{root}/in").collect()} == {
        ("1", "A"), ("2", "B"), ("3", "C"), ("4", "D")}
    root, drop = _folder(spark, "periods")
    drop("p.json", b'[\n "12/31/2025",\n "09/30/2025"\n]')
    drop("broken.json", b"[nothing")
    assert {r.quarter_date for r in snapshots.read_periods(spark, f"{root}/in").collect()} == {"20251231", "20250930"}
    assert [r.path.endswith("broken.json") for r in snapshots.unreadable(spark, f"{root}/in").collect()] == [True]


def test_a_broken_line_loses_no_other(spark):
    from finfacts.sources import snapshots

    root, drop = _folder(spark, "brokenlines")
    drop("lines.json", b'{"ID_RSSD": 1, "Name": "A"}\r\n{"ID_RSSD": 2, "Na\n\n{"ID_RSSD": 3, "Name": "C"}\n')
    drop("open.json", b'[\n{"ID_RSSD": 4, "Name": "D"},\n{"ID_RSSD": 5, "Na\n')
    drop("lists.json", b'[{"ID_RSSD": 6, "Name": "F"}]\n[{"ID_RSSD": 7\n[{"ID_RSSD": 8, "Name": "H"}]\n')
    assert sorted((r.rssd_id, r.name) for r in snapshots.read_institutions(spark, f"{root}/in").collect()) == [
        ("1", "A"), ("3", "C"), ("4", "D"), ("6", "F"), ("8", "H")]
    bad = {r.path.rsplit("/", 1)[1]: r.n_lines for r in snapshots.unreadable(spark, f"{root}/in", "struct<ID_RSSD:bigint>").collect()}
    assert bad == {"lines.json": 1, "open.json": 2, "lists.json": 1}
    root, drop = _folder(spark, "periodlines")
    drop("p.json", b'["12/31/2025", "no date"]\n["09/30/2025",\n["06/30/2025"]\n')
    assert sorted((r.pos, r.quarter_date) for r in snapshots.read_periods(spark, f"{root}/in").collect()) == [
        (0, "20251231"), (2, "20250630")]


def test_one_very_large_value_spoils_no_average(facts_of):
    from finfacts.operators import facts as fx, peers

    facts = facts_of([("1", "20200331", "UBPRE013", "1e30"), ("2", "20200331", "UBPRE013", "2"), ("3", "20200331", "UBPRE013", "4")])
    rows = {r.rssd_id: r.peer_average for r in peers.leave_one_out(facts, ["UBPRE013"], groups=["all"]).collect()}
    assert rows == {"1": 3.0, "2": 5e29, "3": 5e29}
    assert fx.castable_average(facts, ["code"]).first().avg_value == 1e30 / 3


def test_large_values_and_long_years_print_whole(spark):
    from pyspark.sql import functions as F

    from finfacts.functions import numeric as num, periods as per

    row = spark.range(1).select(
        num.percent_text(F.lit(1e20)).alias("p"), num.grouped_text(F.lit(1e20)).alias("g"),
        num.grouped_text(F.lit(1234.5)).alias("h"), per.quarter_key(F.lit(12345), F.lit(1)).alias("k")).first()
    assert (row.p, row.g, row.h, row.k) == (
        "100000000000000000000.00%", "100,000,000,000,000,000,000", "1,234.5", "123450331")


def test_workers_need_no_package(spark, tmp_path):
    """Functions travel by value: a worker that cannot import the package still runs them."""
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent("""
        import sys
        sys.path.insert(0, %r)
        from finfacts.session import build_session
        from finfacts.checks.catalog import QUERIES
        spark = build_session("elsewhere", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
        print("ROWS", QUERIES["src04_xbrl_roundtrip"](spark, "/root/testdata/sf0.001").count())
    """) % sys.path[0]
    found = [p for p in sys.path if p.endswith("repo")] or sys.path[:1]
    code = code.replace(repr(sys.path[0]), repr(found[0]))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
