"""One small literal case for each easily mistaken rule."""

from pyspark.sql import functions as F

from finfacts.functions import numeric as num, periods as per, text as txt
from finfacts.operators import facts as fx, items as it, lifecycle as life, peers, questions as qn, ranking, ratios, trends
from finfacts.operators.facts import CELL
from finfacts.reference_data import RULE_CHANGES


def column(spark, values, expr, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expr("x")).collect()]


def test_ratio_texts(spark):
    texts = ["0", "0000", "0.0", "00", "", "None", "nan", "NaN", "null", " 12 ", "n/a", "1,234", "1e3", "inf", None]
    assert column(spark, texts, num.is_ratio) == [
        False, False, True, True, False, False, False, False, False, True, False, False, True, False, False
    ]


def test_number_parsers(spark):
    texts = ["1d", "1_000", " 12 ", "14.5%", "1,234", "12abc", ".5", "-", None, "inf"]
    assert column(spark, texts, num.strict_number) == [None, None, 12.0, None, None, None, 0.5, None, None, None]
    assert column(spark, texts, num.lenient_number) == [None, None, 12.0, 14.5, 1234.0, None, 0.5, None, None, None]
    assert column(spark, texts, num.prefix_number) == [1.0, 1.0, 12.0, 14.5, 1.0, 12.0, 0.5, None, None, None]


def test_number_texts(spark):
    values = [0.125, -0.125, -0.001, 1234.5, 999999.999, 2.5e6, 3e9, 4.25e12, None]
    assert column(spark, values, num.money_text, "double") == [
        "$0.13", "$-0.13", "$-0.00", "$1234.50", "$1000000.00", "$2.50M", "$3.00B", "$4.25T", "-"
    ]
    assert column(spark, [2.5, 3.5, 1234567.0, 12345.0, None], num.money_tool_text, "double") == [
        "$2", "$4", "$1.23M", "$12,345", "N/A"
    ]
    assert column(spark, [1234.5678, 1000.0, -0.0001, 0.5], num.grouped_text, "double") == ["1,234.568", "1,000", "0", "0.5"]


def test_zero_denominator_is_null(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (1.0, None), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in frame.select(num.safe_divide(F.col("a"), F.col("b"))).collect()] == [None, None, 2.0]


def test_schedules(spark):
    texts = ["RC", "RCB", "RC-C", "RCCI", "rcc", "RI", "RIA", " ri ", "", None, "SU"]
    assert column(spark, texts, txt.normalize_schedule) == [
        "RC", "RC", "RC", "RC-C", "RC-C", "RI", "RIA", "RI", None, None, "SU"
    ]


def test_period_texts(spark):
    as_of = "2025-02-10"
    texts = ["Q3 2024", "last quarter", "this quarter", "last year", "market share", "2023", "", "third of 2022"]
    got = column(spark, texts, lambda c: qn.resolved_period(c, as_of)["quarter_date"])
    assert got == ["20240930", "20241231", "20250331", "20241231", "20250331", "20231231", "20250331", "20220930"]


def test_nearest_period_prefers_first_listed(spark):
    available = F.array(F.lit("06/30/2024"), F.lit("12/31/2024"), F.lit("03/31/2023"))
    got = column(spark, ["09/30/2024", "12/31/2024", "01/31/2022"], lambda c: per.nearest_period(F.col(c), available))
    # 92 days either side of 30 September: the first listed of the two wins.
    assert got == ["06/30/2024", "12/31/2024", "03/31/2023"]


def test_nine_quarters_in_two_year_bound(spark):
    assert column(spark, ["20251231"], per.two_years_back) == ["20231201"]
    assert len([k for k in per.quarter_keys("20230331", "20251231") if "20231201" <= k <= "20251231"]) == 9


def test_calendar_lags(spark):
    keys = lambda df: [r[0] for r in df.select("quarter_date").orderBy("quarter_date").collect()]
    assert keys(per.quarter_calendar(spark, "2002-02-01", 2001, 2)) == ["20010331", "20010630", "20010930"]
    assert keys(per.recent_calendar(spark, "2002-02-01", 3, 1)) == ["20010630", "20010930", "20011231"]
    assert keys(per.quarter_calendar(spark, "2001-02-01", 2001, 2)) == []


def test_question_rules(spark):
    route = lambda c: qn.route(c, F.lit(None).cast("string"))
    assert column(spark, ["explain CET1", "define liquidness ", "tell me a joke about assets", "hello"], route) == [
        "data", "knowledge", "out_of_scope", "knowledge"
    ]
    codes = column(spark, ["UBPR7414 please", "tier 1 capital ratio", "minimum", "nothing"], qn.metric_code)
    assert codes == ["UBPR7414", "UBPRD487", "UBPRE018", None]
    assert column(spark, ["large community", "small mid", "mid", "x"], qn.peer_group_hint) == ["large", "community", "mid", "all"]


def test_question_word_boundaries(spark):
    route = lambda c: qn.route(c, F.lit(None).cast("string"), word_boundary=True)
    assert column(spark, ["a broad minimum", "what is the nim"], route) == ["knowledge", "data"]


def test_rule_change_bounds(spark):
    spans = spark.createDataFrame(
        [("20191231", "20200331"), ("20200101", "20200331"), ("20201231", "20141231"), ("20141231", "20150101")],
        "a string, b string",
    )
    got = [r["rule_label"] for r in trends.first_rule_change(spans, RULE_CHANGES, "a", "b").collect()]
    assert got == ["CECL adopted", None, "CECL adopted", "Basel III effective"]


def test_zero_counts_for_peers_but_not_for_the_bank(facts_of):
    q = "20200331"
    rows = peers.leave_one_out(
        facts_of([("1", q, "UBPRE013", "2"), ("2", q, "UBPRE013", "0"), ("3", q, "UBPRE013", "n/a"), ("4", q, "UBPRE013", "4")])
    ).where("peer_group = 'all'")
    assert {r["rssd_id"]: (r["n_peers"], r["peer_average"]) for r in rows.collect()} == {"1": (2, 2.0), "4": (2, 1.0)}


def test_lonely_bank_has_null_average(facts_of):
    rows = peers.leave_one_out(facts_of([("1", "20200331", "UBPRE013", "2")])).where("peer_group = 'all'").collect()
    assert [(r["n_peers"], r["peer_average"]) for r in rows] == [(0, None)]


def test_peer_buckets_overlap_and_unknown_size(facts_of):
    q = "20200331"
    rows = peers.size_groups(facts_of([("1", q, "UBPR2170", "5e8"), ("2", q, "UBPR2170", "x"), ("3", q, "UBPR2170", "2e11")])).collect()
    got = {}
    for r in rows:
        got.setdefault(r["rssd_id"], set()).add(r["peer_group"])
    assert got == {"1": {"all", "size:community", "size:small"}, "2": {"all"}, "3": {"all", "size:large"}}


def test_peer_group_names():
    assert peers.peer_group("large") == peers.peer_group("size:large") == "size:large"
    try:
        peers.peer_group("huge")
        raise AssertionError("unknown group accepted")
    except ValueError:
        pass


def test_first_and_last_occurrence(spark):
    items = spark.createDataFrame(
        [("1", "03/31/2020", 2, "rcfd2170 ", ""), ("1", "03/31/2020", 3, "RCFD2170", "7"), ("1", "03/31/2020", 4, "RCON2170", "5")],
        "rssd_id string, reporting_period string, ord int, item_code string, value_raw string",
    )
    firsts = {r["item_code"]: r["value_raw"] for r in it.first_values(items).collect()}
    assert firsts == {"RCFD2170": "", "RCON2170": "5"}
    lasts = {r["item_code"]: r["value_raw"] for r in it.last_values(items).collect()}
    assert lasts == {"rcfd2170 ": "", "RCFD2170": "7", "RCON2170": "5"}
    # A blank first occurrence makes the next variant, not the next occurrence, count.
    assert it.metrics(items).first()["total_assets"] == 5.0


def test_metrics_missing_and_zero(spark):
    items = spark.createDataFrame(
        [("1", "p", 2, "RCFD2170", "0"), ("1", "p", 3, "RCFD3210", "4"), ("1", "p", 4, "RCON1460", "1,5")],
        "rssd_id string, reporting_period string, ord int, item_code string, value_raw string",
    )
    row = it.metrics(items).first()
    assert (row["total_assets"], row["equity_to_assets"], row["total_loans"]) == (0.0, None, None)
    assert (row["residential_total"], row["residential_ratio"], row["total_rows"]) == (15.0, None, 3)


def test_summary_pick_takes_next_code(facts_of):
    q = "20200331"
    picks = ranking.summary_picks(facts_of([
        ("1", q, "UBPRR031", "0000"), ("1", q, "UBPRD487", "11"), ("1", q, "UBPR7400", "12"), ("1", q, "UBPRE012", "1"),
    ])).collect()
    assert sorted((r["group_ord"], r["code"], r["value_num"]) for r in picks) == [(1, "UBPRD487", 11.0), (5, "UBPRE012", 1.0)]


def test_change_skips_texts_and_gaps(facts_of):
    rows = trends.quarter_change(facts_of([
        ("1", "20200331", "C", "1"), ("1", "20200630", "C", "n/a"), ("1", "20200930", "C", "4"),
    ])).orderBy("quarter_date").collect()
    assert [(r["quarter_date"], r["change"]) for r in rows] == [("20200331", None), ("20200930", 3.0)]


def test_custom_ratio_errors_stay(facts_of):
    q = "20200331"
    rows = ratios.custom_ratios(
        facts_of([("1", q, "UBPRE013", "1.5"), ("2", q, "UBPRE013", "3"), ("2", q, "DEN", "0")]),
        [ratios.RatioDef("r", "UBPRE013", "DEN"), ratios.RatioDef("alone", "UBPRE013")],
    ).collect()
    got = {(r["rssd_id"], r["label"]): (r["raw"], r["display"], r["error"]) for r in rows}
    assert got[("1", "r")] == got[("2", "r")] == (None, None, "denominator is zero or not found")
    assert got[("1", "alone")] == (1.5, "1.50%", None)


def test_long_wide_long_is_identity(facts_of):
    rows = [("1", "20200331", "A", "1"), ("1", "20200331", "B", ""), ("2", "20200331", "B", "x")]
    facts = facts_of(rows)
    back = fx.long(fx.wide(facts, ["A", "B", "Z"]), ["A", "B", "Z"])
    assert sorted((r["rssd_id"], r["quarter_date"], r["code"], r["value_raw"]) for r in back.collect()) == sorted(rows)


def test_budget_stops_and_never_resumes(spark):
    gb = 1024**3
    plan = spark.createDataFrame([("20200331", gb), ("20200630", gb), ("20200930", gb)], "quarter_date string, bytes bigint")
    got = {r["quarter_date"]: r["decision"] for r in life.admit(plan, budget_gb=1.04).collect()}
    assert got == {"20200930": "admitted", "20200630": "deferred", "20200331": "deferred"}


def test_skewed_bank_equals_brute_force(spark, facts_of):
    """A third of all rows belong to one quarter and one bank is far larger than the rest."""
    import random

    rng = random.Random(7)
    rows = [(str(b), "20200331", "UBPRE013", str(round(rng.uniform(0, 5), 4))) for b in range(120)]
    rows += [(str(b), f"{y}1231", "UBPRE013", str(round(rng.uniform(0, 5), 4))) for y in range(2000, 2019) for b in range(10)]
    rows += [("7", f"{y}0630", "UBPRE013", "1e6") for y in range(1950, 2019)]
    got = {
        (r["rssd_id"], r["quarter_date"]): r["peer_average"]
        for r in peers.leave_one_out(facts_of(rows)).where("peer_group = 'all'").collect()
    }
    assert len(got) == len(rows)
    for bank, quarter, _, _ in rows:
        others = [float(v) for b, q, _, v in rows if q == quarter and b != bank]
        want = sum(others) / len(others) if others else None
        have = got[(bank, quarter)]
        assert (want is None and have is None) or abs(want - have) < 1e-6
    assert CELL == ["rssd_id", "quarter_date"]
