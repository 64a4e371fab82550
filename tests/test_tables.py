"""Operators whose terms, bands, rules, definitions and keywords are tables."""

import random
from bisect import bisect_right
from datetime import date

import pytest
from pyspark.sql import functions as F

from finfacts.functions.phrases import Matcher, pattern
from finfacts.operators import asof, facts as fx, intervals, questions as qn, ratios, terms
from finfacts.sources.panel import facts, line_items


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def no_pairs(frame):
    text = plan(frame)
    return "CartesianProduct" not in text and "NestedLoopJoin" not in text and "BatchEvalPython" not in text


# ---------------------------------------------------------------- terms

def test_hundred_thousand_terms_against_all_items(spark, sf_dir):
    rng = random.Random(1)
    listed = {str(rng.randrange(10 ** rng.randrange(2, 7))) for _ in range(140_000)}
    listed = sorted(listed)[:100_000] + ["", " ", "%", "rc", " NET ", "Total assets", "no such text"]
    found = terms.search_table(line_items(spark, sf_dir), spark.createDataFrame([(t,) for t in listed], "term string"))
    assert no_pairs(found)
    needles = {}
    for t in listed:
        needles.setdefault(t.strip(" ").lower(), []).append(t)
    want = 0
    items = line_items(spark, sf_dir).select("item_code", "description", "value_raw").collect()
    for r in items:
        texts = {x.lower() for x in r}
        subs = {t[i:j] for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)} | {""}
        want += sum(len(needles.get(s, ())) for s in subs)
    assert found.count() == want > 10 * len(items)


def test_terms_with_nulls_repeats_and_short_ones(spark):
    rows = spark.createDataFrame([(1, "abab", None), (2, None, None), (3, "", "x"), (4, "ab", "ABC"), (4, "ab", "ABC")],
                                 "id int, a string, b string")
    asked = spark.createDataFrame([("ab",), ("ab",), ("",), (None,), ("a",), ("aba",), ("zz",), ("bab",)], "term string")
    got = sorted(tuple(r) for r in terms.contains_join(rows, [F.col("a"), F.col("b")], asked, F.col("term")).select("id", "term").collect())
    want = sorted((r.id, t.term) for r in rows.collect() for t in asked.collect()
                  if t.term is not None and any(x is not None and t.term in x for x in (r.a, r.b)))
    assert got == want
    empty = asked.where("false")
    assert terms.contains_join(rows, [F.col("a")], empty, F.col("term")).count() == 0
    assert terms.contains_join(rows.where("false"), [F.col("a")], asked, F.col("term")).count() == 0


# ---------------------------------------------------------------- bands

def bands_by_hand(values, bands, low_closed, high_closed):
    out = []
    for v in values:
        for b, lo, hi in bands:
            if v is None:
                continue
            above = lo is None or (v >= lo if low_closed else v > lo)
            below = hi is None or (v <= hi if high_closed else v < hi)
            if above and below and not (lo is not None and hi is not None and lo > hi):
                out.append((v, b))
    return sorted(out)


@pytest.mark.parametrize("low_closed,high_closed", [(True, True), (True, False), (False, True), (False, False)])
@pytest.mark.parametrize("max_bounds", [intervals.MAX_BOUNDS, 7])
def test_bands_with_any_ends(spark, low_closed, high_closed, max_bounds):
    rng = random.Random(5)
    pick = lambda: None if rng.random() < 0.05 else rng.randrange(40) / 4
    bands = [(i, pick(), pick()) for i in range(60)]
    values = [None, -1.0, 99.0, *[rng.randrange(88) / 8 for _ in range(60)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = intervals.band_join(rows, F.col("v"), spark.createDataFrame(bands, "band int, lo double, hi double"),
                                low_closed=low_closed, high_closed=high_closed, max_bounds=max_bounds)
    assert sorted((r.v, r.band) for r in found.collect()) == bands_by_hand(values, bands, low_closed, high_closed)


def test_ten_thousand_overlapping_bands(spark):
    rng = random.Random(2)
    bands = []
    for i in range(10_000):
        lo = rng.random() * 1000
        bands.append((i, lo, lo + rng.random() ** 8 * 1000))
    values = [rng.random() * 1000 for _ in range(200)] + [bands[0][1], bands[1][2]]
    found = intervals.band_join(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"),
                                spark.createDataFrame(bands, "band int, lo double, hi double"))
    assert no_pairs(found)
    assert sorted((r.v, r.band) for r in found.collect()) == bands_by_hand(values, bands, True, True)


def test_bands_without_bounds_or_rows(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    one = lambda *b: spark.createDataFrame([b], "band int, lo double, hi double")
    count = lambda b: intervals.band_join(rows, F.col("v"), b).count()
    assert count(one(1, None, None)) == 1 and count(one(1, 5.0, 2.0)) == 0 and count(one(1, float("nan"), 2.0)) == 0
    assert count(one(1, 1.0, 1.0)) == 1 and count(one(1, 1.0, 1.0).where("false")) == 0


def test_nested_size_bands_move_each_value_once(spark, monkeypatch):
    # Wide bands around one another, some open: each would stand in most blocks, so the blocks must get wider.
    rng = random.Random(7)
    bands = []
    for i in range(600):
        low = rng.choice([None, rng.random() * 500])
        bands.append((i, low, rng.choice([None, (low or 0) + rng.random() * 900])))
    values = [rng.random() * 1200 for _ in range(300)]
    frame = spark.createDataFrame(bands, "band int, lo double, hi double")
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = intervals.band_join(rows, F.col("v"), frame, high_closed=False)
    # The values' side of the join has no rows made from rows; only the bands are laid out.
    assert plan(found).count("Generate explode(") == 1 and no_pairs(found)
    assert sorted((r.v, r.band) for r in found.collect()) == bands_by_hand(values, bands, True, False)
    monkeypatch.setattr(intervals, "PLACES", 0)
    fences = intervals._fences(frame.select(F.col("lo").alias("__low"), F.col("hi").alias("__high")), 25_000)
    block = lambda x: bisect_right(fences, x)
    places = sum((len(fences) if hi is None else block(hi)) - (0 if lo is None else block(lo)) + 1 for _, lo, hi in bands)
    assert len(fences) > 5 and places < 10 * len(bands)
    found = intervals.band_join(rows, F.col("v"), frame, high_closed=False)
    assert sorted((r.v, r.band) for r in found.collect()) == bands_by_hand(values, bands, True, False)


def test_values_at_the_edges_of_narrow_bands(spark):
    # Ties, both zeros, infinite values and bounds, values beyond all bounds; each fact goes to one block.
    inf = float("inf")
    bands = [(i, i / 100, i / 100 + i % 5 / 500) for i in range(400)]
    bands += [(900, -0.0, -0.0), (901, None, 0.0), (902, 3.5, None), (903, -inf, -1.0), (904, 2.0, inf), (905, inf, inf),
              (906, 5.0, 4.0), (907, float("nan"), 9.0), (908, 1.0, 1.0), (908, 1.0, 1.0), (909, None, None)]
    values = [None, 0.0, -0.0, inf, -inf, -5.0, 99.0, 1.0, 1.0, 4.0, *[i / 250 for i in range(0, 1100, 3)]]
    facts_ = spark.createDataFrame([("a", v) for v in [*values, float("nan")]], "code string, value_num double")
    found = fx.values_in_bands(facts_, spark.createDataFrame(bands, "band int, lo double, hi double"))
    assert plan(found).count("Generate explode(") == 1 and no_pairs(found)
    sound = [b for b in bands if b[1] is None or b[1] == b[1]]
    assert sorted((r.value_num, r.band) for r in found.collect()) == bands_by_hand(values, sound, True, True)


# ---------------------------------------------------------------- rules and dates

def test_rules_by_code_and_for_all(spark):
    rng = random.Random(3)
    day = lambda: f"{rng.randrange(1990, 2003)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
    rows = [(i, rng.choice("abc"), day(), rng.choice([day(), None])) for i in range(120)]
    rules = [(i, rng.choice(["a", "b", None]), day()) for i in range(80)]
    left = spark.createDataFrame(rows, "id int, code string, s string, e string")
    right = spark.createDataFrame(rules, "place int, code string, d string")
    inside = lambda r, x: (r[3] is not None and x[1] in (r[1], None)
                           and min(r[2], r[3]) < x[2] <= max(r[2], r[3]))
    want = sorted((r[0], x[0]) for r in rows for x in rules if inside(r, x))
    found = intervals.dates_inside(left, "s", "e", right, "d", "code")
    assert sorted((r.id, r.place) for r in found.collect()) == want and no_pairs(found)
    first = intervals.first_date_inside(left, ["id"], "s", "e", right, "d", "place", "code").collect()
    assert {r.id: r.place for r in first} == {r[0]: min((p for i, p in want if i == r[0]), default=None) for r in rows}


def test_nearest_filing_of_each_institution(spark):
    rng = random.Random(4)
    day = lambda: f"{rng.randrange(1995, 2003)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
    # A third of all requests name one institution; another one never files; some days are filed and asked.
    filed = sorted({(rng.choice("ab"), day()) for _ in range(40)})
    asked = [("a" if i % 3 == 0 else rng.choice(["b", "c", None]), rng.choice([day(), filed[i % 40][1]])) for i in range(600)]
    asked += [("a", None), ("a", "no date")]
    found = asof.nearest_filing(spark.createDataFrame(asked, "bank string, d string"),
                                spark.createDataFrame(filed, "bank string, f string"), ["bank"], "d", "f")
    assert no_pairs(found)
    to = lambda t: date(int(t[:4]), int(t[4:6]), int(t[6:]))

    def by_hand(bank, d):
        own = [f for b, f in filed if b == bank]
        if not own or d is None or not d.isdigit():
            return None, None
        best = min(own, key=lambda f: (abs((to(f) - to(d)).days), -int(f)))
        return best, (to(best) - to(d)).days

    key = lambda r: tuple(map(str, r))
    want = sorted(((b, d, *by_hand(b, d)) for b, d in asked), key=key)
    assert sorted(map(tuple, found.select("bank", "d", "nearest", "gap_days").collect()), key=key) == want


# ---------------------------------------------------------------- definitions

def saved(rows, spark):
    return spark.createDataFrame(rows, "label string, numerator string, denominator string, scale string")


def test_saved_definitions_equal_listed_ones(spark, sf_dir):
    rows = [("a", "UBPR7414", "UBPR2170", "percent"), ("b", " UBPRE013 ", None, "percent"), ("c", "UBPR2170", "UBPRE600", "dollar"),
            ("d", "UBPRZZZZ", "UBPRE013", "raw"), ("e", "UBPRD488", "  ", "raw"), ("f", "x;", "UBPRE013", "raw")]
    listed = ratios.custom_ratios(facts(spark, sf_dir), [ratios.RatioDef(*r) for r in rows])
    key = lambda r: tuple(map(str, r))
    for block in (1000, 2):
        found = ratios.saved_ratios(facts(spark, sf_dir), saved(rows, spark), block)
        assert sorted(map(key, found.select(*listed.columns).collect())) == sorted(map(key, listed.collect()))


def test_five_thousand_definitions_in_one_plan(spark, facts_of):
    cells = facts_of([("1", "20001231", "A1", "4"), ("1", "20001231", "A1", "3"), ("1", "20001231", "A2", "8"),
                      ("2", "20001231", "B9", "1"), ("2", "20001231", "A2", "0")])
    make = lambda n: saved([(f"d{i}", f"A{i % 9}", f"A{i % 7}" if i % 2 else None, "raw") for i in range(n)], spark)
    few, many = ratios.saved_ratios(cells, make(5)), ratios.saved_ratios(cells, make(5000))
    assert len(plan(many).splitlines()) == len(plan(few).splitlines()) and no_pairs(many)
    rows = many.collect()
    assert len(rows) == 10_000
    got = {(r.rssd_id, r.label): (r.raw, r.error) for r in rows}
    assert got["1", "d1"] == (1.0, None) and got["1", "d10"] == (4.0, None)
    assert got["1", "d29"] == (8.0 / 4.0, None) and got["2", "d29"] == (None, "denominator is zero or not found")
    assert got["2", "d1"] == (None, "numerator not found")
    assert ratios.saved_ratios(cells, make(5).where("false")).count() == 0


# ---------------------------------------------------------------- phrases

@pytest.mark.parametrize("seed", range(3))
def test_one_pass_equals_contains(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab.(") for _ in range(rng.randrange(1, n)))
    phrases = [word(5) for _ in range(25)]
    first, second = phrases[:8], phrases[8:]
    texts = [word(14) for _ in range(200)] + ["", None]
    matcher = Matcher(first, second)
    ranks = {p: i for i, p in enumerate(dict.fromkeys(second))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matcher.over(F.upper("t"), lambda h: F.struct(
        matcher.any_of(h, first).alias("a"), matcher.least(h, ranks).alias("b"))).alias("x")).collect()
    for r in rows:
        if r.t is not None:
            assert r.x.a == any(p in r.t for p in first), (r.t, pattern(matcher.phrases))
            assert r.x.b == min((i for p, i in ranks.items() if p in r.t), default=None)


def test_keywords_from_a_table(spark):
    asked = spark.createDataFrame([("Peers of BANK 12",), ("bank 1?",), ("none",), (None,)], "question string")
    words = spark.createDataFrame(
        [("t", "two", 2, "bank 1"), ("t", "one", 1, "BANK 12"), ("u", "x", 1, "peer"), ("u", "y", 1, ""), ("u", None, 0, "bank")],
        "topic string, class string, priority int, phrase string")
    got = [(r.t, r.u) for r in qn.classify(asked, words).collect()]
    assert got == [("one", "x"), ("two", None), (None, None), (None, None)]
    assert qn.classify(asked, words.where("false")).columns == ["question"]


def test_question_is_read_once(spark):
    asked = spark.createDataFrame([("q", "1")], "question string, rssd_id string")
    for column in (qn.route("question", F.col("rssd_id")), qn.action("question", F.col("rssd_id"), F.lit("a"), F.lit("b"))):
        optimized = asked.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("(?=(") == 1 and "Contains(" not in optimized


# ---------------------------------------------------------------- tools called from SQL

def test_arguments_of_sql_tools_reach_the_scan(spark, sf_dir):
    from finfacts.plans import sqltools, tools
    from finfacts.session import scratch_path
    from finfacts.sources import store

    path = scratch_path(spark, "tools")
    store.write_quarters(facts(spark, sf_dir), path)
    stored = store.read_facts(spark, path)
    assert len(sqltools.register(spark, stored)) == 4
    calls = {
        "get_ubpr_ratios('3', '19981231')": tools.get_ubpr_ratios(stored, "3", "19981231"),
        "get_ubpr_trend('UBPRE013', '19991231', '19980331', '3')": tools.get_ubpr_trend(stored, "19980331", "19991231", "UBPRE013", "3"),
        "flag_regulatory_issues(for_bank => '3')": tools.flag_regulatory_issues(stored, "3"),
    }
    for call, same in calls.items():
        found = spark.sql(f"SELECT * FROM {call}")
        text = plan(found)
        assert "EqualTo(rssd_id,3)" in text, call
        assert ("quarter" in text.split("PartitionFilters: [")[1].split("]")[0]) == ("1998" in call)
        assert sorted(map(str, found.collect())) == sorted(map(str, same.select(*found.columns).collect())) != []
    # One quarter's peers are all read; only the own rows are the bank's.
    peer = plan(spark.sql("SELECT * FROM get_peer_comparison('all', '3', '19981231')"))
    assert all("quarter" in part.split("]")[0] for part in peer.split("PartitionFilters: [")[1:])


def test_measures_and_cells_from_one_scan(spark, sf_dir):
    from finfacts.checks.catalog import QUERIES

    for name in ("rep07_metrics", "rep06_defs", "prj06_size_bucket", "rep06_saved"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("lineitem.parquet") == 1, name


# ---------------------------------------------------------------- wide reports

def test_ten_thousand_columns_as_csv(spark):
    from finfacts.operators import wide_report
    from finfacts.session import scratch_path

    # 400 banks by 25 periods; one code of a bank's own leaves wide gaps, one bank shares its name, texts need quoting.
    items = spark.range(10_000).selectExpr(
        "cast(id % 400 as string) AS rssd_id", "concat('12/31/', 2000 + id div 400) AS reporting_period", "id AS ord",
        "explode(array('A', concat('B', id % 400 % 7))) AS item_code", "concat('say \"', id, '\", x') AS value_raw",
        "'text, with comma' AS description", "'RC' AS section")
    banks = spark.range(400).selectExpr("cast(id as string) AS rssd_id", "if(id < 2, 'Same', concat('Bank ', id)) AS name")
    lines = wide_report.report_lines(items, banks, shard_columns=1500)
    path = scratch_path(spark, "wide")
    wide_report.write_report(lines, path)
    tables = [wide_report.read_shard(spark, path, k) for k in range(7)]
    headers = [t.columns for t in tables]
    assert all(h[:3] == ["section", "item_code", "description"] for h in headers)
    columns = [c for h in headers for c in h[3:]]
    assert len(columns) == len(set(columns)) == 10_000 and [len(h) for h in headers] == [1503] * 6 + [1003]
    assert columns[:2] == ["Bank 10 · 12/31/2000", "Bank 10 · 12/31/2001"] and "Same (1) · 12/31/2000" in columns
    found = {}
    for t in tables:
        for r in t.collect():
            found.setdefault(r.item_code, {}).update({c: r[c] for c in t.columns[3:]})
    assert sorted(found) == ["A", *[f"B{i}" for i in range(7)]]
    for i in range(0, 10_000, 37):
        bank, period = i % 400, f"12/31/{2000 + i // 400}"
        name = f"Same ({bank})" if bank < 2 else f"Bank {bank}"
        assert found["A"][f"{name} · {period}"] == f'say "{i}", x'
        assert found[f"B{bank % 7}"][f"{name} · {period}"] == f'say "{i}", x' and found[f"B{(bank + 1) % 7}"][f"{name} · {period}"] == "-"
    assert wide_report.report_lines(items.where("false"), banks).count() == 0
