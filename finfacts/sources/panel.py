"""Views of a star-schema order warehouse as bank filings.

Suppliers stand in for institutions and ship quarters for filing quarters. The
same views feed every registered query, so all of them scale with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finfacts.functions.numeric import round_half_up, strict_number
from finfacts.functions.periods import (
    day_key, index_to_key, key_to_period, quarter_end, quarter_index, quarter_label, quarter_period,
)

# Asset-size buckets scaled to the panel's price sums, [low, high).
PANEL_BUCKETS = [
    ("size:large", 1_500_000.0, None),
    ("size:mid", 1_200_000.0, 1_500_000.0),
    ("size:community", None, 1_200_000.0),
    ("size:small", None, 900_000.0),
]
PANEL_CODES = [
    "UBPR2170", "UBPRE013", "UBPRE018", "UBPRD487", "UBPRD486",
    "UBPRD488", "UBPR7308", "UBPR7414", "UBPRE600",
]
# Line-item codes by position; a few are lower case, padded, unknown or blank on purpose.
ITEM_CODES = [
    "RCFD2170", "RCON2170", "RCOA2170", "RCFD3368", "RCFD2122", "RCON2122", "RCFD1400",
    "RCON1400", "RCON1797", "RCFD1797", "RCON1460", "RCFD1460", "RCON1410", "RCFD1410",
    "RCFD1415", "RCON1415", "RCFD3210", "RCON3210", "RIAD4340", "RCFD2200", "RCON2200",
    "rcfd2170 ", " rcon2200", "RCFD9999", "",
]
ITEM_SCHEDULES = ["RC", "RCB", "RCCI", "RC-C", "RI", "RIA", ""]
ITEM_TEXTS = [
    "Total assets, consolidated", 'Loans; "net" of allowance', "Deposits in domestic offices",
    "Equity capital", "Net income", "Interest-bearing balances due from depository institutions",
    "Securities",
]
# Question templates, marks are filled from the panel: each keyword class of the router alone, several classes in
# one text, keywords inside other words, and texts with none.
QUESTION_TEMPLATES = [
    "",
    "hello",
    "thanks, that was all",
    "{id}",
    "{code}",
    "{code}, {code} and UBPRE013 please",
    "Is bank {id} undercapitalized or merely adequate",
    "tier one buffer of {name} at {q}",
    "leverage and CET1 side by side, {q0} and {q}",
    "regulatory alerts for {id}",
    "which thresholds does {name} miss",
    "return on equity, {name}",
    "margin and ROA in one table for {q}",
    "earnings looked thin in {q0}, what about profitability",
    "{name} against its peers",
    "rank all large banks by {code}",
    "peer average of {code} for mid-size institutions",
    "small and community and large in one benchmark",
    "industry percentile of {id}",
    "bad loans: NPL of {name}",
    "charge-off rate, then allowance, then NPL",
    "trend of {code} since {q0}",
    "{code} history, eight quarters up to {q}",
    "has leverage moved over time at {name}",
    "quarter over quarter change of UBPR7414",
    "deposits and loans of {id} on the balance sheet",
    "total assets, total equity",
    "net income line of the income statement {q}",
    "open the call report of {id}, {q}",
    "latest filing on record",
    "filing for March {y} against the one for June {y}",
    "schedule RI, then Schedule RC-C, then schedule rc",
    "every schedule in this filing",
    "schedules available for {q}",
    "what periods are available",
    "facsimile as pdf",
    "line items of RCFD2170",
    "define Basel capital",
    "capitalise the first letter of every assetless word",
    "supermarket minimum roaming",
    "sing about rain",
    "price of bitcoin tomorrow",
    "second quarter of last year",
    "this quarter or the previous one",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """Element of a constant list by 0-based position."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").cast("string").alias("rssd_id"),
            F.trim("s_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
        )
    )


def cents(c: Column | str) -> Column:
    """A two-decimal amount as a whole number: sums of it are exact in any order, and unlike
    decimals they stay primitive in generated code."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 100.0 + 0.5)


def panel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, ship quarter). Grouped by two integers and combined map-side, so a
    hot supplier costs no more than a cold one; key text is made after the aggregate."""
    price = cents("l_extendedprice")
    is_r = F.col("l_returnflag") == "R"
    is_n = F.col("l_returnflag") == "N"
    is_fa = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    total = lambda c: F.sum(c).cast("double") / 100.0
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate").isNotNull() & F.col("l_suppkey").isNotNull())
        .groupBy("l_suppkey", quarter_index("l_shipdate").alias("quarter_index"))
        .agg(
            total(price).alias("price"),
            total(F.when(is_n, price).otherwise(F.lit(0))).alias("price_n"),
            total(F.when(is_fa, price)).alias("price_fa"),
            total(F.when(is_r, price)).alias("price_r"),
            total(cents("l_tax")).alias("tax"),
            total(cents("l_discount")).alias("discount"),
            total(cents("l_quantity")).alias("quantity"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .withColumn("quarter_date", index_to_key("quarter_index"))
        .drop("quarter_index")
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts ``(rssd_id, quarter_date, code, value_raw, value_num)``; a missing code is a missing row."""
    n = F.col("n_lines").cast("double")
    share_n = round_half_up(F.col("price_n") * 100.0 / F.nullif("price", F.lit(0.0)), 4)
    tax = round_half_up(F.col("tax") * 100.0 / n, 4)
    gap = (F.substring("quarter_date", 5, 2) == "06") & (F.col("l_suppkey") % 7 == 0)
    values = {
        "UBPR2170": F.col("price"),
        "UBPRE013": tax,
        "UBPRE018": round_half_up(F.col("discount") * 100.0 / n, 4),
        "UBPRD487": share_n,
        "UBPRD486": round_half_up(F.col("price_fa") * 100.0 / F.nullif("price", F.lit(0.0)), 4),
        "UBPRD488": share_n + tax,
        "UBPR7308": round_half_up(F.col("quantity") / n, 4),
        "UBPR7414": round_half_up(F.col("price_r") * 100.0 / F.nullif("price", F.lit(0.0)), 4),
        "UBPRE600": F.when(~gap, n),
    }
    rows = F.array(
        *[
            F.struct(F.lit(code).alias("code"), F.lit(i).alias("ord"), v.alias("v"))
            for i, (code, v) in enumerate(values.items())
        ]
    )
    def stored_text(r: Column) -> Column:
        text = r["v"].cast("decimal(18,4)").cast("string")
        h = (F.col("l_suppkey") * 31 + F.col("quarter_date").cast("int") * 7 + r["ord"] * 13) % 97
        # Text defects on about one value in ten, placed by a hash of the ids.
        raw = (
            F.when(h == 0, "0000").when(h == 1, "").when(h == 2, "n/a").when(h == 3, "1,234")
            .when(h == 4, F.concat(text, F.lit("%"))).when(h == 5, F.concat(F.lit(" "), text, F.lit(" ")))
            .when(h == 6, "0.0").when(h == 7, "nan").when(h == 8, "1d").when(h == 9, "1_000")
            .when(h == 10, "0").otherwise(text)
        )
        return F.struct(r["code"].alias("code"), raw.alias("value_raw"))

    # The text is made before the explode, so later steps see a plain column, as in a stored table.
    reported = F.filter(rows, lambda r: r["v"].isNotNull())
    return (
        panel_cells(spark, sf_dir)
        .select(
            F.col("l_suppkey").cast("string").alias("rssd_id"), "quarter_date",
            F.inline(F.transform(reported, stored_text)),
        )
        .withColumn("value_num", strict_number("value_raw"))
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing line items. ``ord`` is the filing order: any orderable value works as the
    ordinal, so no per-filing numbering (one task per filing) is needed."""
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    defect = (F.col("l_orderkey") + F.col("l_linenumber")) % 29
    value = (
        F.when(defect == 0, "").when(defect == 1, "n/a").when(defect == 2, F.concat(amount, F.lit("%")))
        .when(defect == 3, F.concat(F.lit(" "), amount)).when(defect == 4, "12abc")
        .when(defect == 5, "1,234").when(defect == 6, F.concat(F.lit("-"), amount)).otherwise(amount)
    )
    quarter = quarter_end("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate").isNotNull() & F.col("l_suppkey").isNotNull())
        .select(
            F.col("l_suppkey").cast("string").alias("rssd_id"),
            quarter.alias("quarter_date"),
            quarter_period(F.year("l_shipdate"), F.quarter("l_shipdate")).alias("reporting_period"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"
            ).alias("ord"),
            pick(ITEM_CODES, (F.col("l_partkey") + 3 * F.col("l_linenumber")) % len(ITEM_CODES))
            .alias("item_code"),
            value.alias("value_raw"),
            day_key("l_shipdate").alias("last_update"),
            pick(ITEM_TEXTS, (F.col("l_partkey") + F.col("l_linenumber")) % len(ITEM_TEXTS))
            .alias("description"),
            pick(ITEM_SCHEDULES, F.col("l_linenumber") - 1).alias("schedule"),
            F.concat_ws(".", F.col("l_linenumber").cast("string"), "l_returnflag").alias("line_number"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst questions ``(question_id, question, rssd_id, quarter_date, reporting_period)``:
    one filled template per bank and quarter, and every conversation turn as free prose."""
    cells = panel_cells(spark, sf_dir).select("l_suppkey", "quarter_date")
    number = F.col("l_suppkey") * 11 + F.col("quarter_date").cast("int")
    text = pick(QUESTION_TEMPLATES, number % len(QUESTION_TEMPLATES))
    fills = {
        "{name}": F.concat(F.lit("Bank "), F.col("l_suppkey").cast("string")),
        "{id}": F.col("l_suppkey").cast("string"),
        "{q}": quarter_label("quarter_date"),
        "{q0}": F.concat(F.lit("Q3 "), F.substring("quarter_date", 1, 4)),
        "{y}": F.concat(F.lit("20"), F.substring("quarter_date", 3, 2)),
        "{code}": pick(PANEL_CODES, F.col("l_suppkey") % len(PANEL_CODES)),
    }
    for mark, fill in fills.items():
        text = F.replace(text, F.lit(mark), fill)
    has_bank = number % 5 != 0
    asked = cells.select(
        F.concat_ws("-", F.lit("p"), F.col("l_suppkey").cast("string"), "quarter_date").alias("question_id"),
        text.alias("question"),
        F.when(has_bank, F.col("l_suppkey").cast("string")).alias("rssd_id"),
        F.when(has_bank, F.col("quarter_date")).alias("quarter_date"),
        F.when(has_bank, key_to_period("quarter_date")).alias("reporting_period"),
    )
    spoken = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("question_id"),
        F.col("text").alias("question"),
        F.lit(None).cast("string").alias("rssd_id"),
        F.lit(None).cast("string").alias("quarter_date"),
        F.lit(None).cast("string").alias("reporting_period"),
    )
    return asked.unionByName(spoken)
