"""Quarter keys (YYYYMMDD), report periods (MM/DD/YYYY) and calendars.

Everything that depends on "today" takes an explicit ``as_of`` date text
(YYYY-MM-DD), so a run can be repeated.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finfacts.functions.phrases import let
from finfacts.reference_data import QUARTER_NAMES

# A quarter key names the last day of a calendar quarter. Four-digit years have 40,000 of
# them, so a frame with one row per quarter has at most QUARTER_DOMAIN rows; files whose name
# holds no key of QUARTER_KEY are not ingested.
QUARTER_KEY = r"^(19|20|21)[0-9]{2}(0331|0630|0930|1231)$"
QUARTER_DOMAIN = 40_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_quarter_key(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(QUARTER_KEY), F.lit(False))


# Keys are put together from integers: per-row date formatting costs more than a scan does.

def quarter_index(d: Column | str) -> Column:
    """Date or timestamp to a running quarter number, the cheapest key to group by."""
    d = _col(d)
    return F.year(d) * 4 + F.quarter(d) - 1


def _listed(quarter: Column, values: tuple[str, ...]) -> Column:
    """The quarter's entry of a constant list; an out-of-range quarter gives NULL."""
    return F.get(F.array(*map(F.lit, values)), quarter - 1)


def _year_text(year: Column) -> Column:
    """Four digits, or all of a longer year: cutting it would make two years one."""
    text = year.cast("string")
    return F.when(F.length(text) > 4, text).otherwise(F.lpad(text, 4, "0"))


def quarter_key(year: Column, quarter: Column) -> Column:
    return F.concat(_year_text(year), _listed(quarter, ("0331", "0630", "0930", "1231")))


def quarter_period(year: Column, quarter: Column) -> Column:
    return F.concat(
        _listed(quarter, ("03/31/", "06/30/", "09/30/", "12/31/")), _year_text(year)
    )


def index_to_key(index: Column | str) -> Column:
    i = _col(index)
    return quarter_key(F.floor(i / 4).cast("int"), i % 4 + 1)


def quarter_end(d: Column | str) -> Column:
    """Date or timestamp to the key of its quarter's last day."""
    d = _col(d)
    return quarter_key(F.year(d), F.quarter(d))


def day_key(d: Column | str) -> Column:
    """Date or timestamp to YYYYMMDD text."""
    return F.replace(_col(d).cast("date").cast("string"), F.lit("-"), F.lit(""))


def quarter_label(q: Column | str) -> Column:
    """YYYYMMDD to ``Qn YYYY``; too-short texts are kept."""
    q = _col(q)
    month = F.substring(q, 5, 2).try_cast("int")
    return F.when(
        F.length(q) >= 6,
        F.concat(F.lit("Q"), F.ceil(month / 3).cast("string"), F.lit(" "), F.substring(q, 1, 4)),
    ).otherwise(F.coalesce(q, F.lit("")))


def key_to_period(q: Column | str) -> Column:
    """YYYYMMDD to MM/DD/YYYY by position; NULL unless there are eight characters."""
    q = _col(q)
    return F.when(
        F.length(q) == 8,
        F.concat(F.substring(q, 5, 2), F.lit("/"), F.substring(q, 7, 2), F.lit("/"), F.substring(q, 1, 4)),
    )


def period_to_key(p: Column | str) -> Column:
    """MM/DD/YYYY to YYYYMMDD by position; NULL unless it has that shape."""
    p = _col(p)
    return F.when(
        p.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
        F.concat(F.substring(p, 7, 4), F.substring(p, 1, 2), F.substring(p, 4, 2)),
    )


def two_years_back(q: Column | str) -> Column:
    """First of the same month two years earlier: the inclusive bound that spans 9 quarter ends."""
    q = _col(q)
    return F.concat(
        (F.substring(q, 1, 4).try_cast("int") - 2).cast("string"), F.substring(q, 5, 2), F.lit("01")
    )


def _quarter_index(as_of: str) -> int:
    d = date.fromisoformat(as_of)
    return d.year * 4 + (d.month - 1) // 3


def _index_text(index: int) -> str:
    return f"DATE'{index // 4:04d}-{index % 4 * 3 + 1:02d}-01'"


def quarter_calendar(
    spark: SparkSession, as_of: str, start_year: int, lag_quarters: int
) -> DataFrame:
    """Published quarters ``(quarter_date, period_mdy)`` from ``start_year`` to as-of minus the lag."""
    last = _quarter_index(as_of) - lag_quarters
    first = start_year * 4
    if last < first:
        return spark.sql("SELECT '' AS quarter_date, '' AS period_mdy WHERE false")
    starts = spark.sql(
        f"SELECT explode(sequence({_index_text(first)}, {_index_text(last)}, INTERVAL 3 MONTHS)) AS d"
    )
    end = F.last_day(F.add_months("d", 2))
    return starts.select(
        F.date_format(end, "yyyyMMdd").alias("quarter_date"),
        F.date_format(end, "MM/dd/yyyy").alias("period_mdy"),
    )


def recent_calendar(spark: SparkSession, as_of: str, count: int = 8, lag_quarters: int = 1) -> DataFrame:
    """The last ``count`` quarters before as-of, without looking at any stored data."""
    last = _quarter_index(as_of) - lag_quarters
    first = last - count + 1
    starts = spark.sql(
        f"SELECT explode(sequence({_index_text(first)}, {_index_text(last)}, INTERVAL 3 MONTHS)) AS d"
    )
    return starts.select(F.date_format(F.last_day(F.add_months("d", 2)), "yyyyMMdd").alias("quarter_date"))


def last_published_key(as_of: str, lag_quarters: int) -> str:
    """Key of the newest quarter that is published at ``as_of``."""
    index = _quarter_index(as_of) - lag_quarters
    return f"{index // 4:04d}" + ("0331", "0630", "0930", "1231")[index % 4]


def requested_period(text: Column | str, as_of: str) -> Column:
    """Struct ``(year, quarter)`` a question asks for, defaults filled from ``as_of``.

    Names are tested as substrings in their fixed order, so "market" counts as March.
    """
    t = F.lower(F.trim(_col(text)))
    now = date.fromisoformat(as_of)
    now_q = (now.month - 1) // 3 + 1
    year_text = F.regexp_extract(t, r"\b(20[0-9]{2})\b", 1)
    named_year = F.when(year_text != "", year_text.cast("int"))
    last_q, last_q_year = (now_q - 1, now.year) if now_q > 1 else (4, now.year - 1)

    is_last_quarter = t.contains("last quarter") | t.contains("previous quarter")
    is_this_quarter = t.contains("this quarter") | t.contains("current quarter")
    is_last_year = t.contains("last year")
    named_quarter = F.lit(None).cast("int")
    for name, quarter in reversed(QUARTER_NAMES):
        named_quarter = F.when(t.contains(name), F.lit(quarter)).otherwise(named_quarter)

    quarter = (
        F.when(is_last_quarter, F.lit(last_q))
        .when(is_this_quarter, F.lit(now_q))
        .when(is_last_year, F.lit(4))
        .otherwise(named_quarter)
    )
    year = (
        F.when(is_last_quarter, F.lit(last_q_year))
        .when(is_this_quarter, F.lit(now.year))
        .when(is_last_year, F.lit(now.year - 1))
        .otherwise(named_year)
    )
    return F.struct(
        F.coalesce(year, F.lit(now.year)).alias("year"),
        # A year without a quarter means its last quarter; neither means the current one.
        F.coalesce(quarter, F.when(year.isNotNull(), F.lit(4)), F.lit(now_q)).alias("quarter"),
    )


def nearest_period(period: Column, available: Column) -> Column:
    """The available period closest in days to ``period``; the first listed wins a tie."""
    day = lambda p: F.try_to_timestamp(p, F.lit("MM/dd/yyyy")).cast("date")

    def nearest(target: Column) -> Column:
        ranked = F.transform(
            available,
            lambda p, i: F.struct(F.abs(F.datediff(day(p), target)).alias("gap"), i.alias("pos"), p.alias("period")),
        )
        return F.array_min(F.filter(ranked, lambda r: r["gap"].isNotNull()))["period"]

    # An exact match needs no dates at all; otherwise the wanted date is read once.
    return F.when(F.array_contains(available, period), period).otherwise(let(day(period), nearest))


def quarter_range_in_text(text: Column | str) -> Column:
    """Struct ``(from_quarter, to_quarter)`` of the first two ``Qn YYYY`` mentions, ordered; NULLs if fewer."""
    t = F.lower(_col(text))
    pattern = F.lit(r"q([1-4])\s*([0-9]{4})")
    quarters = F.regexp_extract_all(t, pattern, F.lit(1))
    years = F.regexp_extract_all(t, pattern, F.lit(2))
    keys = F.transform(
        F.arrays_zip(quarters.alias("q"), years.alias("y")),
        lambda z: F.concat(
            z["y"], F.element_at(F.array(*map(F.lit, ("0331", "0630", "0930", "1231"))), z["q"].cast("int"))
        ),
    )
    both = F.when(F.size(keys) >= 2, F.slice(keys, 1, 2))
    return F.struct(F.array_min(both).alias("from_quarter"), F.array_max(both).alias("to_quarter"))


def quarter_keys(start: str, end: str) -> list[str]:
    """Quarter keys between two keys, oldest first."""
    def index(key: str) -> int:
        return int(key[:4]) * 4 + (int(key[4:6]) - 1) // 3

    return [
        f"{i // 4:04d}" + ("0331", "0630", "0930", "1231")[i % 4]
        for i in range(index(start), index(end) + 1)
    ]
