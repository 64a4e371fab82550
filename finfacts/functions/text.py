"""Text rules: schedules, names, ids, keyword tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from finfacts.reference_data import (
    BALANCE_SHEET_SCHEDULES, INCOME_SCHEDULES, NAME_STOP_WORDS,
)

ENTITY_ID = r"FI ([0-9]+)\(ID RSSD\)"
SAFE_CODE = r"^[A-Za-z0-9_]+$"
RATIO_CODE = r"\bUBPR[A-Z0-9]{4,}\b"
SCHEDULE_CODE = r"\bRC(?:-[A-Z]+)?\b|\bRI(?:-[A-Z]+)?\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_schedule(c: Column | str) -> Column:
    """Schedule text to its family code; blank gives NULL."""
    s = F.upper(F.trim(_col(c)))
    return (
        F.when(_col(c).isNull() | (s == ""), F.lit(None).cast("string"))
        .when(s == "RI", "RI")
        .when(s.startswith("RCC"), "RC-C")
        .when(s.startswith("RC"), "RC")
        .otherwise(s)
    )


def schedule_family(c: Column | str) -> Column:
    s = _col(c)
    return (
        F.when(s.isin(BALANCE_SHEET_SCHEDULES), "Balance Sheet")
        .when(s.isin(INCOME_SCHEDULES), "Income")
        .otherwise("Other")
    )


def local_name(c: Column | str) -> Column:
    """``{uri}Name`` or ``prefix:Name`` to ``Name``."""
    return F.regexp_extract(_col(c), "([^}:]+)$", 1)


def entity_id(c: Column | str) -> Column:
    """Institution id inside an archive member name, NULL when absent."""
    found = F.regexp_extract(_col(c), ENTITY_ID, 1)
    return F.when(found != "", found)


def name_words(c: Column | str) -> Column:
    """Distinctive words of an institution name, lower case, legal-form words removed."""
    plain = F.regexp_replace(F.lower(_col(c)), r"[',.&]", " ")
    plain = F.regexp_replace(plain, r"\b(" + "|".join(NAME_STOP_WORDS) + r")\b", "")
    return F.filter(F.split(F.regexp_replace(plain, r"\s+", " "), " "), lambda w: w != "")


def name_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.array_join(F.slice(name_words(c), 1, 2), ""), "[^a-z0-9]", "")


def name_initials(c: Column | str) -> Column:
    return F.array_join(
        F.transform(F.slice(name_words(c), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), ""
    )


def short_name(c: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(F.trim(_col(c)), r"\s+", " "), " ", 3)


def split_list(c: Column | str) -> Column:
    """Comma list to trimmed, non-blank items."""
    return F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def contains_any(c: Column | str, phrases: Sequence[str]) -> Column:
    """Case-insensitive substring test against a fixed phrase list."""
    text = F.lower(_col(c))
    test = F.lit(False)
    for phrase in phrases:
        test = test | text.contains(phrase)
    return test


def contains_any_word(c: Column | str, phrases: Sequence[str]) -> Column:
    """Like :func:`contains_any` but phrases must start and end at word boundaries."""
    escaped = [p.strip().replace("(", r"\(").replace(")", r"\)").replace(".", r"\.") for p in phrases]
    return F.lower(_col(c)).rlike(r"\b(" + "|".join(escaped) + r")\b")


def field_id(section: Column | str, item_code: Column | str) -> Column:
    return F.concat_ws("::", _col(section), _col(item_code))


def column_key(name: Column, period: Column, many_banks: bool, many_periods: bool) -> Column:
    """Report column key: the parts that vary, or both when nothing does."""
    if many_banks and not many_periods:
        return name
    if many_periods and not many_banks:
        return period
    return F.concat_ws("\n", name, period)


def column_header(key: Column) -> Column:
    return F.replace(key, F.lit("\n"), F.lit(" · "))


def schedules_in_text(c: Column | str) -> Column:
    """Schedule codes named in a text, first mention order, without repeats."""
    found = F.regexp_extract_all(F.upper(_col(c)), F.lit(SCHEDULE_CODE), F.lit(0))
    return F.array_distinct(found)


def ratio_codes_in_text(c: Column | str) -> Column:
    """Ratio codes named in a text, first mention order, without repeats."""
    found = F.regexp_extract_all(F.upper(_col(c)), F.lit(RATIO_CODE), F.lit(0))
    return F.array_distinct(found)
