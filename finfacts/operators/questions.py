"""Keyword labels for a table of analyst questions. All map-only expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finfacts import reference_data as ref
from finfacts.functions.periods import (
    nearest_period, quarter_key, quarter_period, quarter_range_in_text, requested_period,
)
from finfacts.functions.phrases import Matcher
from finfacts.functions.text import RATIO_CODE, contains_any_word, ratio_codes_in_text, schedules_in_text


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_class(question: Column | str, classes: Sequence[tuple[str, Sequence[str]]], otherwise: Column) -> Column:
    """The first class of which the text contains a phrase; the text is read once for all of them."""
    ranks: dict[str, int] = {}
    for i, (_, phrases) in enumerate(classes):
        for p in phrases:
            ranks.setdefault(p, i)
    matcher = Matcher(list(ranks))
    names = F.array(*[F.lit(name) for name, _ in classes])
    return F.coalesce(
        matcher.over(_col(question), lambda found: F.get(names, matcher.least(found, ranks))), otherwise)


def route(question: Column | str, rssd_id: Column, word_boundary: bool = False) -> Column:
    """``out_of_scope`` / ``data`` / ``knowledge``, tested in that order; without any keyword a
    question about a selected institution is ``data``."""
    classes = [("out_of_scope", ref.ROUTE_OUT_OF_SCOPE), ("data", ref.ROUTE_DATA), ("knowledge", ref.ROUTE_KNOWLEDGE)]
    otherwise = F.when(F.coalesce(rssd_id, F.lit("")) != "", "data").otherwise("knowledge")
    if not word_boundary:
        return _first_class(question, classes, otherwise)
    for name, phrases in reversed(classes):
        otherwise = F.when(contains_any_word(question, phrases), name).otherwise(otherwise)
    return otherwise


def ratio_intent(question: Column | str) -> Column:
    classes = [("trend", ref.RATIO_INTENT_TREND), ("peer", ref.RATIO_INTENT_PEER),
               ("regulatory", ref.RATIO_INTENT_REGULATORY)]
    return _first_class(question, classes, F.lit("ratios"))


def report_intent(question: Column | str) -> Column:
    classes = [("periods", ref.REPORT_INTENT_PERIODS), ("schedules_list", ref.REPORT_INTENT_SCHEDULES_LIST),
               ("schedule", ref.REPORT_INTENT_SCHEDULE)]
    return _first_class(question, classes, F.lit("metrics"))


def peer_group_hint(question: Column | str) -> Column:
    return _first_class(question, [("large", ["large"]), ("community", ["community", "small"]), ("mid", ["mid"])], F.lit("all"))


# Longest phrase first; equal lengths keep their listed order.
_METRICS = sorted(ref.METRIC_PHRASES, key=lambda p: -len(p[0]))


def _metric(question: Column, matcher: Matcher, found: Column) -> Column:
    explicit = F.regexp_extract(F.upper(question), f"({RATIO_CODE})", 1)
    ranks: dict[str, int] = {}
    for i, (phrase, _) in enumerate(_METRICS):
        ranks.setdefault(phrase, i)
    named = F.get(F.array(*[F.lit(code) for _, code in _METRICS]), matcher.least(found, ranks))
    return F.when(explicit != "", explicit).otherwise(named)


def metric_code(question: Column | str) -> Column:
    """An explicit ratio code, else the code of the longest known phrase, else NULL."""
    q, matcher = _col(question), Matcher([p for p, _ in _METRICS])
    return matcher.over(q, lambda found: _metric(q, matcher, found))


#: Phrases that may be collected from a table of keywords: they become one pattern in the plan.
MAX_PHRASES = 20_000


def classify(questions: DataFrame, keywords: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with a column for each ``topic`` of the table ``(topic, class, priority, phrase)``: the class of the
    contained phrase with the least (priority, class), NULL without any. The text is read once for all topics.

    Phrases are compared in lower case, as substrings; blank and null ones are left out. The table is read by the
    driver and may hold ``MAX_PHRASES`` phrases; for larger ones join by terms (:mod:`finfacts.operators.terms`).
    """
    listed = keywords.select("topic", "class", "priority", F.lower("phrase").alias("phrase")).where(
        "phrase <> '' AND topic IS NOT NULL AND class IS NOT NULL AND priority IS NOT NULL")
    rows = listed.limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases; use finfacts.operators.terms.contains_join")
    matcher = Matcher([r.phrase for r in rows])
    topics: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.topic, r.priority, r["class"])):
        topics.setdefault(r.topic, []).append(r)

    def labels(found: Column) -> Column:
        out = []
        for topic, entries in topics.items():
            names = list(dict.fromkeys((r.priority, r["class"]) for r in entries))
            ranks: dict[str, int] = {}
            for r in entries:
                ranks.setdefault(r.phrase, names.index((r.priority, r["class"])))
            named = F.array(*[F.lit(name) for _, name in names])
            out.append(F.get(named, matcher.least(found, ranks)).alias(topic))
        return F.struct(*out)

    if not topics:
        return questions
    return questions.withColumn("__labels", matcher.over(F.col(text), labels)).select(*questions.columns, "__labels.*")


def trend_codes(question: Column | str) -> Column:
    found = ratio_codes_in_text(question)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, ref.DEFAULT_TREND_CODES)))


def asked_schedules(question: Column | str) -> Column:
    found = schedules_in_text(question)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, ref.DEFAULT_SCHEDULES)))


def resolved_period(question: Column | str, as_of: str, available: Column | None = None) -> Column:
    """Struct ``(period, quarter_date, label, exact)``: what the text asks for, moved to the nearest
    available period when a list is given."""
    asked = requested_period(question, as_of)
    year, quarter = asked["year"], asked["quarter"]
    wanted = quarter_period(year, quarter)
    label = F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))
    if available is None:
        return F.struct(
            wanted.alias("period"), quarter_key(year, quarter).alias("quarter_date"),
            label.alias("label"), F.lit(True).alias("exact"),
        )
    usable = F.size(available) > 0
    period = F.when(usable, nearest_period(wanted, available)).otherwise(wanted)
    return F.struct(
        period.alias("period"),
        F.concat(F.substring(period, 7, 4), F.substring(period, 1, 2), F.substring(period, 4, 2))
        .alias("quarter_date"),
        label.alias("label"),
        (period == wanted).alias("exact"),
    )


def action(question: Column | str, rssd_id: Column, default_from: Column, default_to: Column) -> Column:
    """Navigation struct ``(type, tab, metric_code, from_quarter, to_quarter)``; the last three only
    for trends of a selected institution."""
    q = _col(question)
    tabs = [("trends", ref.ACTION_TREND), ("peers", ref.ACTION_PEER), ("pdf", ref.ACTION_PDF),
            ("sections", ref.ACTION_SECTIONS), ("metrics", ref.ACTION_CALL)]
    matcher = Matcher(*[phrases for _, phrases in tabs], [p for p, _ in _METRICS])

    def navigate(found: Column) -> Column:
        tab = F.lit("summary")
        for name, phrases in reversed(tabs):
            tab = F.when(matcher.any_of(found, phrases), name).otherwise(tab)
        trends = (tab == "trends") & (F.coalesce(rssd_id, F.lit("")) != "")
        span = quarter_range_in_text(q)
        return F.struct(
            F.when(matcher.any_of(found, ref.ACTION_CALL), "load_report").otherwise("load_ubpr").alias("type"),
            tab.alias("tab"),
            F.when(trends, _metric(q, matcher, found)).alias("metric_code"),
            F.when(trends, F.coalesce(span["from_quarter"], default_from)).alias("from_quarter"),
            F.when(trends, F.coalesce(span["to_quarter"], default_to)).alias("to_quarter"),
        )

    return matcher.over(q, navigate)


def available_periods(quarters: DataFrame) -> DataFrame:
    """One row with the newest-first array of stored periods; the input has one row per quarter."""
    keys = F.sort_array(F.collect_set("quarter_date"), asc=False)
    return quarters.agg(
        F.transform(
            keys,
            lambda q: F.concat_ws("/", F.substring(q, 5, 2), F.substring(q, 7, 2), F.substring(q, 1, 4)),
        ).alias("periods"),
        keys.alias("keys"),
    )
