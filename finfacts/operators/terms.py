"""Substring search for a whole table of terms: an n-gram index joined by equality, then the exact test.

The index is over the distinct texts. A text that contains a term contains every n-gram of it. Each term is looked up by
one of its grams, the one that fewest texts hold, so a pair of text and term meets once at most and only where that
gram agrees. Terms shorter than ``GRAM`` are a gram themselves; a blank term is the empty gram, which every text has.
Rows then look up their texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

GRAM = 3


def _grams_of(text: str, n: int) -> Column:
    """All grams of one length, the empty gram for length 0."""
    if not n:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(n)))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def _grams(text: str, lengths: Sequence[int]) -> Column:
    """Distinct grams of a text column, of all these lengths."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *[_grams_of(text, n) for n in lengths]))


def text_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``(text, needles)``: each distinct text of ``(text)`` with the array of the ``(needle)`` it contains.

    The array is bounded by the text: it holds each of its substrings once at most. The index of needles is left to the
    optimizer's size check: broadcast while small, otherwise the grams are shuffled, and adaptive execution splits a gram
    that many texts hold. One job reads the lengths in use, GRAM + 1 numbers at most.
    """
    asked = needles.where(F.col("needle").isNotNull()).distinct()
    size = F.least(F.length("needle"), F.lit(GRAM))
    lengths = sorted(r.n for r in asked.select(size.alias("n")).distinct().collect())
    index = texts.where(F.col("text").isNotNull()).distinct().select("text", F.explode(_grams("text", lengths)).alias("gram"))
    # A needle's own grams all have its length, or GRAM.
    cut = F.array().cast("array<string>")
    for n in lengths:
        cut = F.when(size == n, _grams("needle", [n])).otherwise(cut)
    cuts = asked.select("needle", F.explode(cut).alias("gram"))
    held = index.select("gram").join(cuts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))
    best = cuts.join(held, "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    # A gram that no text holds rules its needle out.
    chosen = best.where(F.col("best.n") > 0).select("needle", F.col("best.gram").alias("gram"))
    found = index.join(chosen, "gram").where(F.contains(F.col("text"), F.col("needle")))
    return found.groupBy("text").agg(F.collect_list("needle").alias("needles"))


def contains_join(
    rows: DataFrame, fields: Sequence[Column], terms: DataFrame, needle: Column, test: Column | None = None
) -> DataFrame:
    """Each row beside each row of ``terms`` whose ``needle`` (a column of ``terms``) is inside one of the ``fields``
    (columns of ``rows``), and for which ``test`` holds as well. Both frames need distinct column names.

    Null fields and null needles match nothing; an empty needle matches every row with a field. Equal terms are
    answered each.
    """
    texts = rows.select(F.explode(F.array_compact(F.array(*fields))).alias("text"))
    listed = terms.withColumn("__needle", needle)
    hits = text_hits(texts, listed.select(F.col("__needle").alias("needle")))
    keyed, arrays = rows, []
    for i, field in enumerate(fields):
        keyed = keyed.withColumn(f"__text{i}", field)
    for i in range(len(fields)):
        own = hits.select(F.col("text").alias(f"__text{i}"), F.col("needles").alias(f"__hits{i}"))
        keyed = keyed.join(own, f"__text{i}", "left")
        arrays.append(F.coalesce(f"__hits{i}", F.array().cast("array<string>")))
    found = keyed.withColumn("__needle", F.explode(F.array_distinct(F.concat(*arrays)))).select(*rows.columns, "__needle")
    joined = found.join(listed, "__needle")
    return (joined if test is None else joined.where(test)).select(*rows.columns, *terms.columns)


def search_table(items: DataFrame, terms: DataFrame) -> DataFrame:
    """Line items whose code, description or value contains a term of the table ``(term)``, once for each term."""
    fields = [F.lower(c) for c in ("item_code", "description", "value_raw")]
    return contains_join(items, fields, terms, F.lower(F.trim("term")))


def match_institutions_table(
    institutions: DataFrame, terms: DataFrame, with_city: bool = False, limit: int = 80, blank_matches_all: bool = False
) -> DataFrame:
    """The first ``limit`` institutions (by numeric id) whose name or id, or city too, contains each term of a table."""
    fields = [F.lower("name"), F.lower("rssd_id")]
    # The id is compared as written.
    test = F.contains(F.lower("name"), F.lower("term")) | F.contains(F.col("rssd_id"), F.col("term"))
    if with_city:
        fields.append(F.lower("city"))
        test = test | F.coalesce(F.contains(F.lower("city"), F.lower("term")), F.lit(False))
    asked = terms.select("term").distinct()
    if not blank_matches_all:
        asked = asked.where(F.col("term") != "")
    order = W.partitionBy("term").orderBy(F.col("rssd_id").try_cast("bigint"), F.col("rssd_id"))
    found = contains_join(institutions, fields, asked, F.lower("term"), F.coalesce(test, F.lit(False)))
    return found.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= limit)


def find_codes_table(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    """Catalog rows beside each pattern ``(pattern, kind)``: ``prefix`` at the start of the code, else anywhere."""
    test = (F.col("kind") != "prefix") | F.startswith(F.col("code"), F.col("pattern"))
    return contains_join(catalog, [F.col("code")], patterns, F.col("pattern"), F.coalesce(test, F.lit(True)))
