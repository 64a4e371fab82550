"""Quality rules: lines that many documents of one host share are removed; a document left depleted is rejected.

Lines are normalised (ASCII lower case, digits as 0, runs of separators as one space) and hashed. A line's frequency
is the number of distinct documents (doc_ids) of its host (``source``) that hold it, copies included.
A line in more than ``max_documents`` of them is boilerplate. A document is depleted if less than ``min_left`` of its
words stay. The base rules (too few words, too many repeated 8-word windows) reject first.

Null and empty texts have no words and fail the base rule. Null hosts form one host. Repeated rows are judged each and
count as one document; a row without a doc_id is a document of its own. Extra columns are not read, but ``cleaned``
keeps them. There are no ties; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stored, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MAX_DOCUMENTS = 10
MIN_LEFT_PERCENT = 50

_NORMAL = bytes.maketrans(b"0123456789", b"0000000000")
_PROFILE = (
    "row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<h: long, w: int>>"
)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur twice or more, the first ones included.

    Windows are compared exactly: ranks of words, then of pairs, fours and eights.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    span = 1
    while span < width:
        step = min(span, width - span)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span += step
    again = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:-width] += again
    edges[width:] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def profile(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {line hash: words})."""
    words = text.encode().split()
    seen: set[str] = set()
    repeats, lines = 0, {}
    for line in text.split("\n"):
        parts = line.encode().split()
        if not parts:
            continue
        repeats += line in seen
        seen.add(line)
        key = xxhash.xxh3_64_intdigest(b" ".join(parts).lower().translate(_NORMAL)) - 2**63
        lines[key] = lines.get(key, 0) + len(parts)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), lines


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in batches:
        found = [profile(t or "") for t in b["text"]]
        out = b[["row_id", "doc_id", "host"]].copy()
        for i, name in enumerate(names):
            out[name] = [x[i] for x in found]
        out["lines"] = [[{"h": h, "w": w} for h, w in x[5].items()] for x in found]
        yield out


def _profiled(rows: DataFrame) -> DataFrame:
    """Counts and line hashes of the rows (row_id, doc_id, source, text)."""
    wanted = rows.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), "text")
    return stored(wanted.mapInPandas(_profiles, _PROFILE), "profiles")


def _boilerplate(base: DataFrame, max_documents: int) -> DataFrame:
    """(row_id, h, w): the lines of each row that more than ``max_documents`` documents of its host hold."""
    lines = base.select("row_id", "doc_id", "host", F.explode("lines").alias("line")).select(
        "row_id", "doc_id", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    # One row for each document of a line, spread by document too; counts of a hot line are added up map-side.
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row_id")).alias("row"))
    common = (lines.select("host", "h", document.alias("document")).distinct().groupBy("host", "h").count()
              .where(F.col("count") > max_documents).select("host", "h"))
    return lines.join(common, ["host", "h"]).select("row_id", "h", "w")


def judge(documents: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT_PERCENT) -> DataFrame:
    """Base counts, words on boilerplate lines and the verdict of every document."""
    return _judged(_profiled(_numbered(documents)), max_documents, min_left).drop("row_id")


def _numbered(documents: DataFrame) -> DataFrame:
    return documents.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", "text")


def _judged(base: DataFrame, max_documents: int, min_left: int) -> DataFrame:
    removed = _boilerplate(base, max_documents).groupBy("row_id").agg(F.sum("w").alias("n_removed"))
    n_removed = F.coalesce("n_removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - n_removed) < min_left * F.col("n_words")
    counts = base.drop("lines", "host")
    return counts.join(removed, "row_id", "left").select(
        "row_id", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), n_removed.alias("n_boilerplate_words"))


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [kept_text(t, set(h)) if h is not None and t is not None else t for t, h in zip(b["text"], b["hashes"])]
        yield pd.DataFrame({"row_id": b["row_id"], "text": texts})


def cleaned(documents: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT_PERCENT) -> DataFrame:
    """The kept documents with all their columns, boilerplate lines taken out of the texts."""
    packed = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")
    rows = stored(documents.select(F.monotonically_increasing_id().alias("row_id"), packed), "numbered")
    texts = rows.select("row_id", "document.doc_id", "document.source", "document.text")
    base = _profiled(texts)
    kept = _judged(base, max_documents, min_left).where("kept").select("row_id")
    # A row's own lines only.
    gone = _boilerplate(base, max_documents).groupBy("row_id").agg(F.collect_list("h").alias("hashes"))
    new = texts.select("row_id", "text").join(kept, "row_id").join(gone, "row_id", "left")
    new = new.mapInPandas(_without, "row_id long, text string")
    out = rows.join(new, "row_id").withColumn("document", F.col("document").withField("text", F.col("text")))
    return out.select("document.*")


def kept_text(text: str, boilerplate: set[int]) -> str:
    """The text without its boilerplate lines (hashes as in ``profile``)."""
    out = []
    for line in text.split("\n"):
        normal = re.sub(rb"[\t-\r ]+", b" ", line.encode()).strip().lower().translate(_NORMAL)
        if not normal or xxhash.xxh3_64_intdigest(normal) - 2**63 not in boilerplate:
            out.append(line)
    return "\n".join(out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_UPPER_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT k, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM d)
), win AS (
  SELECT k, i, word, string_agg(word, ' ') OVER eight AS text8, count(*) OVER eight AS n8
  FROM w WINDOW eight AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), rep AS (
  SELECT k, i, word, n8 = {WINDOW} AND count(*) FILTER (n8 = {WINDOW}) OVER (PARTITION BY k, text8) > 1 AS again FROM win
), cov AS (
  SELECT k, word, max(CASE WHEN again THEN 1 ELSE 0 END)
           OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM rep
), wc AS (
  SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words,
         sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) AS n_symbols
  FROM cov GROUP BY k
), raw AS (
  SELECT k, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d
), ln AS (
  SELECT k, doc_id, host, line,
         trim(regexp_replace(translate(line, '{_UPPER_DIGITS}', '{_UPPER_DIGITS[:26].lower()}0000000000'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm
  FROM raw
), ok AS (
  SELECT *, len(string_split(norm, ' ')) AS nw FROM ln WHERE norm <> ''
), dup AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM ok GROUP BY k
), common AS (
  SELECT host, norm FROM ok GROUP BY host, norm HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'row ' || k::VARCHAR)) > {MAX_DOCUMENTS}
), gone AS (
  SELECT k, sum(nw) AS n_removed FROM ok JOIN common USING (host, norm) GROUP BY k
), f AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_boilerplate_words
  FROM d LEFT JOIN wc USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * (n_words - n_boilerplate_words) >= {MIN_LEFT_PERCENT} * n_words AS kept
FROM f
"""
