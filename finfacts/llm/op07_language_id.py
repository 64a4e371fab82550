"""Language ID, word first: per-language log frequencies of known words, character n-grams for the others.

A known word adds its log frequency in every language. A word that no training text holds falls back to the longest
character n-grams (with word edges) of which any is known, down to single characters; languages are always compared
at the same order, so no back-off penalty is needed. The prediction is the language with the largest sum (ties: the
first by name); its score is the posterior at ``EVIDENCE`` words at most, so long texts don't saturate at once.

The model is fitted on a bounded sample: at most ``MAX_DOCUMENTS`` whole texts of each language, the ones of least
hash among the learning rows. It keeps about the ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams that are most frequent
in each language (of the last level of equal frequency, the share that fits, by hash), so a small language loses
nothing to a large one. Its size is bounded by the number of languages and it is broadcast. Every document is scored
on its whole text.

Null texts and texts without a letter are ``und`` with score 0. Without any learning row every text is ``und``.
Repeated rows are scored each and train once; rows with a null language never train. An empty table gives an empty
result; extra columns are not read by the query and kept by ``accepted``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, shared, stored, table

FOLDS = 5
MAX_DOCUMENTS = 2_000
#: For each language.
MAX_WORDS, MAX_GRAMS = 100_000, 100_000
LONGEST_GRAM = 5
EVIDENCE = 40
SMOOTH = 0.5
UNKNOWN = "und"
MIN_SCORE = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    edged = f"\x02{word}\x03" if n > 1 else word
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(False))


def learning_sample(documents: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """text, lang: at most ``max_documents`` learning texts of each language, by the hash of the text; a text that many
    rows hold is one."""
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("h")
    # Only hashes are ranked; the limit is applied in every task before the shuffle.
    keys = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    chosen = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_documents).select("lang", "h")
    texts = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    return texts.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lang, group in b.groupby("lang"):
            words: Counter = Counter()
            for text in group["text"]:
                words.update(_WORD.findall(text.lower()))
            if words:
                yield pd.DataFrame({"lang": lang, "word": list(words.keys()), "n": list(words.values())})


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found: Counter = Counter()
        for lang, word, n in zip(b["lang"], b["word"], b["n"]):
            for size in range(1, LONGEST_GRAM + 1):
                for g in grams(word, size):
                    found[lang, g] += n
        keys = list(found)
        if keys:
            yield pd.DataFrame({"lang": [k[0] for k in keys], "gram": [k[1] for k in keys], "n": list(found.values())})


def _logs(best: DataFrame, name: str, langs: list[str]) -> tuple[str, np.ndarray]:
    """(the entries, one a line; their smoothed log frequencies by language) of one row for each entry."""
    columns = [F.coalesce(F.element_at("by", lang), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    rows = best.select(name, *columns).toPandas()  # as many rows as the model may have entries
    counts = rows.drop(columns=name).to_numpy(np.float64)
    totals = np.log(counts.sum(axis=0) + SMOOTH * max(len(counts), 1))
    return "\n".join(rows[name]), (np.log(counts + SMOOTH) - totals).astype(np.float32)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    words: str
    word_logs: np.ndarray
    grams: str
    gram_logs: np.ndarray


def top(frame: DataFrame, name: str, limit: int) -> DataFrame:
    """``name`` and ``by`` (its counts by language) of the entries that are among the ``limit`` first of any language."""
    # One row for each frequency, so no language's entries are ranked in one task.
    levels = frame.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    fits = levels.select("lang", "n", ((limit - (upto - F.col("c"))) / F.col("c")).alias("share")).where("share > 0")
    within = F.pmod(F.xxhash64(name), F.lit(1_000_000)) < F.coalesce("share", F.lit(0.0)) * 1_000_000
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    return frame.join(F.broadcast(fits), ["lang", "n"], "left").groupBy(name).agg(by, F.max(within).alias("within")).where("within")


def fit(documents: DataFrame, max_documents: int = MAX_DOCUMENTS) -> Model:
    """The model of the learning rows' sample; what reaches the driver is bounded by the limits of each language."""
    sample = learning_sample(documents, max_documents)
    words = stored(sample.mapInPandas(_counts, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    counted = stored(words.mapInPandas(_gram_counts, "lang string, gram string, n long")
                     .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return Model(langs, *_logs(top(words, "word", MAX_WORDS), "word", langs), *_logs(top(counted, "gram", MAX_GRAMS), "gram", langs))


def numbers_of(lines: str) -> dict[str, int]:
    return {x: i for i, x in enumerate(lines.split("\n"))} if lines else {}


class Scorer:
    """Scores texts. Unseen words get a row behind the known ones, in a bounded table that starts anew when full."""

    def __init__(self, model: Model, room: int = 100_000):
        self.model = model
        self.grams = numbers_of(model.grams)
        self.known = len(model.word_logs)
        self.numbers = numbers_of(model.words)
        self.table = np.zeros((self.known + room, len(model.langs)), np.float32)
        self.table[: self.known] = model.word_logs

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequencies of the longest n-grams of which any is known."""
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            at = [i for g in grams(word, size) if (i := self.grams.get(g)) is not None]
            if at:
                return self.model.gram_logs[at].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def _add(self, word: str) -> int:
        number = self.numbers[word] = len(self.numbers)
        self.table[number] = self.unseen(word)
        return number

    def sums(self, text: str) -> tuple[np.ndarray, int]:
        words = _WORD.findall(text.lower())
        total = np.zeros(len(self.model.langs))
        # Bounded slices, so that the table has room for the new words of any text.
        for start in range(0, len(words), 10_000):
            part = words[start : start + 10_000]
            if len(self.numbers) + len(part) > len(self.table):
                self.numbers = numbers_of(self.model.words)
            get = self.numbers.get
            at = [i if (i := get(w)) is not None else self._add(w) for w in part]
            total += self.table[at].sum(axis=0, dtype=np.float64)
        return total, len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = self.sums(text)
        scaled = total * min(1.0, EVIDENCE / max(n, 1))
        best = int(np.argmax(scaled))
        score = 1.0 / float(np.exp(scaled - scaled[best]).sum())
        return self.model.langs[best], score if math.isfinite(score) else 0.0


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    opened = shared(documents.sparkSession, model, Scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = opened()
        for b in batches:
            found = [scorer.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"],
                                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told with ``min_score``, with all their columns; learned on the same table."""
    model = fit(documents)
    opened = shared(documents.sparkSession, model, Scorer)

    @F.pandas_udf("boolean")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = opened()
        for batch in texts:
            found = [scorer.predict(t) for t in batch]
            yield pd.Series([lang != UNKNOWN and score >= min_score for lang, score in found], dtype=bool)

    return documents.where(told("text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))
