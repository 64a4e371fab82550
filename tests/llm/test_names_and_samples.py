"""Callers' column names, and learning samples under many copies."""

import numpy as np
from pyspark.sql import functions as F

from finfacts.llm import op01_toxicity, op04_secret_scans, op05_minhash, op07_language_id, op10_source_mixing

INSIDE = ["_key", "_spans", "_row", "_copy", "_text", "key", "spans", "document", "copies", "copy", "text_key", "node", "least"]


def test_columns_of_any_name_stay(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{body} password=abcdef123", "en", "s", 9), (2, body + " end", "en", "s", 9), (3, "other words", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({name: F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")) for name in INSIDE})

    def intact(out):
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[name] == f"{name} {r.doc_id}" for r in rows for name in INSIDE)
        return rows

    masked = {r.doc_id: r.text for r in intact(op04_secret_scans.redact(docs))}
    assert "abcdef123" not in masked[1] and masked[2] == body + " end"
    assert {r.doc_id for r in intact(op05_minhash.deduplicated(docs))} == {1, 3}
    assert len(intact(op10_source_mixing.realise(docs, target_entropy=None, max_repeats=None))) >= 2


def test_language_sample_is_bounded_under_copies(documents_of):
    rows = [(i, "one and the same english text", "en") for i in range(1, 9001)] + [(10_000 + i, f"deutscher text {i}", "de") for i in range(60)]
    sample = op07_language_id.learning_sample(documents_of(rows), 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample} == {"en": 1, "de": 20}


def test_toxicity_sample_is_bounded_under_repeats(spark, documents_of):
    rows = [(i % 50, f"text {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] * 3, "doc_id long, quality int, toxic int")
    sample = op01_toxicity.learning_rows(documents_of(rows), labels, 10).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in sample} == {0: 10, 1: 10}


def test_spans_are_those_of_the_text_itself():
    for text in ("\u0130stanbul \u0131l\u0131k damn kill you", "damn \u0130\u0130\u0130 damn", "plain damn text", "\u03a3\u0391\u03a3 damn"):
        tokens = op01_toxicity._TOKEN.findall(text.lower())
        p = np.array([0.9 if t == "damn" else 0.1 for t in tokens])
        found = op01_toxicity.offending(text, p)
        assert [text[a:b] for a, b in found] == ["damn"] * tokens.count("damn") and found
