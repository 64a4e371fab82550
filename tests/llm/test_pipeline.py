"""Each stage against a plain version over its own input, and the whole run."""

import pytest

import corpus_pipeline as pipeline
from finfacts.llm import op03_sentencepiece, op04_secret_scans, op07_language_id, op10_source_mixing
from finfacts.llm.common import stored

from .test_op05 import by_hand as groups_by_hand
from .test_op10 import by_hand as mixture_by_hand

SF = "/root/testdata/sf0.001"


def masked(text, spans):
    out, at = "", 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if a >= at:
            out += text[at:a] + op04_secret_scans.MASK
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def test_stages_in_order(outputs):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scans", "source_mixing", "sentencepiece"]
    assert all(d.columns == pipeline.COLUMNS for d in outputs[1:-1])


def test_language(outputs):
    scorer = op07_language_id.Scorer(op07_language_id.fit(outputs[0]))
    told = {r.doc_id for r in outputs[0].collect() if scorer.predict(r.text)[1] >= op07_language_id.MIN_SCORE}
    assert {r.doc_id for r in outputs[1].collect()} == told and len(told) >= 190


def test_near_duplicates(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[1].collect()]
    want = {d for d, (_, root) in groups_by_hand(rows, 5).items() if d == root}
    assert {r.doc_id for r in outputs[2].collect()} == want


def test_secrets(outputs):
    spans = {r.doc_id: r.spans for r in op04_secret_scans.scan(outputs[2]).collect()}
    want = {r.doc_id: masked(r.text, spans[r.doc_id]) for r in outputs[2].collect()}
    got = {r.doc_id: r for r in outputs[3].collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mixture(outputs):
    rows = [(r.doc_id, len(r.text.encode().split()), r.source) for r in outputs[3].collect()]
    m = op10_source_mixing
    copies, _ = mixture_by_hand(rows, m.TARGET_ENTROPY, m.MAX_REPEATS, m.BUDGET_RATIO)
    got = {r.doc_id: r["count"] for r in outputs[4].groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}


def test_tokens(outputs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=op03_sentencepiece.MODEL)
    want = sorted((r.doc_id, library.encode(r.text)) for r in outputs[4].collect())
    assert sorted((r.doc_id, r.token_ids) for r in outputs[5].collect()) == want


def test_run_is_the_stages_and_takes_odd_rows(spark, outputs, odd_documents, documents_of):
    assert pipeline.run(spark, SF).count() == outputs[5].count()
    for docs in (odd_documents, documents_of([])):
        docs = docs.select(pipeline.COLUMNS)
        for name, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert docs.count() >= 0
