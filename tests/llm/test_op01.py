import zlib

import numpy as np

from finfacts.llm import op01_toxicity as op


def chain_by_hand(emission, first, trans):
    """Marginals by summing over every labelling of every text."""
    out = np.empty(len(emission))
    starts = [*np.flatnonzero(first), len(emission)]
    for a, b in zip(starts, starts[1:]):
        total, ones = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            w = np.prod([emission[a + i] if v else 1.0 for i, v in enumerate(y)])
            w *= np.prod([trans[y[i], y[i + 1]] for i in range(len(y) - 1)])
            total += w
            ones += w * np.array(y)
        out[a:b] = ones / total
    return out


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = [1, 5, 9, 2, 11, 1]
    first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
    emission = np.exp(rng.normal(size=len(first)) * 2)
    trans = np.exp(rng.normal(size=(2, 2)))
    old, op.BLOCK = op.BLOCK, 4
    try:
        alpha, beta, _ = op.sweep(emission, first, trans)
    finally:
        op.BLOCK = old
    both = alpha * beta
    assert np.allclose(both[:, 1] / both.sum(1), chain_by_hand(emission, first, trans))


def test_held_out_accuracy_and_spans(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op.op1_toxicity(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    found = [r for r in held if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in found) >= 0.7 * len(found)
    clean = [r for r in held if labels[r.doc_id] == 0]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    for r in rows:
        for span in filter(None, r.toxic_spans.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[r.doc_id][a:b].strip() == texts[r.doc_id][a:b] != ""


def test_odd_rows(spark, documents_of, odd_documents):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op.fit(odd_documents, labels)
    assert op.score(odd_documents, model).count() == odd_documents.count()
    none = op.fit(documents_of([]), labels)
    assert none is None
    assert {r.score for r in op.score(odd_documents, none).collect()} == {0.0}


def test_no_document_fits_into_a_prefix(documents_of):
    names = ["=vile"]
    model = op.fit_field([(["a"] * 8 + ["vile"] + ["b"] * 8, 1), (["a"] * 17, 0)] * 20, names)
    model.score = np.array([-3.0, 6.0, 0.0, 0.0])
    text = "word " * 50_000 + "vile"
    r = op.score(documents_of([(1, text), (2, "word " * 50_000)]), model).orderBy("doc_id").collect()
    assert r[0].toxic_spans == f"{len(text) - 4}:{len(text)}" and r[1].toxic_spans == ""
    assert r[0].score > r[1].score
