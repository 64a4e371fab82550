import math
import zlib

import numpy as np
import pytest

from finfacts.llm import op11_quality_classifier as op

LABELS = "doc_id long, quality int, toxic int, x int, y int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    # Ties count half.
    ranks = np.array([np.mean(order[scores == s]) for s in scores])
    ones = labels == 1
    return (ranks[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op.op11_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    scores, labels = np.array([r.score for r in out]), np.array([r.quality for r in out])
    assert len(out) > 800
    assert auc(scores, labels) > 0.98
    assert np.mean((scores >= 0.7) == labels) > 0.97


def test_equals_dense_algebra(spark, documents):
    """Normal equations over partitions against one matrix, calibration and scores recomputed row by row."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(d for d in known if d in texts and not held(d))
    x = np.array([[round(v / op.STEP) for v in op.statistics(texts[d])] for d in ids], float)
    y = np.array([known[d] for d in ids], float)
    mean, spread = x.mean(axis=0) * op.STEP, np.maximum(x.std(axis=0) * op.STEP, 1e-3)
    features = op.Features((mean, spread, op.FEATURES))
    z = features.of(x) * op.COSINE_STEP
    fold = np.array([zlib.crc32(str(d).encode()) // 4 % op.FOLDS for d in ids])

    def ridge(rows):
        penalty = np.diag([op.RIDGE * rows.sum()] * op.FEATURES + [1e-9])
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])

    low, high = op.RANGE
    place = lambda r: (np.clip(r, low, high) - low) / (high - low) * (op.BINS - 1)
    unseen = np.array([z[i] @ ridge(fold != fold[i]) for i in range(len(z))])
    bins = np.round(place(unseen)).astype(int)
    counts, ones = np.bincount(bins, minlength=op.BINS), np.bincount(bins, y, op.BINS).astype(int)
    weights = ridge(fold >= 0)
    at = np.flatnonzero(counts)
    share = np.array([max(min(ones[a : b + 1].sum() / counts[a : b + 1].sum() for b in at[at >= i])
                          for a in at[at <= i]) for i in at])
    got = {r.doc_id: r.score for r in op.classify(docs.repartition(7), labels, ~(op.F.crc32(op.F.col("doc_id").cast("string")) % 4 == 2)).collect()}
    order = sorted(texts)
    all_x = np.array([[round(v / op.STEP) for v in op.statistics(texts[d])] for d in order], float)
    want = np.interp(place(features.of(all_x) * op.COSINE_STEP @ weights), at, share)
    assert np.abs(want - np.array([got[d] for d in order])).max() < 1e-3


@pytest.mark.parametrize("seed", range(20))
def test_pools_by_min_max(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 4, 40)
    ones = np.array([rng.integers(0, c + 1) for c in counts])
    at = np.flatnonzero(counts)
    for i in at:
        want = max(min(ones[a : b + 1].sum() / counts[a : b + 1].sum() for b in at[at >= i]) for a in at[at <= i])
        value = next(v for a, b, v in op.pooled(counts, ones) if a <= i <= b)
        assert math.isclose(value, want)


def test_same_result_for_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    used = op.F.col("doc_id") % 2 == 0
    a, b = (dict(map(tuple, op.classify(docs.repartition(n), labels, used).collect())) for n in (1, 13))
    assert a == b and len(set(a.values())) > 2


def test_learns_only_what_it_may(spark, documents_of):
    docs = documents_of([(i, ("good words here. " if i % 2 else "## ** %% ") * (3 + i % 5)) for i in range(400)])
    rows = [(i, i % 2, None, 1, 1) for i in range(0, 400, 4)] + [(i, i % 2, None, 1, 1) for i in range(1, 400, 4)]
    wrong = [(i, 1 - i % 2, None, 1, 1) for i in range(200, 400)]
    labels = spark.createDataFrame(rows + wrong, LABELS)
    out = {r.doc_id: r.score for r in op.classify(docs, labels, op.F.col("doc_id") < 200).collect()}
    assert all((s > 0.7) == (i % 2 == 1) for i, s in out.items())


def test_odd_rows(spark, odd_documents, documents_of):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(1, 0, 0, 1, 1), (2, None, 0, 1, 1), (5, 1, 0, 1, 1), (5, 0, 0, 1, 1), (7, 1, 0, 1, 1),
                                  (None, 1, 0, 1, 1), (99, 1, 0, 1, 1), (4, 1, 0, 1, 1), (6, 5, 0, 1, 1)], LABELS)
    every = op.F.lit(True)
    assert {r.score for r in op.classify(odd_documents, none, every).collect()} == {0.5}
    rows = op.classify(odd_documents, some, every).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert op.classify(documents_of([]), some, every).count() == 0
    assert op.statistics(None) == op.statistics("") == op.statistics(" \n") == [0.0] * len(op.STATISTICS)
