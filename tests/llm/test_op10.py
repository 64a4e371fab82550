import hashlib
import math
from collections import defaultdict

import pytest

from finfacts.llm import op10_source_mixing as op


def by_hand(rows, target, most, ratio):
    """rows: (doc_id, n_tokens, source); returns copies by doc_id, by plain bisection over the exponents' grid."""
    n = defaultdict(int)
    for _, tokens, source in rows:
        n[source] += tokens
    n = {s: v for s, v in n.items() if v}
    total, budget = sum(n.values()), int(sum(n.values()) * ratio)

    def weights(e):
        z = sum((v / total) ** e for v in n.values())
        return {s: (v / total) ** e / z for s, v in n.items()}

    entropy = lambda e: -sum(w * math.log(w) for w in weights(e).values())
    repeats = lambda e: max(w * budget / n[s] for s, w in weights(e).items())
    grid = 2**op.STEPS
    e = grid
    if target is not None and entropy(1.0) < target * math.log(len(n)):
        low, high = 0, grid
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if entropy(mid / grid) >= target * math.log(len(n)) else (low, mid)
        e = low
    if most is not None and repeats(e / grid) > most:
        low, high = 0, grid
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if repeats(mid / grid) <= most else (mid, high)
        e = high if repeats(0.0) > most else 0
    out = {}
    for source, w in weights(e / grid).items():
        epochs, rest = divmod(math.floor(w * budget), n[source])
        key = lambda d: hashlib.md5(f"{op.SEED}:{d}".encode()).hexdigest()
        docs = sorted((int(key(d)[:8], 16) % op.BLOCKS, key(d), d, t) for d, t, s in rows if s == source)
        before = 0
        for _, _, d, t in docs:
            out[d] = (epochs + (before < rest)) if t else 0
            before += t
    return {d: out.get(d, 0) for d, _, _ in rows}, e / grid


@pytest.mark.parametrize("target,most,ratio", [(0.9, 4.0, 1.0), (0.99, None, 2.0), (None, 1.5, 1.0), (0.999, 1.2, 1.0)])
def test_equals_brute_force(documents_of, target, most, ratio):
    sizes = {"a": 300, "b": 60, "c": 10, "d": 3}
    rows, doc = [], 0
    for source, n in sizes.items():
        for i in range(n):
            rows.append((doc, 1 + (doc * 7) % 13, source))
            doc += 1
    docs = documents_of([(d, "w " * t, "en", s) for d, t, s in rows])
    got = {r.doc_id: r.copies for r in op.mix(op.numbered(docs), target, most, ratio).collect()}
    assert got == by_hand(rows, target, most, ratio)[0]


def test_budget_and_targets_hold(spark):
    rows = op.mix(op.numbered(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), 0.9, 4.0, 1.0)
    per = rows.groupBy("source").agg({"n_tokens": "sum"}).count()
    sums = rows.selectExpr("sum(n_tokens) n", "sum(n_tokens * copies) m", "max(copies) c").first()
    assert per == 20 and sums.c <= 5
    assert abs(sums.m - sums.n) <= 0.05 * sums.n


def test_odd_rows(odd_documents, documents_of):
    out = op.mix(op.numbered(odd_documents)).collect()
    assert len(out) == odd_documents.count()
    assert all(r.copies == 0 for r in out if r.n_tokens == 0)
    again = op.realise(odd_documents)
    assert again.columns == odd_documents.columns
    assert again.count() == sum(r.copies for r in out)
    assert op.mix(op.numbered(documents_of([]))).count() == 0
    assert op.realise(documents_of([])).count() == 0
    assert op.mix(op.numbered(documents_of([(1, None), (2, "")]))).selectExpr("sum(copies)").first()[0] == 0
