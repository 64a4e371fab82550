import hashlib
import random
import zlib

import numpy as np
import pytest

from finfacts.llm import op13_periodic_runs as op


def brute_lyndon(ranks):
    """By definition: the longest prefix of each suffix that is smaller than all its own proper suffixes."""
    out = []
    for i in range(len(ranks)):
        best = 1
        for j in range(i + 2, len(ranks) + 1):
            w = ranks[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best)
    return out


def brute_runs(words, min_words=24, exponent=3):
    """Every period's longest stretches of equality; a stretch counts for its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(min_words, exponent * q):
                found.setdefault((i, size), q)
            i = j
    return sorted((s, size, q) for (s, size), q in found.items())


def brute_row(doc_id, text):
    words = text.encode().split() if text else []
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_array_by_definition():
    rng = random.Random(1)
    for _ in range(400):
        ranks = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 25))]
        dense = np.unique(ranks, return_inverse=True)[1]
        assert op.lyndon_lengths(dense).tolist() == brute_lyndon(dense.tolist()), ranks


def pieces(rng):
    words = []
    while len(words) < 150:
        root = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 14))]
        words += root * rng.randrange(1, 7) + root[: rng.randrange(len(root) + 1)]
        words += [rng.randrange(50) for _ in range(rng.randrange(6))]
    return words


@pytest.mark.parametrize("seed", range(150))
def test_runs_by_definition(seed):
    words = pieces(random.Random(seed))
    assert op.runs_of(np.array(words)) == brute_runs(words)


@pytest.mark.parametrize("word", ["fibonacci", "thue", "one", "nested"])
def test_runs_of_known_words(word):
    if word == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 900:
            a, b = b, b + a
    elif word == "thue":
        b = [bin(i).count("1") % 2 for i in range(800)]
    elif word == "one":
        b = [7] * 500
    else:
        unit = [0, 0, 0, 1] * 9 + [2]
        b = (unit * 5 + [3]) * 4
    assert op.runs_of(np.array(b)) == brute_runs(b)


def test_long_text_of_one_period():
    words = np.arange(400_000) % 99_991
    assert op.runs_of(words) == [(0, 400_000, 99_991)]
    assert op.runs_of(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = op.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.doc_id]
    assert sum(r.n_runs > 0 for r in got) > 10


def test_odd_rows(odd_documents, documents_of):
    rows = op.digests(op.periodic_runs(op.with_planted(odd_documents))).collect()
    assert len(rows) == odd_documents.count()
    want = sorted((brute_row(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id != 7), key=str)
    assert sorted((tuple(r) for r in rows if r.doc_id != 7), key=str) == want
    assert op.digests(op.periodic_runs(op.with_planted(documents_of([])))).count() == 0


def test_texts_and_spans(documents_of):
    text = "start\there " + "one two three\n" * 10 + "end"
    row = op.periodic_runs(documents_of([(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(2, 30, 3)]
    assert row.collapsed == "start here one two three end" and row.n_words == 33
