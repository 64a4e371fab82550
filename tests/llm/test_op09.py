import hashlib
import random

import pytest

from finfacts.checks.compare import difference
from finfacts.llm import op09_substring_dedup as op


def by_hand(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = text.encode().split() if text else []
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc_id] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randint(18, 70))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            words += p[rng.randint(0, 3) :]
        if rng.random() < 0.1:
            words += ["same"] * rng.randint(15, 60)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_equals_brute_force(documents_of, heavy):
    rows = texts(4, 150)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op.remove_repeats(documents_of(rows), heavy).collect()}
    assert got == by_hand(rows)


def test_texts_and_spans(documents_of):
    rows = texts(9, 120)
    by_id = dict(rows)
    digests = {d: (n, sha) for d, (_, n, sha) in by_hand(rows).items()}
    for r in op.deduplicated(documents_of(rows)).collect():
        words = by_id[r.doc_id].split()
        gone = {i for s in r.spans for i in range(s.start, s.start + s.length)}
        assert r.text == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (len(gone), hashlib.sha256(r.text.encode()).hexdigest()) == digests[r.doc_id]
        # Maximal: spans neither overlap nor touch.
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
    passage = " ".join(f"p{i}" for i in range(300))
    out = op.deduplicated(documents_of([(1, passage), (2, "x " + passage + " y"), (3, None)])).orderBy("doc_id").collect()
    assert [(r.text, [tuple(s) for s in r.spans]) for r in out] == [(passage, []), ("x y", [(1, 300)]), ("", [])]


def test_texts_without_an_id_are_documents(documents_of):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{passage} {i}") for i in range(50)] + [(7, passage), (None, None), (None, "")]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in op.remove_repeats(documents_of(rows), heavy=3).collect()]
    assert sorted(got, key=str) == sorted([(None, 31, 30)] * 50 + [(7, 30, 0), (None, 0, 0), (None, 0, 0)], key=str)


def test_equals_sql(spark, oracle, sf_dir):
    assert difference(spark, oracle, "op9", op.op9_substring_dedup, op.ORACLE, sf_dir) is None


def test_groups_across_batches(documents_of, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_equals_brute_force(documents_of, 20_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(odd_documents, documents_of):
    rows = op.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == (0, 0, empty) for r in rows if r.doc_id in (1, 2, 3))
    long = " ".join(f"v{i}" for i in range(40))
    # Identical rows count as one document; a null doc_id comes last.
    got = [(r.doc_id, r.n_removed) for r in op.remove_repeats(documents_of([(1, long), (1, long), (None, long), (2, long)])).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 40), (None, 40)]
    assert op.remove_repeats(documents_of([])).count() == 0
