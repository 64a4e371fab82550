from finfacts.checks.compare import difference
from finfacts.llm import op02_quality_rules as op


def repeated_by_hand(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_equals_sql(spark, oracle, sf_dir):
    assert difference(spark, oracle, "op2", op.op2_quality_rules, op.ORACLE, sf_dir) is None


def test_repeated_words():
    import random

    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 15, 16, 17, 60):
        words = [rng.choice([b"a", b"b"]) for _ in range(n)]
        assert op.repeated_words(words) == repeated_by_hand(words)


def test_boilerplate_depletes(documents_of):
    line = "All rights reserved by the owner of this page, see terms"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{line}\n{body(i)}", "en", "h1") for i in range(11)]
    # Mostly boilerplate, in other case and spacing; the same lines on another host; few and many copies of one text.
    rows += [(20, f"{line.upper()}  \n" * 3 + "a b c d e", "en", "h1"), (21, f"{line}\n{body(21)}", "en", "h2")]
    rows += [(30 + i, body(99) + "\nshared line of copies only here", "en", "h3") for i in range(10)]
    rows += [(100 + i, body(77), "en", "h4") for i in range(40)] + [(140, body(77), "en", "h5")]
    # Repeated rows of one document are one document.
    rows += [(50, body(55), "en", "h6")] * 15
    got = {r.doc_id: r for r in op.judge(documents_of(rows)).collect()}
    assert all(got[i].kept and got[i].n_boilerplate_words == 11 for i in range(11))
    assert not got[20].kept and got[20].n_boilerplate_words == 33
    assert got[21].n_boilerplate_words == 0
    assert all(got[30 + i].kept and got[30 + i].n_boilerplate_words == 0 for i in range(10))
    # Copies are documents too: a text that 40 documents of a host hold is boilerplate there.
    assert all(not got[100 + i].kept and got[100 + i].n_boilerplate_words == 30 for i in range(40))
    assert got[140].kept and got[50].kept and got[50].n_boilerplate_words == 0


def test_cleaned_texts(documents_of):
    line = "All rights reserved by the owner of this page, see terms"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{line}\n{body(i)}\n\nend {line.upper()}", "en", "h1") for i in range(12)] + [(20, "short", "en", "h1"), (21, None)]
    docs = documents_of(rows)
    out = op.cleaned(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.kind, r.row_id) for r in out.collect()} == {i: (f"{body(i)}\n", None, 2) for i in range(12)}
    assert op.cleaned(documents_of([])).count() == 0


def test_odd_rows(odd_documents, documents_of):
    rows = op.judge(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert op.judge(documents_of([])).count() == 0
