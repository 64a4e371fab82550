import hashlib
import itertools

import numpy as np
import pytest

from finfacts.checks.compare import difference, oracle_connection
from finfacts.llm import op12_vector_codes as op

SCHEMA = "vec_id long, embedding array<double>, label int, part int, row_id long, vec string, error long"


def brute(rows):
    """rows: (vec_id, vector, label); the contract in plain whole numbers, vectors of one length."""
    kept = [(i, [int(x * 1024 // 1) if abs(x) < 2**50 else int(x) * 1024 for x in v], g) for i, v, g in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(kept[0][1])
    cuts = [i * d // 4 for i in range(5)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[a:b] for _, v, _ in order[:256]] for a, b in zip(cuts, cuts[1:])]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(4):
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(v[a:b], books[part])[1], []).append(v[a:b])
            books[part] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old
                           for e, old in enumerate(books[part])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for i, v, g in kept:
        best = [near(v[a:b], book) for a, b, book in zip(cuts, cuts[1:], books)]
        out.append((i, g, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best)))
    sums = {}
    for _, g, _, e in out:
        sums[g] = sums.get(g, 0) + e
    return [(i, g, code, e, sums[g], sha) for i, g, code, e in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 9, 9, "x", 9) for i, v, g in rows], SCHEMA)


def got(spark, rows):
    return sorted(map(tuple, op.compress(frame(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = op.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlist_keeps_every_nearest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        values = rng.integers(-40, 40, (20, 3)) + rng.integers(-200, 200, 3)
        entries = rng.integers(-250, 250, (30, 3))
        chosen = op.shortlist(values.min(axis=0), values.max(axis=0), entries)
        at, error = op.nearest(values, entries[chosen])
        all_at, all_error = op.nearest(values, entries)
        assert (chosen[at] == all_at).all() and (error == all_error).all()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(rng.integers(4)) or None) for i in rng.permutation(700)]
    rows += [(int(i), rows[3][1], 1) for i in range(700, 1100)]  # one hot vector
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 1.0], 1) for i in range(300)]
    assert got(spark, rows) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30, 1e300])
def test_wide_values_are_exact(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) * scale for x in rng.normal(size=4)], 1) for i in range(40)]
    want = [(i, g, c, *(x if x < 2**63 else None for x in (e, s)), sha) for i, g, c, e, s, sha in brute(rows)]
    assert got(spark, rows) == sorted(want, key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.1, -0.2, 0.3, 0.4], None), (1, [0.1, -0.2, 0.3, 0.4], None), (None, [5.0, 5.0, 5.0, 5.0], 2),
             (2, [-0.0001, 0.0, 0.0, 0.0], 2)]
    bad = [(3, None, 1), (4, [0.1, None, 0.3, 0.4], 1), (5, [nan] * 4, 1), (6, [inf, 0.0, 0.0, 0.0], 1)]
    assert got(spark, sound + bad) == sorted(brute(sound), key=str)
    mixed = sound + [(7, [1.0] * 6, 2), (8, [], 2)]
    rows = {r[0]: r for r in got(spark, mixed)}
    assert len(got(spark, mixed)) == 6 and rows[8][2:4] == ("00000000", 0) and rows[7][2:4] == ("00000000", 0)
    assert got(spark, bad) == [] and got(spark, []) == []


def test_equals_sql(spark, sf_dir):
    problem = difference(spark, oracle_connection(sf_dir), "op12", op.op12_vector_codes, op.ORACLE, sf_dir)
    assert problem is None, problem
