import numpy as np
import pytest

from finfacts.checks.compare import difference
from finfacts.llm import op08_embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int, node long, h long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], SCHEMA)


def by_hand(vectors):
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors}
    links = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= op.COSINE] for i in unit}
    root = {}
    for i in sorted(unit):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i]) for i in unit}


@pytest.mark.parametrize("chunk", [2048, 16])
def test_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    vectors, i = [], 0
    for size in (80, 5, 2, 1, 1, 1):
        centre = rng.normal(size=24)
        for _ in range(size):
            vectors.append((i, (centre + rng.normal(size=24) * 0.12).astype(np.float32).tolist()))
            i += 1
    vectors += [(i + k, vectors[k][1]) for k in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.link(frame(spark, vectors), chunk).collect()}
    want = by_hand(vectors)
    # The index may miss links at the threshold; none may be invented.
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.95 * len(want)


def test_equals_sql(spark, oracle, sf_dir):
    assert difference(spark, oracle, "op8", op.op8_embedding_dedup, op.ORACLE, sf_dir) is None


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
               (7, []), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [3.0, 0.0]), (10, [1e30, 0.0]), (11, [-1.0, 0.0])]
    rows = op.link(frame(spark, vectors)).collect()
    assert len(rows) == len(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[10] == (4, 1, False)
    assert got[None] == (4, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11))
    assert op.link(frame(spark, [])).count() == 0


def test_tables_widen_with_the_vectors():
    shapes = [op.shape_of(n) for n in (0, 1, 1_000, 100_000, 10**8)]
    assert [bits for _, bits in shapes] == [16, 16, 16, 20, 30]
    agree = 1 - np.arccos(op.COSINE) / np.pi
    for tables, bits in shapes:
        assert (1 - agree**bits) ** tables <= op.MISSED < (1 - agree**bits) ** (tables - 1)


@pytest.mark.parametrize("tables, bits", [op.shape_of(1_000), op.shape_of(10**6)])
def test_recall_at_the_threshold(tables, bits):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = op.COSINE * a + np.sqrt(1 - op.COSINE**2) * side
    codes = op.fit(a, tables, bits)
    differ = codes.of(a) ^ codes.of(b)
    assert (differ == 0).any(axis=1).mean() >= 0.95
    # The distance of whole codes loses none that a table holds.
    assert (np.bitwise_count(differ).sum(axis=1) <= op.DISTANCE * tables * bits).all()


def test_near_codes_equal_plain_loops():
    rng = np.random.default_rng(4)
    for number, split in ((0, False), (2, True), (3, False)):
        code = rng.integers(0, 4, (5, 9, 4)).astype(np.int32)
        side = rng.integers(0, 2, (5, 9)) if split else np.full((5, 9), 2)
        got = op._within(number, side, code, 3)
        for k in range(5):
            for x in range(9):
                want = any(
                    x != y and (not split or side[k, x] != side[k, y]) and not (code[k, x, :number] == code[k, y, :number]).any()
                    and sum(int(d).bit_count() for d in code[k, x] ^ code[k, y]) <= 3 for y in range(9))
                assert got[k, x] == want
