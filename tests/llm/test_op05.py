import random

from finfacts.checks.compare import difference
from finfacts.llm import op05_minhash as op
from finfacts.llm.components import components


def by_hand(rows, width, percent=80):
    sets = {}
    for doc_id, text in rows:
        w = text.encode().lower().split() if text else []
        if w:
            sets[doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: (len(sets.get(d, ())), find(d)) for d in root}


def variants(seed=1, n=120):
    """Chains of edited copies, borderline ones among them, exact copies, and short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        for _ in range(n // 6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((doc, " ".join(copy)))
            if rng.random() < 0.5:
                base = copy
            doc += 1
    rows += [(doc + i, t) for i, t in enumerate(["one two", "ONE  two", "one two three", "", " ", "one two three four"])]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(documents_of):
    rows = variants()
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.link(documents_of(rows), width).collect()}
        assert got == by_hand(rows, width)


def graded(seed=3):
    """One large group: copies of one text with 0 to 9 edits, some of them edited on from others, so that copies with
    few edits link, those with many link with nothing, and a few are linked by chains."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    made = [base]
    for i in range(260):
        copy = list(rng.choice(made) if i % 5 == 0 else base)
        for _ in range(i % 10):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        made.append(copy)
    rows = [(i, " ".join(c)) for i, c in enumerate(made)]
    rng.shuffle(rows)
    return rows


def test_large_group_equals_brute_force(documents_of):
    rows = graded()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.link(documents_of(rows)).collect()}
    want = by_hand(rows, 4)
    assert got == want
    assert 20 < len({c for _, c in want.values()}) < 200


def test_edited_copies_are_not_paired_up(spark, documents_of):
    """Copies that link with nothing meet nobody in their prefixes, however many they are."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(200):
        copy = list(base)
        for at in rng.sample(range(0, 150, 5), 8):
            copy[at] = f"e{i}_{at}"
        rows.append((i, " ".join(copy)))
    texts = spark.createDataFrame([(i, t) for i, t in rows], "node long, text string")
    nodes = spark.createDataFrame([(i, i, len(op.shingles(t, 4, op.HashCache()))) for i, t in rows], "node long, component long, n long")
    assert op._prefixes(nodes, texts, 4, 80).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a + " more"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, near, 5), (9, "", 6), (9, "", 7), (9, None, 8), (None, a, 9), (None, a, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int").withColumn("text_key", op.F.lit(1))
    kept = op.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        (str(d), str(t)) for d, t in [(3, a), (5, b), (9, ""), (9, None), (None, a), (None, a)])


def test_equals_sql(spark, oracle, sf_dir):
    assert difference(spark, oracle, "op5", op.op5_minhash, op.ORACLE, sf_dir) is None


def test_odd_rows(odd_documents, documents_of):
    rows = op.link(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 9)} == {5}
    assert [r.kept for r in rows if r.doc_id == 9] == [False]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert op.link(documents_of([])).count() == 0
    kept = op.deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_parities_never_exceed_the_difference():
    rng = op.np.random.default_rng(1)
    for n in (1, 50, 3000):
        a, b = (rng.integers(0, 2**63, n).astype(op.np.uint64) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in op.parities(a) ^ op.parities(b))
        assert apart <= len(op.np.setxor1d(a, b))


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (139, 200), (200, 100)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
