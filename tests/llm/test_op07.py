import zlib

from finfacts.llm import op07_language_id as op


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op.op7_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_backs_off_to_shorter_grams(documents_of):
    rows = [(i, "the house stands there", "en") for i in range(10)] + [(20 + i, "das haus steht dort", "de") for i in range(10)]
    model = op.fit(documents_of(rows))
    scorer = op.Scorer(model)
    assert scorer.predict("haustier")[0] == "de" and scorer.predict("theology")[0] == "en"
    assert scorer.predict("123 ...") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)
    small = op.Scorer(model, room=3)
    long = " ".join(f"haus{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600))
    # A table too small for the new words starts anew; the result is that of a large one.
    small.table = op.np.zeros((small.known + 10_000, 2), op.np.float32)
    small.table[: small.known] = model.word_logs
    assert small.predict(long) == scorer.predict(long)


def test_odd_rows(odd_documents, documents_of):
    model = op.fit(odd_documents)
    rows = op.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    nothing = op.fit(documents_of([]))
    assert {r.lang_pred for r in op.predict(odd_documents, nothing).collect()} == {"und"}
    kept = op.accepted(odd_documents)
    assert kept.columns == odd_documents.columns and not {r.doc_id for r in kept.collect()} & {1, 2, 3}


def test_small_languages_keep_their_words(documents_of):
    many = " ".join("w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000))
    model = op.fit(documents_of([(1, f"{many} {many}", "en"), (2, "das haus steht dort", "de")]))
    words = set(model.words.split("\n"))
    assert len(words) == 60_004 == len(model.word_logs) and {"das", "haus", "steht", "dort"} <= words
    assert len(set(model.grams.split("\n"))) == len(model.gram_logs) and "haus\x03" in model.grams.split("\n")


def test_limits_hold_for_each_language(spark):
    rows = [("en", f"e{i}", 5 if i < 10 else 1) for i in range(2000)] + [("de", f"d{i}", 1) for i in range(20)] + [("de", "e3", 1)]
    kept = {r.word: r.by for r in op.top(spark.createDataFrame(rows, "lang string, word string, n long"), "word", 100).collect()}
    assert {f"e{i}" for i in range(10)} | {f"d{i}" for i in range(20)} <= kept.keys()
    assert 60 <= sum(w[0] == "e" for w in kept) <= 140 and kept["e3"] == {"en": 5, "de": 1}
