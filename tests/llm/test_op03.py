import random

import numpy as np
import pytest

from finfacts.llm import op03_sentencepiece as op


@pytest.fixture(scope="module")
def machine():
    with open(op.MODEL, "rb") as f:
        return op.Machine(op.read_model(f.read()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL)


def test_equals_the_library(machine, library):
    rng = random.Random(5)
    letters = "aàbé ßñ\n\t  .,;:ABCthe ing of 123 的中文字😀▁﷽́ 日本語 русский العربية"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "   ", "\n", "a" * 3000, "<s></s><0x0A>", "\x00x\x00", "▁", " ▁ "]
    for text in texts:
        ids = machine.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        if op.MARK not in text:
            assert machine.decode(ids) == text
        assert machine.decode(ids) == text.replace(op.MARK, " ")


def paths(machine, text, at=op.BEGIN, last=op.NOTHING):
    """Every path of finite weight from a state to the input's end, by plain recursion."""
    if at == len(text):
        return [(0.0, [])]
    return [(weight + more, [symbol, *rest])
            for end, symbol, weight in machine.steps(text, at) if not machine.model.merges or machine.follows(last, symbol)
            for more, rest in paths(machine, text, end, symbol)]


def test_a_merge_model_has_one_path(machine):
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("thesaingmorxü的 ") for _ in range(rng.randint(1, 14)))
        assert [p for _, p in paths(machine, text)] == [machine.shortest(text)]


def test_a_unigram_model_takes_the_least_weight():
    rng = random.Random(8)
    pieces = {op.MARK: -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.3, op.MARK + "a": -3.9, "aba": -5.0, "bb": -4.6}
    names = [*pieces, *(f"<0x{i:02X}>" for i in range(256))]
    model = op.Model(tuple(names), tuple(pieces.get(p, 0.0) for p in names),
                     tuple(op.NORMAL if p in pieces else op.BYTE for p in names), False)
    machine = op.Machine(model)
    for _ in range(200):
        text = "".join(rng.choice("aabb é") for _ in range(rng.randint(1, 9)))
        least, _ = min(paths(machine, text))
        taken = machine.shortest(text)
        assert sum(machine.cost[s] if s >= 0 else machine.unknown_cost for s in taken) == pytest.approx(least)
        assert "".join(map(machine.text_of, taken)) == op.MARK + text.replace(" ", op.MARK)
        assert machine.decode(machine.encode(text)) == text


def test_normaliser_and_bytes_are_arcs(machine, library):
    assert machine.steps("a", op.BEGIN)[0][0] == 0
    assert machine.steps(" a", 0) == machine.steps(op.MARK + "a", 0)
    symbols = machine.shortest("\U0001f9ff", 0)
    assert symbols == [-1 - 0x1F9FF]
    assert np.frombuffer(machine.output(symbols[0]), np.int32).tolist() == [machine.byte[b] for b in "\U0001f9ff".encode()]
    assert np.frombuffer(machine.transduce("x \U0001f9ff"), np.int32).tolist() == library.encode("x \U0001f9ff")


def test_long_part_without_a_cut(machine, library):
    rng = random.Random(12)
    text = "".join(rng.choice("thesaingmor") for _ in range(100_000))
    assert machine.encode(text).tolist() == library.encode(text)


def test_real_texts(documents, library):
    got = {r.doc_id: r for r in op.encode(documents).collect()}
    for r in documents.collect():
        assert got[r.doc_id].token_ids == library.encode(r.text)
        assert got[r.doc_id].n_tokens == len(got[r.doc_id].token_ids) and got[r.doc_id].round_trip


def test_odd_rows(odd_documents, documents_of):
    encoded = op.encode(odd_documents)
    rows = encoded.collect()
    assert len(rows) == odd_documents.count()
    assert all(r.token_ids is None and r.n_tokens is None for r in rows if r.doc_id == 1)
    assert all(r.token_ids == [] and r.round_trip for r in rows if r.doc_id == 2)
    assert [r.round_trip for r in rows if r.doc_id == 8] == [False]  # it holds the word mark itself
    back = sorted((r.doc_id or 0, r.text or "") for r in op.decode(encoded).collect())
    want = sorted((r.doc_id or 0, (r.text or "").replace(op.MARK, " ")) for r in odd_documents.collect())
    assert back == want
    assert op.encode(documents_of([])).count() == 0


def test_cache_stays_bounded(machine, monkeypatch):
    monkeypatch.setattr(op, "PARTS", 50)
    parts = op._Parts(machine)
    for i in range(500):
        parts[f" word{i}"]
    assert len(parts) <= 51 and len(parts.old) <= 51
    assert parts[" word3"] == machine.transduce("▁word3", 0)


def test_parts_are_cut_wherever_no_piece_spans(machine, library):
    text = "reading, (reading) reading... x1reading\nreading  \n \u0434\u0430reading "
    parts = machine.cut.findall(text)
    assert "".join(parts) == text
    assert parts[:7] == ["reading", ",", " (", "reading", ")", " reading", "..."]
    joined = {pair for piece in machine.score for pair in zip(piece, piece[1:])}
    for one, other in zip(parts, parts[1:]):
        pair = one[-1].replace(" ", op.MARK), other[0].replace(" ", op.MARK)
        assert pair not in joined
    assert machine.encode(text).tolist() == library.encode(text)


def test_words_with_new_signs_behind_them_are_searched_once(machine, monkeypatch):
    own = op._Parts(machine)
    monkeypatch.setattr(machine, "parts", own)
    searched = []
    shortest = machine.shortest
    monkeypatch.setattr(machine, "shortest", lambda text, *start: searched.append(text) or shortest(text, *start))
    machine.encode("x" + "".join(f" freinedes{sign}" for sign in ["", ",", ".", "!!", "###", "&&&", "%%%"]))
    assert searched.count(" freinedes") == 1 and not any("freinedes" in t and t != " freinedes" for t in searched)


def test_pieces_that_span_marks_or_lines_are_never_cut():
    def machine_of(*pieces):
        names = [*pieces, *(f"<0x{i:02X}>" for i in range(256))]
        return op.Machine(op.Model(tuple(names), (-1.0,) * len(names),
                                   tuple(op.NORMAL if p in pieces else op.BYTE for p in names), False))

    spanning = machine_of(op.MARK, "a", "b", "a" + op.MARK + "b")
    assert spanning.cut.findall("a b\na") == ["a b\na"]
    assert spanning.encode("a b").tolist() == [0, 3]
    lines = machine_of(op.MARK, "a", "\n", "a\n", "]", "-^")
    assert lines.cut.findall("a\na ]-^") == ["a\na", " ]", "-^"]
    assert lines.encode("a\na").tolist() == [0, 3, 1]
