"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines.

* Normaliser: one arc that reads nothing and writes a word mark, then for each character an arc that writes it (a space
  is written as a word mark).
* Pieces: a trie from characters to piece ids. A character that no piece covers has an arc of its own that writes the
  byte pieces of its UTF-8 form, at a cost above all pieces'.
* Pairs, for merge models (BPE): piece b may follow piece a only if merging the text of both leaves exactly a and b. A
  sequence of pieces is the merge result of its text if and only if every neighbouring pair passes this test.

Weights are tropical (they add up along a path; the least path wins). In a unigram model an arc's weight is the negated
score. A merge model's scores only rank its merges: its arcs weigh nothing, and pairs that fail weigh infinity, so the
composed machine has exactly one finite path, the library's own encoding.

The normaliser is composed with the pieces once. Each input is composed with the result and the pairs while a search
with a priority queue (least weight, then furthest position) settles states of (position, last piece), until the
input's end is settled; outputs are read off the arcs of that path. Inputs are cut only between characters that stand
side by side in no piece (before a run of word marks, between a letter and a comma): the path of the whole is the paths
of the parts one after the other, and parts that recur are looked up in a bounded cache. Texts are never shortened; a
part without a cut takes memory in proportion to its length.

Null texts give null ids, empty texts no ids. Decoding joins the pieces' bytes, turns word marks into spaces and drops
the first one. A text that holds the word mark U+2581 itself comes back with a space there; such rows, and only those,
have ``round_trip`` false. Repeated rows are encoded each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import shared, table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"
#: The position before the normaliser's first arc, and the symbol before the first one (below all characters' symbols).
BEGIN, NOTHING = -1, -2_000_000
#: Longest part that the cache keeps, and how many parts one generation of it holds.
PART_LENGTH, PARTS = 48, 400_000
#: The format's numbers for kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    merges: bool


def read_model(data: bytes) -> Model:
    """The pieces of a model file. Rewriting normalisers are refused: none of their tables is compiled here."""
    pieces, scores, kinds, merges = [], [], [], False
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            merges = dict(_fields(value)).get(3, UNIGRAM) == BPE
        elif number == 3:
            rules = dict(_fields(value))
            if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
                raise ValueError("only the identity normaliser with a word mark in front is compiled")
    return Model(tuple(pieces), tuple(scores), tuple(kinds), merges)


class Machine:
    """The compiled transducers; ``encode`` composes a text with them and takes the shortest path."""

    def __init__(self, model: Model):
        self.model = model
        #: What the normaliser writes for a character it does not copy, and before the first one.
        self.normal, self.front = {" ": MARK}, MARK
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind == BYTE:
                self.byte[int(piece[1:-1], 16)] = i
            elif kind in (NORMAL, USER):
                self._add(piece, i)
                self.score[piece] = model.scores[i]
        self._compose()
        self.cut = part_pattern(self.score)
        worst = min(self.score.values(), default=0.0)
        self.cost = [0.0 if model.merges else -s for s in model.scores]
        self.unknown_cost = 0.0 if model.merges else 10.0 - worst
        if min(self.cost, default=0.0) < 0:
            raise ValueError("the search needs weights of zero or more")
        self.longest = max(map(len, self.score), default=1)
        self.ways = self._ways()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.outputs: dict[int, bytes] = {}
        self.parts = _Parts(self)
        self.decoded = [self._bytes(i) for i in range(len(model.pieces))]

    def _compose(self) -> None:
        """Normaliser and pieces as one machine: its arcs read what the normaliser reads."""
        for arcs in self.arcs:
            for read, written in self.normal.items():
                if written in arcs:
                    arcs[read] = arcs[written]
                else:
                    arcs.pop(read, None)

    def _add(self, piece: str, number: int) -> None:
        state = 0
        for char in piece:
            following = self.arcs[state].get(char)
            if following is None:
                following = self.arcs[state][char] = len(self.arcs)
                self.arcs.append({})
                self.final.append(-1)
            state = following
        self.final[state] = number

    def _ways(self) -> list[tuple]:
        """For each state the arcs that its characters take from the start: (length, symbol, weight)."""
        ways, depth = [()] * len(self.arcs), [0] * len(self.arcs)
        # A state's number is above that of the state before it.
        for state, arcs in enumerate(self.arcs):
            for char, following in arcs.items():
                depth[following], piece = depth[state] + 1, self.final[following]
                if piece >= 0:
                    ways[following] = (*ways[state], (depth[following], piece, self.cost[piece]))
                else:
                    ways[following] = ways[state] if state else (self._uncovered(char),)
        return ways

    def _uncovered(self, char: str) -> tuple[int, int, float]:
        return 1, -1 - ord(self.normal.get(char, char)), self.unknown_cost

    def _bytes(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    # -- the pair machine

    def text_of(self, symbol: int) -> str:
        """A symbol is a piece id, or -1 - c for the uncovered character c."""
        return self.model.pieces[symbol] if symbol >= 0 else chr(-1 - symbol)

    def merged(self, text: str) -> list[str]:
        """The text's symbols after all merges, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def follows(self, before: int, after: int) -> bool:
        key = (before, after)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            own = self.text_of(after)
            ahead = [] if before == NOTHING else [self.text_of(before)]
            known = self.pairs[key] = self.merged("".join(ahead) + own) == [*ahead, own]
        return known

    # -- composition and shortest path

    def leaving(self, text: str, start: int) -> tuple:
        """(length, symbol, weight) of the arcs that leave a position of the input; before BEGIN + 1 nothing was read."""
        arcs, first = self.arcs, self.front if start == BEGIN else text[start]
        state = arcs[0].get(first)
        if state is None:
            return (self._uncovered(first),)
        for char in text[start + 1 : start + self.longest]:
            following = arcs[state].get(char)
            if following is None:
                break
            state = following
        return self.ways[state]

    def steps(self, text: str, start: int) -> list[tuple[int, int, float]]:
        """The same arcs as (end, symbol, weight)."""
        return [(start + length, symbol, weight) for length, symbol, weight in self.leaving(text, start)]

    def shortest(self, text: str, start: int = BEGIN) -> list[int]:
        """Symbols of the path of least weight from a start position to the input's end."""
        n, merges, pairs, follows, leaving = len(text), self.model.merges, self.pairs, self.follows, self.leaving
        before: dict[tuple[int, int], tuple] = {}  # settled state -> state before, symbol
        state, weight = (start, NOTHING), 0.0
        queue: list[tuple] = []
        while state[0] < n:
            at = state[0]
            for length, symbol, more in leaving(text, at):
                heappush(queue, (weight + more, -at - length, symbol, state))
            while True:
                weight, end, symbol, last = heappop(queue)
                state = (-end, symbol if merges else 0)
                if state in before:
                    continue
                if merges:
                    fits = pairs.get((last[1], symbol))
                    if not (follows(last[1], symbol) if fits is None else fits):
                        continue
                break
            before[state] = (last, symbol)
        out = []
        while state in before:
            state, symbol = before[state]
            out.append(symbol)
        return out[::-1]

    def output(self, symbol: int) -> bytes:
        """What an arc writes, as 32-bit ids: a piece, or the byte pieces of an uncovered character."""
        known = self.outputs.get(symbol)
        if known is None:
            written = [symbol] if symbol >= 0 else [self.byte[b] for b in chr(-1 - symbol).encode()]
            known = self.outputs[symbol] = np.array(written, np.int32).tobytes()
        return known

    def transduce(self, text: str, start: int = BEGIN) -> bytes:
        return b"".join(map(self.output, self.shortest(text, start)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = self.cut.findall(text)
        return np.frombuffer(self.transduce(parts[0]) + b"".join(map(self.parts.__getitem__, parts[1:])), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.decoded
        data = b"".join([table[i] for i in ids.tolist()])
        return data.decode(errors="replace").removeprefix(" ")


def part_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts that no piece leaves: a run of spaces and word marks, and behind it a run of characters that pieces link
    (directly or by others), or one character that they do not."""
    linked: dict[str, str] = {}

    def root(char: str) -> str:
        while linked.setdefault(char, char) != char:
            linked[char] = char = linked[linked[char]]
        return char

    for piece in pieces:
        body = piece.lstrip(MARK)
        if MARK in body:
            return re.compile(".+", re.S)
        for one, other in zip(body, body[1:]):
            linked[root(one)] = root(other)
    classes: dict[str, list[str]] = {}
    for char in sorted(linked):
        classes.setdefault(root(char), []).append(char)
    runs = [f"[{re.escape(''.join(chars))}]+" for chars in sorted(classes.values(), key=len, reverse=True)]
    return re.compile(f"[ {MARK}]*(?:{'|'.join([*runs, '.'])})", re.S)


class _Parts(dict):
    """Encoded parts behind the first one (bytes of 32-bit ids) in two generations: what was used lately survives
    when one is full."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.machine.transduce(part, 0)
        if len(part) <= PART_LENGTH:
            if len(self) >= PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


def encode(documents: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (the decoded ids equal the text) of every document."""
    with open(model_path, "rb") as f:
        model = read_model(f.read())
    opened = shared(documents.sparkSession, model, Machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = opened()
        for batch in batches:
            # A few hundred documents at a time, so that ids never fill the memory.
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                texts = piece.column("text").to_pylist()
                ids = [machine.encode(t) if t is not None else None for t in texts]
                same = [None if t is None else machine.decode(x) == t for t, x in zip(texts, ids)]
                sizes = [len(x) if x is not None else 0 for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)]), pa.int32())
                arrays = pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                     arrays, pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, token_ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = read_model(f.read())
    opened = shared(encoded.sparkSession, model, Machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = opened()
        for batch in batches:
            texts = [None if ids is None else machine.decode(np.array(ids, np.int64)) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
