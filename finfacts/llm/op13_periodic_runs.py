"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix grouping, roots extended into runs.

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal), at least
``min_words`` long and ``min_exponent`` periods. For each of two opposite orders of the words, the grouping phase
of Baier's suffix sorter is run: suffixes start in groups by first word, and groups are taken from the highest down;
each member i of a group points at prev(i), the nearest position before it in a lower group; pointed positions are
split off to the top of their groups by the number of pointers, and their context grows by as many copies of the
group's context. A suffix's last context is its longest Lyndon prefix, so the phase ends with the Lyndon array, and
no suffix array is made. The Lyndon root of every run stands in one of the two arrays; it is extended to both sides
by comparing words (LCE).

Only stretches in which a run can lie are grouped. A run of 24 words and three periods is covered by windows of
``WINDOW`` = 8 words each of which occurs again a period away; stretches without such windows hold no run. Windows
are hashed, so a collision adds a stretch and never loses one. Roots are kept by prefix hashes first and then
compared word by word. Time grows with the text (times a logarithm for sorting windows), memory is about 100 bytes a
word of one text; a text is one row and stays in one task, nothing is shuffled.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows are
judged each, null ids stay null, extra columns are not read. Ties (runs of equal exponent) are told apart by
start, then period. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table, windows

MIN_WORDS, MIN_EXPONENT = 24, 3
#: A run of n words covers itself with repeated windows if n >= 2 * period + WINDOW - 1.
WINDOW = 8
ROWS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position, by Baier's grouping of suffixes.

    Groups are intervals of ``order``; ``group[i]`` is the start of i's interval. A set that is split off moves to the
    end of its interval, so starts of what stays behind do not change.
    """
    n = len(ranks)
    by_rank = np.argsort(ranks, kind="stable").astype(np.int32)
    sorted_ranks = ranks[by_rank]
    starts = np.flatnonzero(np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]]).astype(np.int32)
    sizes = np.diff(np.r_[starts, n]).astype(np.int32)
    first = np.empty(n, np.int32)
    first[by_rank] = np.repeat(starts, sizes)
    place_of = np.empty(n, np.int32)
    place_of[by_rank] = np.arange(n, dtype=np.int32)
    size_at, length_at = np.zeros(n, np.int32), np.zeros(n, np.int32)
    size_at[starts], length_at[starts] = sizes, 1
    order, place, group, size, length = (array("i", x.tobytes()) for x in (by_rank, place_of, first, size_at, length_at))
    prev = array("i", bytes(4 * n))

    def split(members: list[int], home: int, grown: int) -> None:
        """Move members of the group at ``home`` to a group of their own at its end, with a longer context."""
        left = size[home] - len(members)
        if not left:
            length[home] += grown
            return
        start = home + left
        to = start
        for j in members:
            at, other = place[j], order[to]
            order[at], place[other] = other, at
            order[to], place[j] = j, to
            group[j] = start
            to += 1
        size[home], size[start], length[start] = left, len(members), length[home] + grown

    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                split([p], group[p], length[start])
        else:
            pointers: dict[int, int] = {}
            for i in sorted(order[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            sets: dict[tuple[int, int], list[int]] = {}
            for j, times in pointers.items():
                sets.setdefault((-times, group[j]), []).append(j)
            for (times, home), members in sorted(sets.items()):
                split(members, home, -times * length[start])
        end = start
    return np.frombuffer(length, np.int32)[np.frombuffer(group, np.int32)]


def _same(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from i and j on, in the direction of ``step``; chunks double, so long runs cost little."""
    total, width = 0, 16
    while True:
        if step > 0:
            width = min(width, len(words) - j)
            a, b = words[i : i + width], words[j : j + width]
        else:
            width = min(width, i + 1)
            a, b = words[i + 1 - width : i + 1][::-1], words[j + 1 - width : j + 1][::-1]
        if width <= 0:
            return total
        differ = a != b
        if differ.any():
            return total + int(differ.argmax())
        total += width
        i, j, width = i + step * width, j + step * width, 2 * width


def _stretches(words: np.ndarray, min_words: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Intervals [a, b) that may hold a run: covered by windows with an equal one near enough for the periods."""
    grams = windows(mix(words.astype(np.uint64) + np.uint64(1)), WINDOW)
    by_gram = np.argsort(grams, kind="stable")
    ordered = grams[by_gram]
    twin = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(twin):
        return
    a, b = by_gram[twin], by_gram[twin + 1]
    near = np.full(len(grams), len(words), np.int64)
    np.minimum.at(near, a, b - a)
    np.minimum.at(near, b, b - a)

    def covered(low: int, high: int) -> Iterator[tuple[int, int]]:
        edges = np.zeros(high - low + 1, np.int32)
        hit = np.flatnonzero(near[low : max(low, high - WINDOW + 1)] * exponent <= high - low)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + WINDOW, -1)
        inside = np.r_[0, (np.cumsum(edges[:-1]) > 0).astype(np.int8), 0]
        change = np.diff(inside)
        for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            if y - x >= min_words:
                yield low + int(x), low + int(y)

    for low, high in covered(0, len(words)):
        # A stretch is shorter than the text, so that its periods are bounded more closely.
        yield from covered(low, high)


def _roots(words: np.ndarray, lengths: np.ndarray, min_words: int, exponent: int) -> np.ndarray:
    """Positions whose Lyndon word may be the first root of a run: what follows agrees with what stands a period on."""
    n = len(words)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
    prefix = np.r_[np.uint64(0), np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * powers[:-1])]
    i, period = np.arange(n), lengths.astype(np.int64)
    # The first root of a run starts less than a period after the run.
    least = np.maximum(min_words - 2 * period + 1, (exponent - 2) * period + 1)
    i = i[i + period + least <= n]
    period, least = period[i], least[i]
    here = prefix[i + least] - prefix[i]
    there = prefix[i + period + least] - prefix[i + period]
    return i[here * powers[period] == there]


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    if exponent < 3 or min_words < 3 * WINDOW:
        raise ValueError("runs of 24 words and three periods at least")
    found = set()
    if len(words) < min_words:
        return []
    for low, high in _stretches(words, min_words, exponent):
        part = np.unique(words[low:high], return_inverse=True)[1].astype(np.int64)
        for ranks in (part, int(part.max()) - part):
            lengths = lyndon_lengths(ranks)
            done: dict[int, int] = {}
            for i in _roots(part, lengths, min_words, exponent).tolist():
                period = int(lengths[i])
                at = low + i
                if at + period < done.get(period, -1):
                    continue  # inside a run of this period that is known
                after = _same(words, at, at + period, 1)
                before = _same(words, at - 1, at + period - 1, -1) if at else 0
                done[period] = at + period + after
                size = before + period + after
                if size >= max(min_words, exponent * period):
                    found.add((at - before, size, period))
    return sorted(found)


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def _search(min_words: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts, runs, texts = [], [], []
                for text in part.column("text").to_pylist():
                    words = text.encode().split() if text else []
                    found = runs_of(_numbers(words), min_words, exponent)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(collapse(words, found)).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (word number, words, period; by start, then period) and the text without repeats."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_search(min_words, exponent), _RUNS)


def with_planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (by crc32 of the id) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("_g"),
        F.when(h % 10 == 0, words).alias("_words"))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))

    def word(x: Column, i: Column) -> Column:
        source = F.col("_a") + (i - F.col("_a")) % F.col("_p")
        return F.when(i < F.col("_a"), x).otherwise(F.get("_words", source.cast("int")))

    planted = F.array_join(F.transform("_words", word), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of greatest exact exponent, and digests of the runs and of the collapsed text."""

    def greater(best: Column, r: Column) -> Column:
        # Cross products are exact; runs come by start, then period, so an equal one never wins.
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    rows = found.withColumn("_best", F.aggregate("runs", F.lit(None).cast(kind), greater))
    best = F.col("_best")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted(table(spark, sf_dir, "documents"))))
