"""Substring dedup: words covered by a 20-word window that also starts earlier are removed.

This is not a suffix tree: suffixes of every position would move the corpus many times over, so 20-word windows are
hashed and grouped by a prefix. Equal windows are what the nodes of such a tree at depth 20 would be; all leaves of a
node but the earliest mark their window. Windows are grouped at content-chosen starts: of the 15 runs of 6 words inside a window,
the one of least hash is its anchor, whatever document it stands in. Equal windows have equal anchors, so

1. anchors that stand once in the corpus are dropped with all the windows they own (a count, combined in the tasks);
2. the occurrences of the others are grouped by prefix: the anchor's 6 words. A prefix with more than ``HEAVY``
   occurrences is split further, by document first (each part keeps only the earliest leaf of every node) and then by
   the full 20 words, so no group outgrows a task;
3. a group is read in the order of its suffixes' starts, as a sorted stream that Spark may spill: a window seen before
   in its group is a deep internal node, and its later leaves are marked;
4. marks return to their documents, whose covered words are removed. Overlapping and touching windows make one span.

A window is known by the 128 bits of its anchor's and its own hash. Texts are read whole and move compressed.

Order: doc_id, then the text's hash (for a doc_id with several texts), then the start; null doc_ids come last, each text
of them as a document of its own. doc_ids are below 2^62.
Identical rows count as one document and get its result each. Null and empty texts have no words.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HashCache, discard, stored, table, windows

WORDS, ANCHOR = 20, 6
HEAVY = 20_000
#: Rows without a doc_id are ordered from here on, by their text.
_LAST = 2**62


def anchors_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ANCHOR words, for each window the position of its anchor)."""
    runs = windows(hashes, ANCHOR)
    span = WORDS - ANCHOR + 1
    if len(runs) < span:
        return runs, np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(runs, span)
    # The leftmost least run: the choice depends on the window's words only.
    return runs, seen.argmin(axis=1) + np.arange(len(seen))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, d, n: how often each anchor stands in a document."""
    cache = HashCache()
    for batch in batches:
        found, docs, counts = [], [], []
        for d, text in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist()):
            runs, at = anchors_of(cache.array(text.encode().split() if text else []))
            if len(at):
                values, n = np.unique(runs[np.unique(at)], return_counts=True)
                found.append(values.view(np.int64))
                counts.append(n.astype(np.int32))
                docs.append(np.full(len(values), d, np.int64))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (found, docs, counts)], names=["anchor", "d", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(t.encode()) if t else None for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("th"), packed, batch.column("doc_id")],
                                         names=["d", "th", "z", "doc_id"])


def _words(data: bytes | None) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split() if data else []


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each occurrence of a repeated anchor: the windows it owns, from position ``lo`` on."""
    cache = HashCache()
    for batch in batches:
        rows: list[tuple] = []
        for d, th, z, anchors, counts in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "z", "anchors", "counts"))):
            hashes = cache.array(_words(z))
            runs, at = anchors_of(hashes)
            if not len(at):
                continue
            own = windows(hashes, WORDS).view(np.int64)
            order = np.argsort(np.array(anchors, np.int64))
            known, times = np.array(anchors, np.int64)[order], np.array(counts, np.int64)[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            ends = np.r_[starts[1:], len(at)]
            values = runs[at[starts]].view(np.int64)
            place = np.searchsorted(known, values).clip(max=len(known) - 1)
            for i in np.flatnonzero(known[place] == values):
                rows.append((int(values[i]), int(times[place[i]]), d, th, int(starts[i]), own[starts[i] : ends[i]]))
            if len(rows) >= 50_000:
                yield _suffix_batch(rows)
                rows = []
        if rows:
            yield _suffix_batch(rows)


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32)
    own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[5] for r in rows])))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
         pa.array([r[4] for r in rows], pa.int32()), own], names=["anchor", "times", "d", "th", "lo", "own"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a partition sorted by (anchor, part, d, th, lo).

    Bit i of ``mask`` says that the window at ``lo + i`` was seen before in its group. Rows with a ``window`` are the
    earliest leaves of a part of a split group; they are judged once more against the other parts.
    """
    seen = np.empty(0, np.int64)  # windows of the group that goes on from the last batch
    last: tuple | None = None
    for batch in batches:
        names = ("anchor", "part", "d", "th", "lo")
        keys = {c: batch.column(c).to_numpy() for c in names}
        n = batch.num_rows
        if not n:
            continue
        row_new = np.ones(n, bool)  # False: an identical row came just before
        group_new = np.ones(n, bool)
        for c in names:
            same = keys[c][1:] == keys[c][:-1]
            row_new[1:] = same if c == "anchor" else row_new[1:] & same
            if c in ("anchor", "part"):
                group_new[1:] = same if c == "anchor" else group_new[1:] & same
        row_new[1:], group_new[1:] = ~row_new[1:], ~group_new[1:]
        now = tuple(int(keys[c][0]) for c in names)
        goes_on = last is not None and now[:2] == last[:2]
        row_new[0] = now != last
        group = np.cumsum(group_new) - 1
        own = batch.column("own")
        sizes = np.diff(own.offsets.to_numpy())
        values = own.flatten().to_numpy()
        row = np.repeat(np.arange(n), sizes)
        nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        use = row_new[row]
        values, row, nth = values[use], row[use], nth[use]
        order = np.lexsort((values, group[row]))  # stable: equal windows stay in the order of their starts
        v, g = values[order], group[row][order]
        again = np.zeros(len(v), bool)
        again[1:] = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
        if goes_on:
            again |= (g == 0) & np.isin(v, seen)
        repeated = np.zeros(len(v), bool)
        repeated[order] = again
        ends_group = int(group[-1])
        tail = np.unique(values[group[row] == ends_group])
        seen = np.union1d(seen, tail) if goes_on and ends_group == 0 else tail
        last = tuple(int(keys[c][-1]) for c in names)
        mask = np.zeros(n, np.int64)
        np.bitwise_or.at(mask, row[repeated], np.int64(1) << nth[repeated])
        hit = np.flatnonzero(mask)
        yield _marks(keys, hit, keys["lo"][hit], mask[hit], None)
        split = (keys["part"][row] >= 0) & ~repeated
        if split.any():
            r = row[split]
            yield _marks(keys, r, keys["lo"][r] + nth[split].astype(np.int32), np.ones(len(r), np.int64), values[split])


def _marks(keys: dict, rows: np.ndarray, lo: np.ndarray, mask: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys["d"][rows], pa.int64()), pa.array(keys["th"][rows], pa.int32()), pa.array(lo, pa.int32()),
         pa.array(mask, pa.int64()), empty if own is None else pa.array(keys["anchor"][rows], pa.int64()),
         empty if own is None else pa.array(own, pa.int64())], names=["d", "th", "lo", "mask", "anchor", "window"])


def covered(n_words: int, marks: list[tuple[int, int]]) -> np.ndarray:
    """Which words the marked windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    for lo, mask in marks:
        while mask:
            low = mask & -mask
            start = lo + low.bit_length() - 1
            edges[start] += 1
            edges[start + WORDS] -= 1
            mask ^= low
    return np.cumsum(edges[:-1]) > 0


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, total, removed, digests = [], [], [], []
        for doc_id, z, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "marks"))):
            words = _words(z)
            n = len(words)
            if marks:
                gone = covered(n, [(m["lo"], m["mask"]) for m in marks])
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            ids.append(doc_id), total.append(n), removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        ids, texts, spans = [], [], []
        for doc_id, z, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "marks"))):
            words, found = _words(z), []
            if marks:
                gone = covered(len(words), [(m["lo"], m["mask"]) for m in marks])
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
                found = [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2])]
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            ids.append(doc_id), texts.append(b" ".join(words).decode()), spans.append(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])


def _marked(documents: DataFrame, heavy: int) -> DataFrame:
    """doc_id, z, marks: the words of every document, packed, and its marked windows."""
    # Texts without a doc_id are documents of their own, not one group.
    nameless = F.lit(_LAST) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), nameless).alias("d"),
        F.hash("text").alias("th"), "text")
    anchors = stored(rows.select("d", "text").mapInArrow(_anchors, "anchor long, d long, n int"), "anchors")
    times = anchors.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1")
    repeated = anchors.select("anchor", "d").join(times, "anchor").groupBy("d").agg(
        F.collect_list(F.struct("anchor", "times")).alias("a"))
    repeated = repeated.select("d", F.col("a.anchor").alias("anchors"), F.col("a.times").alias("counts"))
    packed = rows.mapInArrow(_packed, "d long, th int, z binary, doc_id long")
    suffixes = packed.drop("doc_id").join(repeated, "d").mapInArrow(
        _suffixes, "anchor long, times long, d long, th int, lo int, own array<long>")
    # Part -1: the group is whole. Others are dealt by document over times / heavy parts.
    parts = F.ceil(F.col("times") / heavy)
    part = F.when(F.col("times") <= heavy, F.lit(-1)).otherwise(F.pmod(F.xxhash64("d", "th"), parts)).cast("int")
    grouped = suffixes.withColumn("part", part).drop("times").repartition("anchor", "part")
    ordered = grouped.sortWithinPartitions("anchor", "part", "d", "th", "lo")
    marks = stored(ordered.mapInArrow(_repeats, "d long, th int, lo int, mask long, anchor long, window long"), "marks")
    discard(anchors)
    node = Window.partitionBy("anchor", "window").orderBy("d", "th", "lo")
    later = marks.where("window is not null").withColumn("i", F.row_number().over(node)).where("i > 1")
    columns = ["d", "th", "lo", "mask"]
    every = marks.where("window is null").select(columns).unionAll(later.select(columns))
    by_document = every.groupBy("d", "th").agg(F.collect_list(F.struct("lo", "mask")).alias("marks"))
    return packed.join(by_document, ["d", "th"], "left").select("doc_id", "z", "marks")


def remove_repeats(documents: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return _marked(documents, heavy).mapInArrow(
        _results, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, text, spans of every document: the words that stay, joined by one space, and the removed stretches
    (numbers of their first word and of their words). A passage that repeats is one span, however long it is."""
    return _marked(documents, heavy).mapInArrow(
        _spans, "doc_id long, text string, spans array<struct<start:long,length:long>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), win AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER run AS text20, count(*) OVER run AS n20
  FROM w WINDOW run AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
), rep AS (
  SELECT doc_id, i, word,
         CASE WHEN n20 = {WORDS} AND row_number() OVER (PARTITION BY text20, n20 ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again
  FROM win
), cov AS (
  SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM rep
), g AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
  FROM cov GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
