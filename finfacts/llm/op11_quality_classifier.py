"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each whole text becomes ``len(STATISTICS)`` numbers (lengths, shares of kinds of characters, repetition, shape of
lines). Cosines of random projections of the standardised numbers approximate a Gaussian kernel; its ridge regression
on the labels is solved from the normal equations. Partitions sum their own equations, one for each of ``FOLDS`` folds
of the learning rows, and one shuffle sums those row by row, so the driver gets FOLDS * (FEATURES + 1) rows whatever
the number of documents. All sums but a fold's own give weights that have not seen the fold; scores by these weights,
counted in ``BINS`` bins, give an isotonic step function (pooled adjacent violators), whose pools are joined by lines.

Statistics, projections, cosines and weights are whole numbers of small fractions, so all sums are exact: the result
does not depend on partitions, their order or a task that ran twice. All labelled rows are used; there is no sample.

Defined results: null and empty texts have all statistics 0 and get a score like others. Labels that are null or
without a document are not used, null ids have no label, and contradicting labels of an id count as the lowest.
Repeated documents are rows each, in learning and in the result. Without any learning row every score is 0.5. Ties share a score. An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared, stored, table

FEATURES, RIDGE, FOLDS, SEED = 256, 1e-3, 5, 11
BINS = 4096
#: Ridge scores outside are cut to the ends before they are counted.
RANGE = (-0.5, 1.5)
THRESHOLD = 0.7
#: One part of a statistic, a standardised statistic or a projection; one part of a cosine; one part of a weight.
STEP, COSINE_STEP, WEIGHT_STEP = 2.0**-12, 2.0**-12, 2.0**-24
LIMIT = 8.0

STATISTICS = (
    "log_words", "log_chars", "log_word_chars", "distinct_words", "top_word", "repeated_windows", "short_words",
    "long_words", "bare_words", "capitals", "digits", "symbols", "stops", "marks", "brackets", "others", "entropy",
    "log_line_words", "short_lines", "unstopped_lines", "repeated_lines", "mark_kinds",
)
_KINDS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&|<>", "stops": b".,;:",
    "marks": b"!?\"'-", "brackets": b"()[]{}/\\_=+~^@`",
}
_AT = {kind: np.frombuffer(chars, np.uint8) for kind, chars in _KINDS.items()}
_LETTERLESS = re.compile(rb"[^A-Za-z\x80-\xff]+")
WINDOW = 4


def statistics(text: str | None) -> list[float]:
    """The numbers of one text, each a share of 1 or a logarithm."""
    data = text.encode() if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    spaces = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    chars = len(text) - spaces
    share = counts[counts > 0] / len(data)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeated = 0.0
    if n > WINDOW and len(numbers) < n:
        grams = ids[: n - WINDOW + 1].astype(np.uint64)
        for i in range(1, WINDOW):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - WINDOW + 1 + i].astype(np.uint64)
        repeated = 1 - len(np.unique(grams)) / len(grams)
    lines = [line for line in data.split(b"\n") if line.strip()]
    per_line = n / len(lines)
    kinds = {kind: int(counts[at].sum()) / chars for kind, at in _AT.items()}
    return [
        math.log1p(n), math.log1p(len(text)), math.log1p(chars / n), len(numbers) / n, int(np.bincount(ids).max()) / n,
        repeated, float((lengths <= 3).mean()), float((lengths >= 16).mean()),
        sum(1 for w in numbers if _LETTERLESS.fullmatch(w)) / len(numbers),
        *kinds.values(), int(counts[128:].sum()) / len(data), float(-(share * np.log2(share)).sum()) / 8,
        math.log1p(per_line), sum(1 for line in lines if line.count(b" ") < 3) / len(lines),
        sum(1 for line in lines if line.rstrip()[-1:] not in (b".", b"!", b"?", b":", b";")) / len(lines),
        1 - len(set(lines)) / len(lines), sum(1 for at in _AT.values() if counts[at].any()) / len(_AT),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.round(np.array(statistics(t)) / STEP).astype(np.int32) for t in batch.column("text").to_pylist()]
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat))],
                                         names=["doc_id", "x"])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and x, the statistics in whole steps."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_measure, "doc_id long, x array<int>")


class Features:
    """Random Fourier features of statistics; projections have the mean distance of two texts as kernel width."""

    def __init__(self, spec: tuple[np.ndarray, np.ndarray, int]):
        self.mean, self.spread, features = spec
        rng = np.random.default_rng(SEED)
        self.turns = np.round(rng.standard_normal((len(self.mean), features)) / math.sqrt(len(self.mean)) / STEP)
        self.shift = rng.uniform(0, 2 * math.pi, features)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whole cosine steps, with a constant as the last column."""
        z = np.clip((x * STEP - self.mean) / self.spread, -LIMIT, LIMIT)
        phase = (np.round(z / STEP) @ self.turns) * STEP**2
        cosines = np.round(np.cos(phase + self.shift) / COSINE_STEP)
        return np.concatenate([cosines, np.full((len(x), 1), 1 / COSINE_STEP)], axis=1)


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(STATISTICS))


def _equations(opened):
    """Learning rows to (fold, i, row): the partition's sums of products, the labels' in the last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, folds = opened().of(_rows(part.column("x"))), part.column("fold").to_numpy()
                zy = np.concatenate([z, part.column("y").to_numpy()[:, None] / COSINE_STEP], axis=1)
                for fold in np.unique(folds).tolist():
                    # Products are at most 2 ** 24, so sums of 4096 rows are exact in doubles.
                    sums = (z[folds == fold].T @ zy[folds == fold]).astype(np.int64)
                    total[fold] = total[fold] + sums if fold in total else sums
        for fold, sums in total.items():
            yield _sums([(fold, i) for i in range(len(sums))], list(sums))

    return run


def _sums(keys: list[tuple[int, int]], rows: list[np.ndarray]) -> pa.RecordBatch:
    folds, places = zip(*keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(folds, pa.int32()), pa.array(places, pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))],
        names=["fold", "i", "row"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal (fold, i) in one partition, added up one after another."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for key, row in zip(zip(batch.column("fold").to_pylist(), batch.column("i").to_pylist()), batch.column("row")):
            row = row.values.to_numpy()
            total[key] = total[key] + row if key in total else row.copy()
    if total:
        yield _sums(list(total), list(total.values()))


def solve(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights, in whole steps, from the summed equations; the constant is not penalised."""
    scaled = sums * COSINE_STEP**2
    n = scaled[-1, -2]
    left = scaled[:, :-1] + np.diag(np.r_[np.full(len(scaled) - 1, ridge * n), 1e-9])
    weights = np.linalg.solve(left, scaled[:, -1])
    return np.round(weights / WEIGHT_STEP)


def pooled(counts: np.ndarray, ones: np.ndarray) -> list[tuple[int, int, float]]:
    """Pooled adjacent violators: (first bin, last bin, share of ones) of each pool, shares ascending."""
    pools: list[list[int]] = []
    for at in np.flatnonzero(counts).tolist():
        pools.append([at, at, int(counts[at]), int(ones[at])])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, last, n, k = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + n, pools[-1][3] + k]
    return [(a, b, k / n) for a, b, n, k in pools]


class Scorer:
    """Scores of statistics: ridge values through the calibration's lines."""

    def __init__(self, spec: tuple):
        features, self.weights, pools = spec
        self.features = Features(features) if features else None
        # Each pool is level from its first bin to its last; lines join the pools.
        ends = [(e, v) for a, b, v in pools or [] for e in ((a, b) if a < b else (a,))]
        self.at, self.values = (np.array(x) for x in zip(*ends)) if ends else (None, None)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Ridge values on the scale of bins, cut to the range; a column for each set of weights."""
        ridge = (self.features.of(x) @ self.weights) * (COSINE_STEP * WEIGHT_STEP)
        return (np.clip(ridge, *RANGE) - RANGE[0]) / (RANGE[1] - RANGE[0]) * (BINS - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.features is None else np.interp(self.bins(x), self.at, self.values)


def _binned(opened):
    """Learning rows to their bins, by the weights that have not seen their fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = opened().bins(_rows(batch.column("x")))
            own = every[np.arange(len(every)), batch.column("fold").to_numpy()]
            at = np.round(own).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    return run


def _scored(opened):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(opened().scores(_rows(batch.column("x"))), pa.float64())],
                names=["doc_id", "score"])

    return run


def learning_rows(rows: DataFrame, labels: DataFrame, used) -> DataFrame:
    """x, y (0 or 1), fold of the ``measured`` rows with a label; ``used`` tells from the doc_id which may be read."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("y"))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % FOLDS
    return rows.where(used).join(known.where("y in (0, 1)"), "doc_id").select("x", "y", fold.cast("int").alias("fold"))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and spread of each statistic, from whole sums."""
    x = [F.get("x", F.lit(i)).cast("decimal(38,0)") for i in range(len(STATISTICS))]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
                    *[F.sum((c * c).cast("decimal(38,0)")).alias(f"q{i}") for i, c in enumerate(x)]).first()
    if not sums.n:
        return None
    mean = [int(sums[f"s{i}"]) / sums.n for i in range(len(x))]
    spread = [math.sqrt(max(int(sums[f"q{i}"]) * sums.n - int(sums[f"s{i}"]) ** 2, 0)) / sums.n for i in range(len(x))]
    return np.array(mean) * STEP, np.maximum(np.array(spread) * STEP, 1e-3)


def fit(rows: DataFrame, features: int = FEATURES) -> tuple:
    """The scorer's parts from ``learning_rows``."""
    spark = rows.sparkSession
    moments = _moments(rows)
    if moments is None:
        return None, None, None
    spec = (*moments, features)
    parts = rows.mapInArrow(_equations(shared(spark, spec, Features)), "fold int, i int, row array<long>")
    listed = parts.repartition("fold", "i").mapInArrow(_added, "fold int, i int, row array<long>").collect()
    sums = np.zeros((FOLDS, features + 1, features + 2))
    for r in listed:
        sums[r.fold, r.i] = r.row
    total = sums.sum(axis=0)
    # With all rows in one fold there is nothing else to learn from.
    unseen = [solve(total - own if (total != own).any() else total) for own in sums]
    opened = shared(spark, (spec, np.array(unseen).T, None), Scorer)
    bins = rows.mapInArrow(_binned(opened), "bin int, y int").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    counts, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in bins:
        counts[r.bin], ones[r.bin] = r.n, r.ones
    return spec, solve(total), pooled(counts, ones)


def classify(documents: DataFrame, labels: DataFrame, used) -> DataFrame:
    """doc_id and score of every document; labels are learnt where ``used`` (a condition on doc_id) holds."""
    rows = stored(measured(documents), "statistics")
    learnt = stored(learning_rows(rows, labels, used), "learning")
    model = fit(learnt)
    discard(learnt)
    return rows.mapInArrow(_scored(shared(rows.sparkSession, model, Scorer)), "doc_id long, score double")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
