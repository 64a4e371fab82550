"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank on original vectors.

Fit (bounded sample of ``SAMPLE`` distinct vectors, those of least hash, with one of each group of near copies, so that
a hot group does not become the centre): principal axes, then a rotation by turns of
"nearest binary code" and "nearest rotation" (a singular value decomposition). Several starts give several rotations;
their bits, each cut at the widest gap among the middle fifth of the sample so that they are balanced and no group
of near copies is split by the cut, make one code. Its runs of bits are the tables.

Index (every vector): a table is as wide as the number of vectors asks (``shape_of``), so that unrelated vectors rarely
meet in it however many there are, and there are as many tables as that width needs: a pair at cosine 0.95 differs in a
bit with probability 0.10 and agrees in one table or more with probability 0.98 at every width; pairs at 0.98 with more
than 0.999. Vectors with equal bits in a table are first compared by the Hamming distance of their whole codes; only
those within ``DISTANCE`` of the bits of another are then moved and compared in the original space, in double precision.
A pair is looked at in the first table that holds it and in no other, so none counts twice, and a vector moves only
with the tables that are first for one of its pairs.

A table's bucket is compared as blocks of at most ``CHUNK`` vectors: a hot bucket becomes many block pairs, spread
over the tasks, and what leaves a block is a count and a root for each vector, never its pairs. Equal vectors are one
node with a multiplicity. A group of n different vectors that are all near each other still costs n * n / 2 products.

An empty table gives an empty result; extra columns, ``label`` among them, are ignored. Ties at the cosine link.
Vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different
length do not link. Rows with a null vec_id count as other vectors, but have no component_id and are kept. Repeated
rows are vectors each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

COSINE = 0.95
#: Share of pairs at the cosine that no table may hold; least and greatest width of a table.
MISSED, LEAST_BITS, MOST_BITS = 0.018, 16, 30
#: Pairs whose codes differ in a greater share of the bits are not compared as vectors. The expected share at the cosine
#: is 0.10, and vectors that differ in a quarter of the bits are at a cosine of about 0.7.
DISTANCE = 0.25
SAMPLE, ROUNDS = 10_000, 25
CHUNK = 2_048


def shape_of(vectors: int) -> tuple[int, int]:
    """(tables, bits of each) for a number of vectors: about one unrelated vector in eight shares a bucket."""
    bits = min(max(math.ceil(math.log2(max(vectors, 1))) + 3, LEAST_BITS), MOST_BITS)
    agree = (1 - math.acos(COSINE) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log(1 - agree)), bits


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    turns: np.ndarray  # dimensions x (tables * bits)
    cuts: np.ndarray
    tables: int
    bits: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """The tables' values (n x tables) of unit vectors."""
        bits = ((unit - self.mean) @ self.turns > self.cuts).reshape(len(unit), self.tables, self.bits)
        return bits @ (1 << np.arange(self.bits))


def _leaders(unit: np.ndarray, cosine: float = 0.9, step: int = 500) -> np.ndarray:
    """Unit vectors of which no later one is close to an earlier one."""
    kept = unit[:0]
    for start in range(0, len(unit), step):
        part = unit[start : start + step]
        part = part[~(part @ kept.T >= cosine).any(axis=1)] if len(kept) else part
        kept = np.concatenate([kept, part[~np.tril(part @ part.T >= cosine, -1).any(axis=1)]])
    return kept


def _cuts(values: np.ndarray) -> np.ndarray:
    """For each column the middle of the widest gap between its 40 % and 60 % quantiles."""
    ordered = np.sort(values, axis=0)
    low, high = int(0.4 * (len(ordered) - 1)), int(np.ceil(0.6 * (len(ordered) - 1)))
    if low == high:
        return ordered[low]
    at = low + np.diff(ordered[low : high + 1], axis=0).argmax(axis=0)
    columns = np.arange(values.shape[1])
    return (ordered[at, columns] + ordered[at + 1, columns]) / 2


def fit(sample: np.ndarray, tables: int, bits: int, seed: int = 7) -> Codes:
    """Rotations that bring the sample's principal components closest to binary codes."""
    unit = _leaders(sample / np.linalg.norm(sample, axis=1, keepdims=True))
    mean = unit.mean(axis=0)
    centred = unit - mean
    width = unit.shape[1]
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    projected = centred @ axes
    rng = np.random.default_rng(seed)
    turns = []
    while sum(t.shape[1] for t in turns) < tables * bits:
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ROUNDS):
            code = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(code.T @ projected)
            rotation = right.T @ left.T
        turns.append(axes @ rotation)
    every = np.concatenate(turns, axis=1)[:, : tables * bits]
    return Codes(mean, every, _cuts(centred @ every), tables, bits)


def _matrix(column: pa.ListArray, kind: type = np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components would leave the range of a double.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _index(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = codes.of(_unit(_matrix(batch.column("vec")))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, codes.tables, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("times"), batch.column("vec"), lists],
                                             names=["node", "times", "vec", "code"])

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least row it reaches."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _within(number: int, side: np.ndarray, code: np.ndarray, distance: float) -> np.ndarray:
    """Which rows (last axis but one of ``code``) of a block pair have a partner whose code is near and that no earlier
    table holds. Leading axes are blocks of one size. Side 2 marks a block compared with itself."""
    size = code.shape[-2]
    fits = side[..., :, None] != side[..., None, :]
    fits |= (side[..., :, None] == 2) & ~np.eye(size, dtype=bool)
    apart = np.zeros(fits.shape, np.int16)
    for t in range(code.shape[-1]):
        differ = code[..., :, None, t] ^ code[..., None, :, t]
        apart += np.bitwise_count(differ)
        if t < number:
            fits &= differ != 0
    return (fits & (apart <= distance)).any(axis=-1)


def _block(number: int, side: np.ndarray, node: np.ndarray, times: np.ndarray, unit: np.ndarray, code: np.ndarray):
    """(node, links, root) of the rows of one block pair; side 2 marks a block compared with itself."""
    linked = unit @ unit.T >= COSINE
    if side[0] == 2:
        np.fill_diagonal(linked, False)
    else:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    for earlier in range(number):
        linked &= code[:, None, earlier] != code[None, :, earlier]
    some = linked.any(axis=1)
    return node[some], (linked @ times)[some], node[_roots(linked)[some]]


_KEY = ("number", "value", "i", "j")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, table of each block, edges of the blocks) of a partition sorted by _KEY; no block is cut in two."""
    kept: list[pa.RecordBatch] = []

    def blocks(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys = np.stack([rows.column(c).to_numpy() for c in _KEY])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        return rows, keys[0, starts], np.r_[starts, rows.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _KEY])
        before_last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        cut = int(before_last[-1]) + 1 if len(before_last) else 0
        if cut:
            yield blocks([*kept, batch.slice(0, cut)])
            kept = []
        elif kept and any(kept[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in _KEY):
            # The whole batch has one key, another than what is kept.
            yield blocks(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield blocks(kept)


def _near(distance: float):
    """The rows whose code is near that of another row of their block pair, without the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number, edges in _whole_blocks(batches):
            side, code = rows.column("side").to_numpy(), _matrix(rows.column("code"), np.int32)
            sizes, keep = np.diff(edges), np.zeros(rows.num_rows, bool)
            # Small blocks of one table and size together, large ones one by one.
            shapes = np.unique(np.stack([number, sizes])[:, (sizes > 1) & (sizes <= 16)], axis=1)
            for table_number, size in shapes.T:
                starts = edges[:-1][(number == table_number) & (sizes == size)]
                for some in np.array_split(starts, len(starts) * size * size // 1_000_000 + 1):
                    at = some[:, None] + np.arange(size)
                    keep[at] = _within(int(table_number), side[at], code[at], distance)
            for k in np.flatnonzero(sizes > 16):
                at = slice(edges[k], edges[k + 1])
                keep[at] = _within(int(number[k]), side[at], code[at], distance)
            if keep.any():
                yield rows.select([*_KEY, "side", "node"]).filter(pa.array(keep))

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, number, edges in _whole_blocks(batches):
        side, node, times = (rows.column(c).to_numpy() for c in ("side", "node", "times"))
        unit, code = _unit(_matrix(rows.column("vec"))), _matrix(rows.column("code"), np.int32)
        found = []
        for n, a, b in zip(number.tolist(), edges[:-1], edges[1:]):
            if b - a > 1 and (out := _block(n, side[a:b], node[a:b], times[a:b], unit[a:b], code[a:b])):
                found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)],
                                             names=["node", "links", "root"])


def _linked(nodes: DataFrame, count: int, chunk: int) -> DataFrame:
    """(node, links, root) parts of the ``count`` vectors of one length."""
    sample = nodes.orderBy("h").limit(SAMPLE).select("vec").collect()
    tables, bits = shape_of(count)
    codes = fit(_unit(np.array([r.vec for r in sample], np.float64)), tables, bits)
    indexed = nodes.select("node", "times", "vec").mapInArrow(_index(codes), "node long, times long, vec array<double>, code array<int>")
    indexed = stored(indexed, "codes")
    rows = indexed.select("node", F.posexplode("code").alias("number", "value"))
    sizes = rows.groupBy("number", "value").count().where("count > 1")
    # Only buckets with company are moved.
    shared = rows.join(sizes, ["number", "value"])
    parts = F.ceil(F.col("count") / chunk)
    shared = shared.select("number", "value", "node", parts.cast("int").alias("parts"),
                           F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"))
    others = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = others.select(
        "number", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node")
    # The codes first; vectors move only for rows with a near code in their block pair.
    coded = units.join(indexed.select("node", "code"), "node").select(*_KEY, "side", "node", "code")
    ordered = coded.repartition(*_KEY).sortWithinPartitions(*_KEY, "node")
    near = stored(ordered.mapInArrow(_near(DISTANCE * tables * bits), "number int, value int, i int, j int, side int, node long"),
                  "near_codes")
    full = near.join(indexed, "node").select(*_KEY, "side", "node", "times", "vec", "code")
    ordered = full.repartition(*_KEY).sortWithinPartitions(*_KEY, "node")
    return ordered.mapInArrow(_compare, "node long, links long, root long")


def link(embeddings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``."""
    vec = F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0),
        F.lit(False))
    rows = embeddings.select("vec_id", vec.alias("vec"), sound.alias("sound")).select(
        "vec_id", F.when(F.col("sound"), F.col("vec")).alias("vec"))
    rows = stored(rows.withColumns({"h": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")),
                                    "h2": F.when(F.col("vec").isNotNull(), F.hash("vec"))}), "vectors")
    nodes = rows.where("vec is not null").groupBy("h", "h2").agg(
        F.count("*").alias("times"), F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec"))
    # A node's number is its hash: it exists without a vec_id too.
    nodes = stored(nodes.withColumn("node", F.xxhash64("h", "h2")), "nodes")
    widths = sorted(tuple(r) for r in nodes.groupBy(F.size("vec")).count().collect())
    found = rows.sparkSession.createDataFrame([], "node long, links long, root long")
    for width, count in widths:
        found = found.unionAll(_linked(nodes.where(F.size("vec") == width), count, chunk))
    found = stored(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = (nodes.select("node", "h", "h2", "times", "vec_id").join(counts, "node", "left").join(labels, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = placed.join(least, "component").select(
        "h", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h", "h2").join(named, ["h", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), r AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT e.y, r.root FROM r JOIN e ON e.x = r.id WHERE r.root < e.y
), c AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
), n AS (
  SELECT x, count(*) AS n FROM e GROUP BY x
)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.id = m.vec_id LEFT JOIN n ON n.x = m.vec_id
"""
