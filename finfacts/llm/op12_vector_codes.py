"""Vector code compression: product codes learnt by exact integer rounds over Hilbert-sorted flat blocks.

Components become whole numbers (floor of ``SCALE`` times the value). A vector is cut into ``PARTS`` consecutive parts,
and each part position has a codebook of ``ENTRIES`` entries, begun with the vectors of smallest vec_id. A round gives
every part to the nearest entry and moves the entries to the floor of the mean of their parts.

The parts are sorted once along a Hilbert curve (a range shuffle whose last key is the row, so equal parts spread too)
and written as flat blocks of ``BLOCK`` parts with the least and the greatest value of each component and the sums.
In every round a block first meets the entries as a box: no entry whose least distance to the box is above the
smallest greatest distance can be nearest to any of its parts. What is left is the block's shortlist. A shortlist
of one takes the whole block by its sums; otherwise a small kernel computes squared distances to the shortlist, in
the narrowest arithmetic that is exact for the block's values: doubles below 2**53, 64-bit, or unbounded integers.

Rounds read the stored blocks again, so a lost executor repeats tasks of one round only. A task returns one sum for
each entry it met, in 32-bit limbs, so sums never overflow; the driver gets one row for each entry and limb, never
more than the codebooks themselves. The codebooks are broadcast (ENTRIES * dimensions numbers).

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length
have codebooks of their own; a length not divisible by PARTS is cut at floor(i * length / PARTS), and an empty vector
gets code 0 with error 0. With fewer vectors than ENTRIES there are as many entries. Distances tie to the lower
index. Repeated rows are vectors each; rows of equal vec_id start codebooks in the order of their components, null
vec_ids last. Errors beyond 63 bits are null. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 128
HILBERT_BITS = 4
#: Bytes of one stored component: narrow ones first; the widest holds any double times SCALE.
_WIDTHS = (2, 4, 8)
_WIDEST = 136
_LIMB = 32


def hilbert_keys(cells: np.ndarray, bits: int = HILBERT_BITS) -> list[bytes]:
    """Position on the Hilbert curve of each row of cell numbers below 2 ** bits, as bytes that sort by it.

    Axes are turned to the curve's transposed index bit by bit (exchange or invert the lower bits of the first axis),
    then Gray-coded; the bits of all axes, highest first, are the key.
    """
    x = cells.astype(np.int64).T.copy()
    if not x.size:
        return [b""] * len(cells)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        x[0] ^= np.where((x[0] & q) != 0, q - 1, 0)
        for axis in x[1:]:
            inverted = (axis & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit, axis, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) of doubles: 64-bit integers, or unbounded ones where a value needs them."""
    if not values.size or np.abs(values).max() < 2.0**50:
        return np.floor(values * SCALE).astype(np.int64)
    scaled = [int(v) * SCALE if abs(v) >= 2.0**50 else int(np.floor(v * SCALE)) for v in values.ravel().tolist()]
    out = np.empty(values.size, object)
    out[:] = scaled
    return out.reshape(values.shape)


def _greatest(values: np.ndarray) -> int:
    return int(max(abs(values.max()), abs(values.min()))) if values.size else 0


def pack(values: np.ndarray) -> bytes:
    """Integers in the narrowest of the stored widths."""
    most = _greatest(values)
    for width in _WIDTHS:
        if most < 1 << (8 * width - 2):
            return values.astype(f"<i{width}").tobytes()
    return b"".join(int(v).to_bytes(_WIDEST, "little", signed=True) for v in values.ravel())


def unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    if not rows * columns:
        return np.zeros((rows, columns), np.int64)
    width = len(data) // (rows * columns)
    if width in _WIDTHS:
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(rows, columns)
    out = np.empty(rows * columns, object)
    out[:] = [int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)]
    return out.reshape(rows, columns)


def _exact(columns: int, most: int):
    """The type in which squared distances of vectors with components up to ``most`` are exact."""
    bound = 8 * max(columns, 1) * (most + 1) ** 2
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to some point of the box, ascending."""
    under, over = low - entries, entries - high
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(abs(entries - low), abs(entries - high))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def nearest(values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``chosen``, squared distance) of the nearest entry of each row, ties to the first."""
    squares = (chosen * chosen).sum(axis=1) - 2 * (values @ chosen.T)
    at = squares.argmin(axis=1)
    return at, squares[np.arange(len(values)), at] + (values * values).sum(axis=1)


class Books:
    """The codebooks of one vector length, ready in the arithmetics that blocks ask for."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.most, self.ready = books, [_greatest(b) for b in books], {}

    def of(self, part: int, most: int) -> np.ndarray:
        kind = _exact(self.books[part].shape[1], max(most, self.most[part]))
        key = (part, kind)
        if key not in self.ready:
            self.ready[key] = self.books[part].astype(kind)
        return self.ready[key]


def _bounds(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def _cut(length: int, low: np.ndarray, high: np.ndarray):
    """Rows (row_id, vec) to parts with their Hilbert keys; ``low`` and ``high`` only place the curve's cells."""
    bounds, cells = _bounds(length), 1 << HILBERT_BITS
    span = np.maximum(high - low, 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            values = flat.reshape(batch.num_rows, length)
            place = np.clip((values - low) / span * cells, 0, cells - 1).astype(np.int64)
            numbers = whole(values)
            for part in range(PARTS):
                a, b = bounds[part], bounds[part + 1]
                own = numbers[:, a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(hilbert_keys(place[:, a:b]), pa.binary()),
                     batch.column("row_id"), pa.array([pack(v) for v in own], pa.binary())],
                    names=["part", "key", "row_id", "vals"])

    return run


_BLOCKS = "part int, n int, ids binary, vals binary, low binary, high binary, sums binary"


def _blocks(length: int):
    """Sorted parts to blocks; a block ends with its part position, at BLOCK rows, or with the Arrow batch."""
    bounds = _bounds(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids = batch.column("part").to_numpy(), batch.column("row_id").to_numpy()
            vals, out = batch.column("vals").to_pylist(), []
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
            for a, b in zip(edges, np.r_[edges[1:], len(parts)].astype(int)):
                width = bounds[parts[a] + 1] - bounds[parts[a]]
                for at in range(a, b, BLOCK):
                    to = min(at + BLOCK, b)
                    v = np.concatenate([unpack(x, 1, width) for x in vals[at:to]])
                    out.append((int(parts[a]), to - at, ids[at:to].astype("<i8").tobytes(), pack(v), pack(v.min(axis=0)),
                                pack(v.max(axis=0)), pack(v.sum(axis=0))))
            if out:
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                                 names=["part", "n", "ids", "vals", "low", "high", "sums"])

    return run


def _met(batch: pa.RecordBatch, books: Books):
    """(part, ids, values, whole sums, shortlist, entries) of each block of a batch."""
    for part, n, ids, vals, low, high, sums in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
        width = books.books[part].shape[1]
        low, high = unpack(low, 1, width)[0], unpack(high, 1, width)[0]
        entries = books.of(part, max(_greatest(low), _greatest(high)))
        kind = entries.dtype
        yield part, n, ids, vals, sums, shortlist(low.astype(kind), high.astype(kind), entries), entries


def _totals(opened):
    """Blocks to (part, entry, limb, count, sums): one row for each entry that a task met and each limb in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = opened()
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        sums = [np.zeros(b.shape, np.int64) for b in books.books]

        def add(part: int, at: np.ndarray, times: np.ndarray, more: np.ndarray) -> None:
            counts[part][at] += times
            if sums[part].dtype != object and (more.dtype == object or _greatest(more) + _greatest(sums[part]) >= 2**62):
                sums[part] = sums[part].astype(object)
            sums[part][at] += more.astype(sums[part].dtype)

        for batch in batches:
            for part, n, _, vals, total, chosen, entries in _met(batch, books):
                width = entries.shape[1]
                if len(chosen) == 1:
                    add(part, chosen, np.array([n]), unpack(total, 1, width))
                    continue
                values = unpack(vals, n, width)
                at = nearest(values.astype(entries.dtype), entries[chosen])[0]
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
                add(part, chosen[at[order][first]], np.diff(np.r_[first, n]), np.add.reduceat(values[order], first, axis=0))
        out = []
        for part, (count, total) in enumerate(zip(counts, sums)):
            for entry in np.flatnonzero(count).tolist():
                row, limb, times = total[entry], 0, int(count[entry])
                while True:
                    last = all(-(2 ** (_LIMB - 1)) <= v < 2 ** (_LIMB - 1) for v in row.tolist())
                    out.append((part, entry, limb, times, (row if last else row & (2**_LIMB - 1)).tolist()))
                    if last:
                        break
                    row, limb, times = row >> _LIMB, limb + 1, 0
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                                             names=["part", "entry", "limb", "n", "sums"])

    return run


def _assigned(opened):
    """Blocks to (row_id, part, entry, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = opened()
        for batch in batches:
            out = [[], [], [], []]
            for part, n, ids, vals, _, chosen, entries in _met(batch, books):
                at, error = nearest(unpack(vals, n, entries.shape[1]).astype(entries.dtype), entries[chosen])
                out[0] += np.frombuffer(ids, "<i8").tolist()
                out[1] += [part] * n
                out[2] += chosen[at].tolist()
                out[3] += [e if e < 2**63 else None for e in map(int, error.tolist())]
            if out[0]:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                                 names=["row_id", "part", "entry", "error"])

    return run


def _moved(books: list[np.ndarray], blocks: DataFrame) -> list[np.ndarray]:
    """The codebooks after one round."""
    opened = shared(blocks.sparkSession, books, Books)
    found = blocks.mapInArrow(_totals(opened), "part int, entry int, limb int, n long, sums array<long>")
    widest = max(b.shape[1] for b in books)
    rows = found.groupBy("part", "entry", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)]).collect()
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        key = (r.part, r.entry)
        counts[key] = counts.get(key, 0) + r.n
        row = sums.setdefault(key, [0] * books[r.part].shape[1])
        for i in range(len(row)):
            row[i] += r[f"s{i}"] << (_LIMB * r.limb)
    out = []
    for part, book in enumerate(books):
        new = book.astype(object)
        for entry in range(len(book)):
            if counts.get((part, entry)):
                new[entry] = [s // counts[part, entry] for s in sums[part, entry]]
        out.append(new if _greatest(new) >= 2**62 else new.astype(np.int64))
    return out


def _of_length(vectors: DataFrame, length: int) -> DataFrame:
    """row_id, vec_id, label, code, error, codebooks_sha256 of the vectors of one length."""
    spark = vectors.sparkSession
    own = vectors.where(F.size("vec") == length)
    first = own.select("vec_id", "vec", "row_id").orderBy(F.col("vec_id").asc_nulls_last(), "vec", "row_id").limit(ENTRIES)
    listed = first.collect()
    begin = np.array([r.vec for r in listed], np.float64).reshape(len(listed), length)
    books = [whole(begin[:, a:b]) for a, b in zip(_bounds(length), _bounds(length)[1:])]
    low, high = begin.min(axis=0), begin.max(axis=0)
    parts = own.select("row_id", "vec").mapInArrow(_cut(length, low, high), "part int, key binary, row_id long, vals binary")
    ordered = parts.repartitionByRange("part", "key", "row_id").sortWithinPartitions("part", "key", "row_id")
    blocks = stored(ordered.select("part", "row_id", "vals").mapInArrow(_blocks(length), _BLOCKS), "blocks")
    for _ in range(ROUNDS):
        books = _moved(books, blocks)
    text = ",".join(str(v) for book in books for v in book.ravel().tolist())
    codes = blocks.mapInArrow(_assigned(shared(spark, books, Books)), "row_id long, part int, entry int, error long")
    none = F.lit(None)
    every = own.select("row_id", "vec_id", "label", none.cast("int").alias("part"), none.cast("int").alias("entry"),
                       none.cast("long").alias("error"))
    both = every.unionByName(codes, allowMissingColumns=True)
    shifted = F.col("entry").cast("long") * F.pow(F.lit(256), PARTS - 1 - F.col("part")).cast("long")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    coded = both.groupBy("row_id").agg(
        F.max("vec_id").alias("vec_id"), F.first("label", ignorenulls=True).alias("label"),
        F.lower(F.lpad(F.hex(F.sum(shifted)), 2 * PARTS, "0")).alias("code"),
        F.when(F.count("error") == PARTS, total).alias("error"))
    out = stored(coded.withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())), "codes")
    discard(blocks)
    return out


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every sound vector."""
    vec = F.col("embedding")
    sound = vec.isNotNull() & F.forall(vec.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", vec.alias("vec"))
    vectors = stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", "vec"), "vectors")
    lengths = sorted(r.n for r in vectors.select(F.size("vec").alias("n")).distinct().collect())
    kinds = dict(vectors.dtypes)
    coded = rows.sparkSession.createDataFrame(
        [], f"row_id long, vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")
    for length in lengths:
        coded = coded.unionByName(_of_length(vectors, length))
    whole_sum = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(
        F.when(F.count("error") == F.count("*"), whole_sum).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The rounds written out one by one."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p.part, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT
                        * {ENTRIES} + c.entry) AS best
  FROM p JOIN c{i} c ON p.part = c.part GROUP BY r, p.part
)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (
    SELECT p.part, a.best % {ENTRIES} AS entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS pos
    FROM p JOIN a{i} a ON a.r = p.r AND a.part = p.part) GROUP BY part, entry, pos
), n{i} AS (
  SELECT part, entry, list(v ORDER BY pos) AS x FROM m{i} GROUP BY part, entry
), c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON n.part = c.part AND n.entry = c.entry
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS MATERIALIZED (
  SELECT r, vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS x
  FROM v, (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, entry, x FROM (
    SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, r) - 1 AS entry FROM p) WHERE entry < {ENTRIES}
), {', '.join(steps)}, s AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM c{ROUNDS})
), k AS (
  SELECT r, string_agg(lpad(lower(to_hex(best % {ENTRIES})), 2, '0'), '' ORDER BY part) AS code,
         sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN k USING (r), s
"""


ORACLE = _oracle()
