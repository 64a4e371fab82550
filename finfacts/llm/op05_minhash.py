"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, connected components.

Circulant MinHash needs two permutations only. The first scatters the shingles over the circle of 32-bit numbers; the
second, turned by k places, gives coordinate k: ``min over x of second((first(x) + k) mod 2**32)``. Bands of ROWS
coordinates are the buckets of the candidate search. With 38 bands of 5, a pair at similarity 0.8 shares no bucket
with probability 3e-7.

Equal sets become one node first, so copies meet no further step. Candidates are then confirmed on full sets:

1. every node of a bucket against the bucket's most central node, the one whose buckets hold most (a star: linear in
   the bucket). Copies with few edits are central, so the copies around them fall into one component;
2. nodes of buckets that still hold several components, by an exact prefix filter. Shingles are ordered by how many of
   these nodes hold them, rarest first. Two sets that reach the similarity share a shingle among the first
   ``n - overlap + 1`` of both, where ``overlap`` follows from both sizes (taken in classes of CLASS). Shingles that
   no other node holds take up places and meet nobody, and places where one component meets itself are dropped, so
   edited copies that link with nothing are not paired up. What is left is paired if the components differ and if three
   tests hold: the set sizes; the parities of 1024 shingle counters, whose number of differences never exceeds the sets'
   symmetric difference; and the signatures, which may differ in at most MAX_BITS of 192 single-bit coordinates (a
   pair at 0.8 differs in 19 on average; 46 is more than six standard deviations away).

Pairs that are already in one component are never compared: more links would not change the components.

``shingle`` is 4 words for the contract's query and 5 for the pipeline. Null and empty texts have an empty set and
link with nothing. Rows with a null doc_id link with nothing: component_id null, kept. Repeated rows share a node.
Two rows with one doc_id and different texts are nodes each; the id reached is that doc_id for both if it is least.
Extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashCache, discard, mix, stored, table, windows
from .components import components

SHINGLE = 4
PERCENT = 80
BANDS, ROWS, COORDINATES = 38, 5, 192
MAX_BITS = 46
PARITIES = 1024
#: Width of a class of set sizes: the partner's size is known that closely when a prefix is cut.
CLASS = 1.03

_PROFILE = "doc_id long, h long, n_shingles long, node long, buckets array<long>, bits array<long>, odd array<long>"


def shingles(text: str | None, width: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ASCII letters count in lower case."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = cache.array(words)
    if len(words) < width:
        # The whole short sequence is one shingle; its length keeps it apart from longer ones.
        return mix(windows(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(windows(hashes, width))


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """The circulant signature: COORDINATES minima from two permutations."""
    first = (mix(shingle_hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    turns = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    # A slice of the set at a time keeps the table of turned values within the processor's cache.
    for start in range(0, len(first), 256):
        np.minimum(out, _second(first[None, start : start + 256] + turns).min(axis=1), out=out)
    return out


def parities(shingle_hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles that fall to each of PARITIES counters."""
    at = (shingle_hashes >> np.uint64(17)) % np.uint64(PARITIES)
    odd = np.bincount(at.astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            sizes, nodes, buckets, bits, odd = [], [], [], [], []
            for text in b["text"]:
                found = shingles(text, width, cache)
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None), buckets.append(None), bits.append(None), odd.append(None)
                    continue
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63)
                s = signature(found)
                rows = s[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
                key = salts.copy()
                for r in range(ROWS):
                    key = mix(key ^ rows[:, r]) + np.uint64(r)
                buckets.append(key.view(np.int64))
                bits.append(np.packbits((s & 1).astype(np.uint8)).view(np.int64))
                odd.append(parities(found))
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "n_shingles": sizes, "node": pd.array(nodes, "Int64"),
                                "buckets": buckets, "bits": bits, "odd": odd})

    return run


def _verify(width: int, percent: int):
    """(u, v) of the rows (u, v, text_u, text_v) whose full sets reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        last, last_set = None, None
        for b in batches:
            ok = []
            for v, text_u, text_v in zip(b["v"], b["text_u"], b["text_v"]):
                if v != last:
                    last, last_set = v, shingles(text_v, width, cache)
                mine = shingles(text_u, width, cache)
                both = len(np.intersect1d(mine, last_set, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(last_set) - both))
            yield b.loc[ok, ["u", "v"]]

    return run


def _nodes_of(width: int):
    """Keeps a row if its text is the node's text (a doc_id may have several)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        for b in batches:
            same = []
            for node, text in zip(b["node"], b["text"]):
                found = shingles(text, width, cache)
                same.append(bool(len(found)) and xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63 == node)
            yield b.loc[same, ["node", "text"]]

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """(node, text) of the wanted nodes, from the least document of each."""
    ids = nodes.select("node", "doc_id").join(wanted, "node")
    texts = documents.select("doc_id", "text").join(ids, "doc_id").select("node", "text")
    return stored(texts.mapInPandas(_nodes_of(width), "node long, text string").dropDuplicates(["node"]), "texts")


def _confirmed(candidates: DataFrame, nodes: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The candidate pairs (u, v) that are links. Only texts of nodes in some pair are moved."""
    texts = _texts(candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, documents, width)
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    # The second join leaves the pairs of one v together, so its set is built once.
    pairs = candidates.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    links = stored(pairs.mapInPandas(_verify(width, percent), "u long, v long"), "confirmed")
    discard(texts)
    return links


def _sets(width: int):
    """(node, set) of texts, shingles as signed 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "set": [shingles(t, width, cache).view(np.int64) for t in b["text"]]})

    return run


def _prefixes(open_nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, a, b, own, node, component): the shared shingles in which an open node (node, component, n) of size class
    ``own`` must meet a partner of the other class of a and b, where both classes and different components do meet."""
    sets = stored(texts.mapInPandas(_sets(width), "node long, set array<long>"), "sets")
    tokens = sets.select("node", F.explode("set").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    rows = open_nodes.join(ranked, "node")
    n = F.col("n")
    size_class = lambda x: F.floor(F.log(x.cast("double")) / math.log(CLASS)).cast("int")
    least = F.ceil(n * percent / 100)
    rows = rows.withColumn("own", size_class(n)).withColumn(
        "other", F.explode(F.sequence(size_class(least), size_class(F.floor(n * 100 / percent)))))
    partner = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("other"))), least)
    overlap = F.ceil(percent * (n + partner) / (100 + percent))
    # Shingles of this node alone come first and take up places.
    places = n - overlap + 1 - (n - F.size("shared"))
    rows = rows.withColumn("token", F.explode(F.slice("shared", 1, F.greatest(places, F.lit(0)).cast("int"))["token"]))
    keyed = stored(rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "component"), "prefixes")
    mixed = keyed.groupBy("token", "a", "b").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.min("own").alias("low"), F.max("own").alias("high"),
    ).where("x <> y AND low = a AND high = b").select("token", "a", "b")
    out = stored(keyed.join(mixed, ["token", "a", "b"]), "mixed")
    discard(sets, keyed)
    return out


def _differing(name: str, words: int) -> Column:
    each = (F.bit_count(F.col(f"a.{name}")[i].bitwiseXOR(F.col(f"b.{name}")[i])) for i in range(words))
    return reduce(lambda x, y: x + y, each)


def _paired(prefixes: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(u, v) of nodes of different components that meet in a prefix and may reach the similarity."""
    rows = stored(prefixes.join(sketches, "node"), "open")
    a, b = rows.alias("a"), rows.alias("b")
    n_a, n_b = F.col("a.n"), F.col("b.n")
    sizes = (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)
    # Similarity p means a symmetric difference of at most (1 - p) / (1 + p) of both sizes together.
    apart = (100 + percent) * _differing("odd", PARITIES // 64) <= (100 - percent) * (n_a + n_b)
    close = (F.col("a.component") < F.col("b.component")) & sizes & apart & (_differing("bits", COORDINATES // 64) <= MAX_BITS)
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("token", "a", "b")))
    sides = (F.col("a.a") == F.col("a.b")) | (F.col("a.own") != F.col("b.own"))
    pairs = a.join(b, same & sides & close).select(
        F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
    out = stored(pairs, "pairs")
    discard(rows)
    return out


def _linked(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, node, component_id, and the least (doc_id, node) of the component."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    profiles = stored(rows.mapInPandas(_profile(width), _PROFILE), "profiles")
    usable = profiles.where("node is not null and doc_id is not null")
    nodes = stored(usable.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    # One profile row for each node: that of its least document.
    heads = usable.join(nodes, ["node", "doc_id"]).dropDuplicates(["node"])
    buckets = heads.select("node", F.explode("buckets").alias("bucket"))
    crowds = buckets.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    crowded = stored(buckets.join(crowds, "bucket"), "buckets")
    rank = crowded.groupBy("node").agg(F.sum("crowd").alias("rank"))
    buckets = stored(crowded.join(rank, "node").select("bucket", "node", "rank"), "ranked")

    centres = buckets.groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("centre"))
    stars = buckets.join(centres.select("bucket", F.col("centre.node").alias("v")), "bucket").where("node <> v")
    stars = stored(stars.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), "stars")
    links = _confirmed(stars, nodes, documents, width, percent)
    first = components(links)

    named = buckets.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    sketches = heads.select("node", F.col("n_shingles").alias("n"), "bits", "odd")
    open_nodes = named.join(mixed.select("bucket"), "bucket", "left_semi").select("node", "component").distinct()
    open_nodes = stored(open_nodes.join(sketches, "node"), "open")
    texts = _texts(open_nodes.select("node"), nodes, documents, width)
    prefixes = _prefixes(open_nodes.select("node", "component", "n"), texts, width, percent)
    pairs = _paired(prefixes, open_nodes.select("node", "n", "bits", "odd"), percent)
    more = _confirmed(pairs.join(stars, ["u", "v"], "left_anti"), nodes, documents, width, percent)
    labels = components(links.unionAll(more))
    # From here on only the profiles, the nodes and their labels are read.
    discard(crowded, buckets, stars, links, first, open_nodes, texts, prefixes, pairs, more)

    # The least document of a component from its nodes, not from all copies.
    placed = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    found = placed.join(least, "component").select("node", "least")
    return profiles.select("doc_id", "h", "n_shingles", "node").join(found, "node", "left")


def link(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return _linked(documents, width, percent).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group, the least by doc_id and then by text, and all columns. Identical rows count
    as one, also where texts have no words; rows without a doc_id stay."""
    alone = F.col("node").isNull()
    first = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))
    # Of equal word sequences under one doc_id, one text is taken.
    chosen = _linked(documents, width, percent).where(F.col("doc_id").isNotNull() & (alone | first)).groupBy(
        "doc_id", F.coalesce("node", "h").alias("k")).agg(F.min("h").alias("h"))
    key = "text_key"
    while key in documents.columns:
        key += "_"
    keyed = documents.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    found = keyed.join(chosen.select("doc_id", F.col("h").alias(key)).distinct(), ["doc_id", key], "left_semi")
    return found.dropDuplicates(["doc_id", key]).drop(key).unionByName(documents.where("doc_id is null"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ')
                        ELSE array_to_string(w[i:i + {SHINGLE - 1}], ' ') END AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * n_both >= {PERCENT} * (nx.n + ny.n - n_both)
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.id WHERE r.root < b.y
), c AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, documents.doc_id = c.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.id = documents.doc_id
"""
