"""Mixing sources to target weights: temperature on token shares, then budgeted block permutations.

Weights are proportional to ``share ** exponent``. Entropy falls and repetition falls as the exponent grows from 0
(uniform) to 1 (natural). With a target entropy, the exponent is bisected to the largest one whose entropy is not
below the target; with a repetition limit, to the smallest one at which no source is repeated more often than that.
With both, the repetition limit wins. The exponent is a multiple of ``2 ** -STEPS``: the end of the bisection.

Realisation: a source's budget is its weight times the token budget. Whole epochs take every document; the rest of
the budget takes the beginning of a permutation of the source: blocks in hash order, and documents in hash order
within a block, while the tokens before a document are below the budget. Block totals are summed before anything is
ordered, so a hot source is spread over ``BLOCKS`` groups, and only one total for each block is put in sequence.

Null sources form a source of their own. Null and empty texts have no tokens; a source without tokens gets weight 0
and its documents no copies. Repeated rows are documents each (ties in the permutation are ordered by text). Extra
columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

STEPS = 20
BLOCKS = 1024
#: Production targets: 90 % of the largest entropy, no source more than four times, as many tokens as there are.
TARGET_ENTROPY, MAX_REPEATS, BUDGET_RATIO, SEED = 0.9, 4.0, 1.0, 17


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    exponent: float
    normaliser: float  # sum of share ** exponent
    tokens: int
    budget: int


def _measures(shares: DataFrame, exponents: list[float], budget: int) -> list:
    """(exponent, sum of powers, entropy, most repeats) for each exponent, in one aggregate over the sources."""
    grid = shares.select("n", "share", F.explode(F.array(*map(F.lit, exponents))).alias("e"))
    power = F.pow("share", "e")
    sums = grid.groupBy("e").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("e") * F.log("share")).alias("pl"),
        F.max(power / F.col("n")).alias("most"))
    return sorted((r.e, r.z, -(r.pl / r.z) + math.log(r.z), r.most / r.z * budget) for r in sums.collect())


def solve(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_ratio: float) -> Mixture:
    """The mixture for a table (source, n) with n > 0; only one row for each tried exponent reaches the driver."""
    whole = totals.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    if not whole.sources:
        return Mixture(1.0, 1.0, 0, 0)
    tokens, budget = int(whole.n), int(whole.n * budget_ratio)
    shares = totals.select("n", (F.col("n") / F.lit(tokens)).alias("share"))
    least_entropy = None if target_entropy is None else target_entropy * math.log(whole.sources)

    def meets_entropy(m) -> bool:
        return least_entropy is None or m[2] >= least_entropy

    def meets_repeats(m) -> bool:
        return max_repeats is None or m[3] <= max_repeats

    def bisect(holds, up: bool) -> float:
        """``up``: holds below some exponent and the largest such is wanted; else above, and the smallest is wanted."""
        low, high = 0, 2**STEPS
        # 16 probes a job instead of one: five jobs bring a grid of 2 ** 20 to its end.
        while high - low > 1:
            probes = sorted({low + (high - low) * i // 17 for i in range(1, 17)} - {low, high})
            ok = {round(m[0] * 2**STEPS): holds(m) for m in _measures(shares, [p / 2**STEPS for p in probes], budget)}
            if up:
                low = max([low, *(p for p in probes if ok[p])])
                high = min([high, *(p for p in probes if p > low)])
            else:
                high = min([high, *(p for p in probes if ok[p])])
                low = max([low, *(p for p in probes if p < high)])
        return (low if up else high) / 2**STEPS

    ends = {m[0]: m for m in _measures(shares, [0.0, 1.0], budget)}
    exponent = 1.0 if meets_entropy(ends[1.0]) else bisect(meets_entropy, up=True)
    at = _measures(shares, [exponent], budget)[0]
    if not meets_repeats(at):
        exponent = 0.0 if meets_repeats(ends[0.0]) else bisect(meets_repeats, up=False)
    return Mixture(exponent, _measures(shares, [exponent], budget)[0][1], tokens, budget)


def numbered(documents: DataFrame) -> DataFrame:
    """What :func:`mix` reads of the documents, with a number for each row."""
    return documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "text")


def mix(rows: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS,
        budget_ratio: float = BUDGET_RATIO, seed: int = SEED) -> DataFrame:
    """The ``numbered`` documents with n_tokens, weight and copies; texts are not carried."""
    rows = rows.select(
        "_row", "doc_id", "source", n_words("text").alias("n_tokens"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order"),
        F.xxhash64("text").alias("_tie"))
    rows = stored(rows.withColumn("_block", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % BLOCKS), "tokens")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = rows.withColumn("_source", key)
    blocks = stored(rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("n")), "blocks")
    totals = blocks.groupBy("_source").agg(F.sum("n").alias("n")).where("n > 0")
    m = solve(totals, target_entropy, max_repeats, budget_ratio)
    weight = F.pow(F.col("n") / F.lit(m.tokens or 1), F.lit(m.exponent)) / F.lit(m.normaliser)
    planned = totals.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * m.budget).cast("long"))
    planned = planned.select("_source", "weight", F.floor(F.col("budget") / F.col("n")).cast("long").alias("epochs"),
                             (F.col("budget") % F.col("n")).alias("rest"))
    # At most BLOCKS rows of a source are put in sequence here.
    seq = Window.partitionBy("_source").orderBy("_block")
    starts = blocks.join(planned, "_source").withColumn(
        "before", F.sum("n").over(seq.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inside = Window.partitionBy("_source", "_block").orderBy("_order", "_tie", "_row")
    placed = rows.withColumn(
        "_in_block", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    out = placed.join(starts, ["_source", "_block"], "left")
    extra = (F.col("before") + F.col("_in_block") < F.col("rest")).cast("long")
    copies = F.when(F.col("n_tokens") > 0, F.coalesce(F.col("epochs") + extra, F.lit(0))).otherwise(0).cast("long")
    return out.select("_row", "doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                      copies.alias("copies"))


def realise(documents: DataFrame, **targets) -> DataFrame:
    """The mixture itself: every document's row as often as planned, with all its columns."""
    # The columns travel as one, so their names may be any.
    packed = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")
    rows = stored(documents.select(F.monotonically_increasing_id().alias("_row"), packed), "numbered")
    plan = mix(rows.select("_row", "document.doc_id", "document.source", "document.text"), **targets).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(plan.select("_row", "copies"), "_row").select("document", copies.alias("copy")).select("document.*")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(numbered(table(spark, sf_dir, "documents"))).drop("_row")
