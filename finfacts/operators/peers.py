"""Peer groups by asset size and leave-one-out peer averages for every institution at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from finfacts.functions.numeric import is_ratio, round_half_up
from finfacts.operators.facts import CELL, with_meta
from finfacts.operators.intervals import band_join
from finfacts.reference_data import PEER_BUCKETS, PEER_CODES, PEER_GROUP_ALIASES, SIZE_CODE

Bucket = tuple[str, float | None, float | None]
# A sum of decimals is exact in any order; larger magnitudes are summed apart as doubles.
EXACT_LIMIT = 1e21


def peer_group(name: str) -> str:
    """Canonical group name; both short and ``size:`` spellings are accepted."""
    try:
        return PEER_GROUP_ALIASES[name]
    except KeyError:
        raise ValueError(f"unknown peer group {name!r}") from None


def in_bucket(size: Column, bucket: Bucket) -> Column:
    _, low, high = bucket
    test = size.isNotNull()
    if low is not None:
        test = test & (size >= low)
    if high is not None:
        test = test & (size < high)
    return test


def _memberships(size: Column, buckets: Sequence[Bucket]) -> Column:
    """Array of ``(peer_group, is_member)``; everyone is in ``all``, buckets may overlap."""
    rows = [F.struct(F.lit("all").alias("peer_group"), F.lit(True).alias("is_member"))]
    for b in buckets:
        rows.append(
            F.struct(
                F.lit(b[0]).alias("peer_group"),
                F.coalesce(in_bucket(size, b), F.lit(False)).alias("is_member"),
            )
        )
    return F.array(*rows)


def peer_rows(facts: DataFrame, codes: Sequence[str], buckets: Sequence[Bucket]) -> DataFrame:
    """One row per institution and quarter with a column ``v_<code>`` per code, and the memberships.

    A zero text that counts for peers but is no reported ratio is kept as NaN (no text parses to
    NaN). With one column per code the group totals and the institutions' own rows read exactly
    the same aggregate, so Spark runs it once and reuses its shuffle for both. Facts are keyed by
    calendar quarter ends, which bounds the size of the group totals.
    """
    # The NaN is computed from the zero itself: two NaN literals never compare equal, which would
    # make the two uses of this aggregate look different to the planner.
    value = F.when(is_ratio("value_raw"), F.col("value_num")).when(
        F.col("value_num").isNotNull(), F.sqrt(F.col("value_num") - 1.0)
    )
    return (
        facts.where(F.col("code").isin([*codes, SIZE_CODE]))
        # The join below adds the NULL test to one of its sides only; said here, both have it.
        .where(F.col("quarter_date").isNotNull())
        .groupBy(*CELL)
        .agg(
            F.max(F.when(F.col("code") == SIZE_CODE, F.col("value_num"))).alias("size"),
            *[F.max(F.when(F.col("code") == c, value)).alias(f"v_{c}") for c in codes],
        )
        .withColumn("groups", _memberships(F.col("size"), buckets))
    )


def counted(code: str) -> Column:
    """The value as peers count it."""
    return F.nanvl(F.col(f"v_{code}"), F.lit(0.0))


def _exact(value: Column) -> Column:
    """The value as a decimal, 0 where it is too large for one."""
    return F.when(F.abs(value) < EXACT_LIMIT, value).otherwise(F.lit(0.0)).cast("decimal(30,8)")


def _large(value: Column) -> Column:
    """The value where :func:`_exact` leaves it out, else 0."""
    return F.when(F.abs(value) >= EXACT_LIMIT, value).otherwise(F.lit(0.0))


def group_totals(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    return (
        rows.select(*CELL, *[f"v_{c}" for c in codes], F.inline("groups"))
        .where("is_member")
        .groupBy("quarter_date", "peer_group")
        .agg(
            *[F.sum(_exact(counted(c))).alias(f"sum_{c}") for c in codes],
            *[F.sum(_large(counted(c))).alias(f"large_{c}") for c in codes],
            *[F.count(f"v_{c}").alias(f"n_{c}") for c in codes],
        )
    )


def is_member(group: str) -> Column:
    return F.exists("groups", lambda g: (g["peer_group"] == group) & g["is_member"])


def one_group_totals(rows: DataFrame, codes: Sequence[str], group: str) -> DataFrame:
    """Totals of one group, one row a quarter. Members are told apart inside the sums: a filter would send
    the planner looking for partitions to prune with the other side of the join."""
    inside = rows.withColumn("inside", is_member(group))
    return inside.groupBy("quarter_date").agg(
        *[F.sum(F.when(F.col("inside"), _exact(counted(c)))).alias(f"sum_{c}") for c in codes],
        *[F.sum(F.when(F.col("inside"), _large(counted(c)))).alias(f"large_{c}") for c in codes],
        *[F.count(F.when(F.col("inside"), F.col(f"v_{c}"))).alias(f"n_{c}") for c in codes],
    )


def others_average(code: str, value: Column, is_member: Column) -> Column:
    """The group's average of a code without the institution itself, from a joined row of totals. A member
    that reports nothing is not counted, so nothing is taken away for it."""
    counts = is_member & value.isNotNull()
    own = F.when(counts, _exact(F.nanvl(value, F.lit(0.0)))).otherwise(F.lit(0))
    own_large = F.when(counts, _large(F.nanvl(value, F.lit(0.0)))).otherwise(F.lit(0.0))
    n = F.coalesce(f"n_{code}", F.lit(0)) - counts.cast("bigint")
    total = (F.col(f"sum_{code}") - own).cast("double") + (F.col(f"large_{code}") - own_large)
    return round_half_up(total / F.nullif(n, F.lit(0)), 6)


def size_groups(facts: DataFrame, buckets: Sequence[Bucket] = PEER_BUCKETS) -> DataFrame:
    """Every (institution, quarter, peer group) membership."""
    sizes = facts.groupBy(*CELL).agg(F.max(F.when(F.col("code") == SIZE_CODE, F.col("value_num"))).alias("size"))
    return (
        sizes.select(*CELL, "size", F.inline(_memberships(F.col("size"), buckets)))
        .where("is_member")
        .drop("is_member")
    )


def band_groups(facts: DataFrame, bands: DataFrame) -> DataFrame:
    """Memberships for a table of size bands ``(peer_group, lo, hi)``: low end included, high end excluded, null open.
    Everyone is in ``all``; bands may overlap, and there may be thousands."""
    sizes = facts.groupBy(*CELL).agg(F.max(F.when(F.col("code") == SIZE_CODE, F.col("value_num"))).alias("size"))
    inside = band_join(sizes, F.col("size"), bands.select("peer_group", "lo", "hi"), high_closed=False)
    named = inside.select(*CELL, "size", "peer_group")
    return sizes.select(*CELL, "size", F.lit("all").alias("peer_group")).unionByName(named)


def peer_averages(
    facts: DataFrame, codes: Sequence[str] = PEER_CODES, buckets: Sequence[Bucket] = PEER_BUCKETS
) -> DataFrame:
    """Plain group averages ``(quarter_date, peer_group, code, n_banks, peer_average)``."""
    totals = group_totals(peer_rows(facts, codes, buckets), codes)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("code"), F.col(f"n_{c}").alias("n_banks"),
                round_half_up(
                    (F.col(f"sum_{c}").cast("double") + F.col(f"large_{c}")) / F.nullif(F.col(f"n_{c}"), F.lit(0)), 6)
                .alias("peer_average"),
            )
            for c in codes
        ]
    )
    return totals.select("quarter_date", "peer_group", F.inline(cells)).where("n_banks > 0")


def leave_one_out(
    facts: DataFrame,
    codes: Sequence[str] = PEER_CODES,
    buckets: Sequence[Bucket] = PEER_BUCKETS,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Each institution's valid peer-code ratios beside the average of the *other* members.

    ``(rssd_id, quarter_date, peer_group, code, bank_value, n_peers, peer_average)`` for each
    requested group (all of them by default); an empty peer set gives a NULL average.

    The average without self is ``(sum - own) / (n - 1)``: group sums and one lookup join,
    instead of pairing institutions with each other. Sums are decimal, so subtracting is exact.
    """
    names = ["all", *[b[0] for b in buckets]]
    wanted = [peer_group(g) for g in groups] if groups is not None else names
    rows = peer_rows(facts, codes, buckets)
    # One totals row per calendar quarter and group; adaptive execution broadcasts it by its real size.
    totals = group_totals(rows, codes)
    asked = (
        rows.select(*CELL, *[f"v_{c}" for c in codes], F.inline("groups"))
        .where(F.col("peer_group").isin(wanted))
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("code"), F.col(f"v_{c}").alias("v"),
                F.col(f"sum_{c}").alias("total"), F.col(f"large_{c}").alias("large"), F.col(f"n_{c}").alias("n"),
            )
            for c in codes
        ]
    )
    # Only reported ratios get a row, and those are always castable, so a member is always counted.
    own = F.when(F.col("is_member"), _exact(F.col("v"))).otherwise(F.lit(0))
    own_large = F.when(F.col("is_member"), _large(F.col("v"))).otherwise(F.lit(0.0))
    n_peers = F.coalesce("n", F.lit(0)) - F.col("is_member").cast("bigint")
    return (
        asked.join(totals, ["quarter_date", "peer_group"], "left")
        .select(*CELL, "peer_group", "is_member", F.inline(cells))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .select(
            *CELL, "peer_group", "code", F.col("v").alias("bank_value"), n_peers.alias("n_peers"),
            round_half_up(
                ((F.col("total") - own).cast("double") + (F.col("large") - own_large)) / F.nullif(n_peers, F.lit(0)), 6)
            .alias("peer_average"),
        )
    )


def position(higher_better: Column, difference: Column) -> Column:
    """``Above`` when the institution does at least as well as its peers; unknown direction counts as lower-better."""
    good = F.when(F.coalesce(higher_better, F.lit(False)), difference >= 0).otherwise(difference <= 0)
    return F.when(difference.isNull(), "-").when(good, "Above").otherwise("Below")


def with_difference(peers: DataFrame) -> DataFrame:
    """Label, category, difference to peers and position."""
    return (
        with_meta(peers)
        .withColumn("difference", round_half_up(F.col("bank_value") - F.col("peer_average"), 6))
        .withColumn("position", position(F.col("higher_better"), F.col("difference")))
    )


def top_peer_rows(peers: DataFrame, codes: Sequence[str] = PEER_CODES, n: int = 12) -> DataFrame:
    """The first ``n`` peer codes per institution, quarter and group, in list order."""
    place = F.array_position(F.array(*map(F.lit, codes)), F.col("code"))
    order = W.partitionBy(*CELL, "peer_group").orderBy(place.asc(), F.col("code"))
    return (
        peers.where(F.col("peer_average").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
    )
