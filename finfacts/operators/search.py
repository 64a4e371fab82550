"""Institution look-up by name, id or city."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def match_institutions(
    institutions: DataFrame, terms: Sequence[str], with_city: bool = False, limit: int = 80,
    blank_matches_all: bool = False,
) -> DataFrame:
    """The first ``limit`` institutions (by numeric id) whose name or id, or city too, contains
    each term. Terms are tested row-wise, and the limit is applied before the shuffle."""

    def hit(term: Column) -> Column:
        low = F.lower(term)
        test = F.contains(F.lower(F.col("name")), low) | F.contains(F.col("rssd_id"), term)
        if with_city:
            test = test | F.coalesce(F.contains(F.lower(F.col("city")), low), F.lit(False))
        return F.when(term == "", F.lit(blank_matches_all)).otherwise(test)

    order = W.partitionBy("term").orderBy(F.col("rssd_id").try_cast("bigint"), F.col("rssd_id"))
    return (
        institutions.select("*", F.explode(F.filter(F.array(*map(F.lit, terms)), hit)).alias("term"))
        .withColumn("pos", F.row_number().over(order).cast("bigint"))
        .where(F.col("pos") <= limit)
    )
