"""Places of rows in an order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from finfacts.session import scratch_path


def numbered(frame: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``frame`` with the place of each row, from 0, in the order of some columns that tell its rows apart.

    Rows are numbered in range partitions, so no task holds them all; one count a partition is collected. The partitions
    are written down, because range partitions are sampled anew each time they are made.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, "numbered")
    frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.schema(frame.withColumn("__part", F.lit(0)).schema).parquet(path)
    before, starts = 0, []
    for part, n in sorted((r[0], r.n) for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((part, before))
        before += n
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    offsets = spark.createDataFrame(starts, "__part int, __before long")
    return parts.join(offsets, "__part").select(*frame.columns, (F.col("__before") + inside).alias(name))
