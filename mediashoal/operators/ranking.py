"""Numbers in a global order, without one task that sorts or counts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediashoal.storage import materialize


def ordered_index(df: DataFrame, *keys: str, name: str = "index") -> DataFrame:
    """``df`` with consecutive numbers from 0 by ``keys``, which must be distinct.

    A range-partitioned sort is written once with its partition numbers; only the
    partitions' counts meet in one task.
    """
    part = f"{name}_part"
    rows = materialize(df.orderBy(*keys).withColumn(part, F.spark_partition_id()), "ordered")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    return rows.withColumn("place", place).join(F.broadcast(offsets), part).withColumn(name, (F.col("offset") + F.col("place") - 1).cast("bigint")).drop(part, "offset", "place")
