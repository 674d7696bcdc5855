"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvidex.session import durable


def ordinal_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with column ``name``: 1..n in ``order``, which must tell all rows apart.

    Rows are range-partitioned by ``order``, numbered within their part, and
    moved by the sizes of the parts before; only those sizes, one row a part,
    are gathered.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    offsets = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    within = Window.partitionBy("part_").orderBy(*order)
    numbered = ranged.withColumn("local_", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), "part_").withColumn(name, F.col("local_") + F.col("offset_")).drop("part_", "local_", "offset_")
