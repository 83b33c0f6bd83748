"""Global ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def with_global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row in the order, which must be total.

    Rows are range-partitioned; a place is the place within the partition plus the sizes of those before it, of
    which the driver sees one number for each partition.
    """
    parts = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")  # one row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_within") + F.col("_start")).drop("_part", "_within", "_start")
