"""A gapless global rank without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.storage import Scratch


def global_rank(spark: SparkSession, df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with its position (1, 2, ...) in the total order `order`.

    The rows are range-partitioned and sorted once; the driver sees one count per partition. Rows that `order` can't tell
    apart get neighbouring ranks in no particular order.
    """
    scratch = Scratch(spark, "rank")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed = scratch.save(placed, "placed")
    before, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))
