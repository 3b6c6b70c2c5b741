"""Row numbers in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a range; ranges are sorted side by side.
RANGE_ROWS = 1_000_000


def numbered(rows: DataFrame, *order: Column | str, name: str = "n", first: int = 1) -> DataFrame:
    """``rows`` with ``name``: each row's place in ``order`` from ``first`` on.

    Rows are dealt by range and numbered within it; what comes before a range is a running total over a
    row for each range. ``order`` should be total, as ties are numbered anyhow.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    total = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = total.select("_part", (F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (first - 1)).alias("_skip"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_inside") + F.col("_skip")).drop("_part", "_inside", "_skip")
