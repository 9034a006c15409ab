"""Numbers in a total order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.storage import cut


def running(df: DataFrame, sums: dict[str, str], *order: Column) -> DataFrame:
    """``df`` with each column of ``sums`` (new name: column) summed over all rows up to and including a row in ``order`` (which must be total).

    Rows are dealt to ranges and summed; a range's rows go on from what the ranges before it hold. The table of ranges has
    a row a partition.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return placed.select(*df.columns, *[(F.col(f"_b{k}") + F.coalesce(F.sum(c).over(upto), F.lit(0))).alias(name) for k, (name, c) in enumerate(sums.items())])


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``df`` with ``name``: each row's place in ``order`` (which must be total), from 0.

    Rows are dealt to ranges and counted; a range's rows are numbered from where the ranges before it end. The table of
    ranges has a row a partition.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return placed.withColumn(name, F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).drop("_range", "_r", "_n", "_start")
