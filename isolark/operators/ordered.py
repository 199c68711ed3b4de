"""Order-dependent columns (previous value, running number) that tolerate hot keys.

A plain window gathers every row of a key in one task.  Here rows are range
partitioned by (key, order), each partition works locally, and one summary row
per (key, partition) carries the state across partition borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from isolark.session import cut_lineage


def _ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return cut_lineage(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))


def previous_value(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the row before within the key."""
    ranged = _ranged(df, key, order)
    last = ranged.groupBy(key, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_part"))).drop("_last")
    local = Window.partitionBy("_part", key).orderBy(*order)
    rows = ranged.withColumn("_rn", F.row_number().over(local)).withColumn("_prev", F.lag(value).over(local))
    rows = rows.join(carried, [key, "_part"], "left")
    return rows.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))).drop("_part", "_rn", "_prev", "_carry")


def running_number(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """1, 2, 3 ... within the key, in order."""
    ranged = _ranged(df, key, order)
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part", key).orderBy(*order)
    rows = ranged.withColumn("_local", F.row_number().over(local)).join(offsets, [key, "_part"])
    return rows.withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop("_part", "_local", "_before")
