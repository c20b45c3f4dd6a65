"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import durable


def with_position(df: DataFrame, *order: Column | str, name: str = "_pos") -> DataFrame:
    """Rows with their 0-based position in the order of columns that make rows distinct.

    Rows are parted into ranges and written once, so that both uses see the same parts; positions within a part and the
    number of rows before it give the position. Only the parts' sizes meet in one task.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    marked = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    parts = durable(marked.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per part
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before", *names)
