"""Exact lower medians of groups of any size, without a list or a task for a group.

Equal values of a group become one row with their number; these rows are dealt over partitions by ranges of (group, value),
so a large group lies in many. The sizes of a group's pieces, one row a partition, say in which of them the middle lies; only that piece is
counted through, within one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written


def lower_medians(df: DataFrame, keys: tuple[str, ...], value: str, name: str = "median") -> DataFrame:
    """The keys and the lower middle of each group's values, one that occurs; null values do not count, and a group that has
    only such has none. Null keys are a group."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counts = df.select(group.alias("g"), F.col(value).alias("x")).groupBy("g", "x").agg(F.count("x").alias("n"))
    # AQE may merge ranges, which stay in order
    parts = counts.repartitionByRange("g", "x").withColumn("p", F.spark_partition_id())
    parts, _ = written(parts, "ranges")
    pieces = parts.groupBy("g", "p").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    at = pieces.select("g", "p", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    at = at.withColumn("middle", F.expr("(total - 1) div 2")).filter("total = 0 OR before <= middle AND middle < before + n")
    piece = Window.partitionBy("g", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.filter("n > 0").join(at.filter("total > 0").select("g", "p", "before", "middle"), ["g", "p"])
    found = found.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(piece), F.lit(0))).filter("from <= middle AND middle < from + n")
    none = at.filter("total = 0").select("g").distinct().select("g", F.lit(None).cast(df.schema[value].dataType).alias("x"))
    out = found.select("g", "x").unionByName(none)
    return out.select(*(F.col(f"g.{k}").alias(k) for k in keys), F.col("x").alias(name))
