"""Exact percentiles of a whole column without a task that holds it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.storage import materialize


def known(column: str):
    """Neither null nor NaN."""
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def exact_percentiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float] | None:
    """The percentiles (linear between neighbouring ranks) of all values that are neither null nor NaN; None without any.

    Equal values are counted before the shuffle and sorted in ranges; only one count a range, and
    the values at the ranks asked for, reach the driver.
    """
    counts = df.where(known(column)).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(r.n for r in sizes)
    if not total:
        return None
    places = [(total - 1) * p for p in at]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    wanted, base = [], 0
    for r in sizes:
        wanted += [(r.part, base, rank) for rank in ranks if base <= rank < base + r.n]
        base += r.n
    asked = df.sparkSession.createDataFrame(wanted, "part int, base bigint, rank bigint")
    run = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(asked.select("part").distinct()), "part", "left_semi").withColumn("high", run)
    found = placed.join(F.broadcast(asked), "part").where((F.col("base") + F.col("high") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("base") + F.col("high")))
    value = {r.rank: r.v for r in found.select("rank", "v").collect()}
    out = []
    for x in places:
        low, high = value[math.floor(x)], value[math.ceil(x)]
        out.append(low if low == high else low + (high - low) * (x - math.floor(x)))
    return out
