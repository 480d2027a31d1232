"""Contextual characters: what a neighbourhood of k steps looks like around each element."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.operators.aggregates import weighted_percentiles
from morphloom.operators.graph import k_hop
from morphloom.operators.quantiles import known
from morphloom.operators.relational import to_long


def percentile_context(edges: DataFrame, k: int, values: DataFrame, node: str, columns: Sequence[str], at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """``c__5``, ``c__50``, ``c__95`` of each column over N_k; null and NaN are left out, isolates null."""
    pairs = k_hop(edges, k)
    joined = pairs.join(values.select(F.col(node).alias("neighbor"), *columns), "neighbor")
    aggs = [F.percentile(F.when(known(c), F.col(c).cast("double")), F.array(*map(F.lit, at))).alias(c) for c in columns]
    out = joined.groupBy("focal").agg(*aggs)
    named = [F.col(c)[i].alias(f"{c}__{round(100 * p)}") for c in columns for i, p in enumerate(at)]
    return values.select(F.col(node).alias("focal")).distinct().join(out.select("focal", *named), "focal", "left")


def kernel_weight(distance: Column, bandwidth: Column, kernel: str) -> Column:
    """gaussian exp(-(u/2)^2) / (sqrt(2) pi) with u = distance / bandwidth; inverse; or -distance."""
    if kernel == "gaussian":
        u = distance / bandwidth
        return F.exp(-(u / 2) * (u / 2)) / F.lit(math.sqrt(2) * math.pi)
    return F.try_divide(F.lit(1.0), distance) if kernel == "inverse" else -distance


def weighted_context(edges: DataFrame, k: int, values: DataFrame, node: str, columns: Sequence[str], kernel: str = "gaussian", bandwidth: float = -1) -> DataFrame:
    """(focal, char, median, iqr): distance-weighted over N_k, neighbours at distance 0 left out.

    The bandwidth is each focal element's own: its largest distance (-1), its mean (0), or a
    constant. ``values`` has the coordinates x and y.
    """
    at = values.select(F.col(node).alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = k_hop(edges, k).join(at.withColumnRenamed("_n", "focal"), "focal")
    near = values.select(F.col(node).alias("neighbor"), "x", "y")
    pairs = pairs.join(near, "neighbor").select("focal", "neighbor", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("distance")).where("distance > 0")
    reach = F.max("distance") if bandwidth == -1 else F.avg("distance")
    width = pairs.groupBy("focal").agg((reach if bandwidth <= 0 else F.lit(float(bandwidth))).alias("bandwidth"))
    weighted = pairs.join(width, "focal").select("focal", "neighbor", kernel_weight(F.col("distance"), F.col("bandwidth"), kernel).alias("weight"))
    long = to_long(values.withColumnRenamed(node, "neighbor"), ["neighbor"], columns)
    out = weighted_percentiles(weighted.join(long, "neighbor"), ["focal", "char"], "value", "weight")
    return out.select("focal", "char", F.col("p50").alias("median"), (F.col("p75") - F.col("p25")).alias("iqr"))


def mean_pair_distance(edges: DataFrame, distances: DataFrame, k: int) -> DataFrame:
    """(focal, mean): mean distance over adjacent pairs both of whose ends lie in N_k.

    ``distances`` has focal, neighbor, distance for the adjacent pairs, each once.
    """
    near = k_hop(edges, k)
    a = near.join(distances.select(F.col("focal").alias("neighbor"), F.col("neighbor").alias("other"), "distance"), "neighbor")
    both = a.join(near.select("focal", F.col("neighbor").alias("other")), ["focal", "other"])
    return both.groupBy("focal").agg(F.avg("distance").alias("mean"))


def neighbour_difference(edges: DataFrame, values: DataFrame, node: str, value: str, name: str) -> DataFrame:
    """Mean absolute difference to the neighbours (loops left out)."""
    a = values.select(F.col(node).alias("focal"), F.col(value).alias("_a"))
    b = values.select(F.col(node).alias("neighbor"), F.col(value).alias("_b"))
    pairs = edges.where("focal <> neighbor").select("focal", "neighbor").join(a, "focal").join(b, "neighbor")
    return pairs.groupBy("focal").agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias(name))
