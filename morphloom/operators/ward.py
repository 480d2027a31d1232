"""Ward trees without a task that holds all groups: rounds of mutual nearest neighbours.

Ward's cost is reducible, so two clusters that are each other's cheapest partner merge in any order
of merges; all such pairs of a round merge at once. Without a neighbour graph the tree is that of
one merge at a time (up to ties); under a graph, where a merge may bring clusters nearer, merges
may come in another order than one by one, and heights are made non-decreasing along each branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.operators.components import connected_components
from morphloom.operators.relational import factorize
from morphloom.storage import materialize


def _gap(a: str, b: str) -> Column:
    squares = F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    return F.sqrt(2.0 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * squares)


def ward_merges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(left, right, distance, height, size, round): n - 1 merges; a cluster is named by its smallest member.

    ``nodes`` has id (bigint), size and v (array<double>); ``edges`` has a and b. Parts that no edge
    joins are joined at the end, in the order of their names. ``height`` is the largest distance
    on any branch below.
    """
    now = materialize(nodes.select("id", F.col("size").cast("double").alias("n"), "v", F.lit(0.0).alias("height")), "clusters")
    links = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    merges, left, turn = None, now.count(), 0
    while left > 1:
        if links.isEmpty():  # separate parts: one row each is left
            w = Window.orderBy("id")
            links = materialize(now.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b")).where("b IS NOT NULL"), "links")
        side = lambda end, n, v, h: now.select(F.col("id").alias(end), F.col("n").alias(n), F.col("v").alias(v), F.col("height").alias(h))
        priced = links.join(side("a", "na", "va", "ha"), "a").join(side("b", "nb", "vb", "hb"), "b")
        cost = materialize(priced.select("a", "b", _gap("va", "vb").alias("d")), "costs")
        best = cost.select(F.explode(F.array("a", "b")).alias("id"), F.struct("d", "a", "b").alias("e")).groupBy("id").agg(F.min("e").alias("e"))
        pair = best.groupBy("e.a", "e.b").agg(F.min("e.d").alias("d"), F.count(F.lit(1)).alias("votes")).where("votes = 2").drop("votes")
        pair = pair.join(side("a", "na", "va", "ha"), "a").join(side("b", "nb", "vb", "hb"), "b")
        mean = F.zip_with("va", "vb", lambda p, q: (p * F.col("na") + q * F.col("nb")) / (F.col("na") + F.col("nb")))
        made = pair.select("a", "b", "d", F.greatest("d", "ha", "hb").alias("height"), (F.col("na") + F.col("nb")).alias("n"), mean.alias("v"))
        made = materialize(made, "made")
        step = made.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("distance"), "height", F.col("n").cast("bigint").alias("size"), F.lit(turn).alias("round"))
        merges = step if merges is None else merges.unionByName(step)
        gone = made.select(F.col("b").alias("id"), F.col("a").alias("to"))
        kept = now.join(made.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")
        now = materialize(kept.unionByName(made.select(F.col("a").alias("id"), "n", "v", "height")), "clusters")
        for end in ("a", "b"):
            moved = links.join(gone.withColumnRenamed("id", end), end, "left")
            links = moved.withColumn(end, F.coalesce("to", end)).drop("to")
        links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
        left, turn = now.count(), turn + 1
    if merges is None:
        return nodes.sparkSession.createDataFrame([], "left bigint, right bigint, distance double, height double, size bigint, round int")
    return merges


def cut_levels(nodes: DataFrame, merges: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """(id, level_1 .. level_k): the flat clusters below each cut, the highest first; codes from 0 in
    the order of the smallest member."""
    out = nodes.select("id")
    for i, t in enumerate(sorted(cuts, reverse=True)):
        comps = connected_components(merges.where(F.col("height") <= t).select("left", "right"), "left", "right")
        named = out.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        out = materialize(factorize(named, "component", f"level_{i + 1}").drop("component"), "levels")
    return out
