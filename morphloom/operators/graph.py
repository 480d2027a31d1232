"""Neighbour graphs as edge tables (focal, neighbor, weight) and what is computed over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.storage import materialize


def shared_value_edges(df: DataFrame, node: str, via: str) -> DataFrame:
    """Contiguity: nodes that share a value of ``via`` (a vertex, an order), both directions, no loops."""
    left = df.select(F.col(node).alias("focal"), via).distinct()
    right = df.select(F.col(node).alias("neighbor"), via).distinct()
    pairs = left.join(right.hint("merge"), via).where("focal <> neighbor")
    return pairs.select("focal", "neighbor").distinct().withColumn("weight", F.lit(1.0))


def with_self(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    loops = nodes.select(F.col(node).alias("focal"), F.col(node).alias("neighbor")).distinct().withColumn("weight", F.lit(1.0))
    return edges.where("focal <> neighbor").unionByName(loops)


def from_adjacency(df: DataFrame, focal: str, neighbors: str) -> DataFrame:
    """Edges from arrays of neighbours; a node without any keeps no edge (see ``isolates``)."""
    return df.select(F.col(focal).alias("focal"), F.explode(neighbors).alias("neighbor"), F.lit(1.0).alias("weight"))


def subgraph(edges: DataFrame, ids: DataFrame, node: str) -> DataFrame:
    """Edges with both ends among ``ids``."""
    keep = ids.select(F.col(node).alias("_id")).distinct()
    return edges.join(keep, edges["focal"] == keep["_id"], "left_semi").join(keep, F.col("neighbor") == keep["_id"], "left_semi")


def cardinalities(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Number of neighbours (loops left out) of every node, 0 for isolates."""
    n = edges.where("focal <> neighbor").groupBy("focal").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.col(node).alias("focal")).distinct().join(n, "focal", "left").select("focal", F.coalesce("n", F.lit(0)).alias("n"))


def isolates(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    return nodes.select(F.col(node).alias("focal")).distinct().join(edges.where("focal <> neighbor"), "focal", "left_anti")


def row_standardise(edges: DataFrame) -> DataFrame:
    n = edges.groupBy("focal").agg(F.sum("weight").alias("_t"))
    return edges.join(n, "focal").select("focal", "neighbor", F.try_divide("weight", "_t").alias("weight"))


def decay(edges: DataFrame) -> DataFrame:
    """Inverse of the weight (a distance); 0 where it is 0."""
    return edges.withColumn("weight", F.coalesce(F.try_divide(F.lit(1.0), F.col("weight")), F.lit(0.0)))


def k_hop(edges: DataFrame, k: int, checkpoint_from: int = 3) -> DataFrame:
    """(focal, neighbor) reachable by a walk of 1 to k steps.

    Walks may return: without loops a node is its own neighbour from two steps on, unless it is
    isolated. Each step extends only what the last one found and is made distinct, which combines
    before the shuffle; from ``checkpoint_from`` steps on the frontier is written to cut lineage.
    """
    step = edges.select("focal", "neighbor").distinct()
    hop = step.select(F.col("focal").alias("_via"), F.col("neighbor").alias("_to"))
    reached = frontier = step
    for i in range(2, k + 1):
        frontier = frontier.join(hop, F.col("neighbor") == F.col("_via")).select("focal", F.col("_to").alias("neighbor")).distinct()
        if i >= checkpoint_from:
            frontier = materialize(frontier, "frontier")
        reached = reached.unionByName(frontier)
    return reached.distinct()


def neighbourhood(pairs: DataFrame, values: DataFrame, node: str, aggs: Sequence[Column], all_nodes: DataFrame | None = None) -> DataFrame:
    """Aggregate neighbours' values by focal node; isolates give null if ``all_nodes`` has them."""
    out = pairs.join(values.hint("merge"), pairs["neighbor"] == values[node]).groupBy("focal").agg(*aggs)
    if all_nodes is None:
        return out
    return all_nodes.select(F.col(node).alias("focal")).distinct().join(out, "focal", "left")


def partial_apply(edges: DataFrame, k: int, values: DataFrame, node: str, aggs: Sequence[Column]) -> DataFrame:
    """The aggregate over N_k for every node of ``values``."""
    return neighbourhood(k_hop(edges, k), values, node, aggs, values)


def reached(edges: DataFrame, k: int, items: DataFrame, link: str, value: str, aggs: Callable[[Column], Sequence[Column]], nodes: DataFrame, node: str) -> DataFrame:
    """Aggregate the items attached (by ``link``) to the nodes of N_k.

    Items are first reduced to sums by node, so the k-hop join never carries single items.
    """
    per_node = items.groupBy(F.col(link).alias("_node")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    pairs = k_hop(edges, k)
    out = pairs.join(per_node, pairs["neighbor"] == per_node["_node"]).groupBy("focal").agg(*aggs)
    return nodes.select(F.col(node).alias("focal")).distinct().join(out, "focal", "left")


def lag(edges: DataFrame, values: DataFrame, node: str, value: str, name: str = "lag") -> DataFrame:
    """Sum of weight times the neighbours' value."""
    return neighbourhood(edges, values, node, [F.sum(F.col("weight") * F.col(value)).alias(name)], values)


def strongest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("focal").agg(F.max("weight").alias("weight"))


def local_moran(edges: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """z_i times the row-standardised lag of z, over the population variance."""
    stats = values.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).first()
    z = values.select(node, ((F.col(value) - F.lit(stats.m)) / F.lit(stats.s)).alias("z"))
    lagged = lag(row_standardise(edges.where("focal <> neighbor")), z, node, "z", "zlag")
    return lagged.join(z, lagged["focal"] == z[node]).select("focal", (F.col("z") * F.coalesce("zlag", F.lit(0.0))).alias("moran"))


def degree(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Degree in an undirected edge list; a loop counts twice."""
    ends = edges.select(F.explode(F.array(start, end)).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def mean_incident_length(edges: DataFrame, start: str, end: str, length: str) -> DataFrame:
    ends = edges.select(F.explode(F.array_distinct(F.array(start, end))).alias("node"), length)
    return ends.groupBy("node").agg(F.avg(length).alias("mean_length"))


def square_clustering(edges: DataFrame) -> DataFrame:
    """Share of possible squares through a node that exist, by pairs of its neighbours.

    For neighbours u, w of v: q squares close over common neighbours other than v; possible are
    (deg u - 1 - q - t) + (deg w - 1 - q - t) + q, with t = 1 if u and w are adjacent.
    """
    e = materialize(edges.where("focal <> neighbor").select("focal", "neighbor").distinct(), "simple")
    deg = e.groupBy("focal").agg(F.count(F.lit(1)).alias("d"))
    a = e.select(F.col("focal").alias("v"), F.col("neighbor").alias("u"))
    b = e.select(F.col("focal").alias("v"), F.col("neighbor").alias("w"))
    pairs = materialize(a.join(b, "v").where("u < w"), "wedges")
    common = pairs.groupBy("u", "w").agg(F.count(F.lit(1)).alias("c"))
    t = e.select(F.col("focal").alias("u"), F.col("neighbor").alias("w"), F.lit(1).alias("t"))
    du, dw = deg.select(F.col("focal").alias("u"), F.col("d").alias("du")), deg.select(F.col("focal").alias("w"), F.col("d").alias("dw"))
    full = pairs.join(common, ["u", "w"]).join(t, ["u", "w"], "left").join(du, "u").join(dw, "w")
    q = F.col("c") - 1
    adj = F.coalesce("t", F.lit(0))
    possible = (F.col("du") - 1 - q - adj) + (F.col("dw") - 1 - q - adj) + q
    out = full.groupBy("v").agg(F.sum(q).alias("sq"), F.sum(possible).alias("po"))
    return deg.select(F.col("focal").alias("v")).join(out, "v", "left").select(F.col("v").alias("node"), F.coalesce(F.try_divide(F.col("sq").cast("double"), F.col("po").cast("double")), F.lit(0.0)).alias("clustering"))


def ego_counts(edges: DataFrame, k: int) -> DataFrame:
    """Nodes and undirected edges inside each node's k-step neighbourhood, itself included."""
    simple = materialize(edges.where("focal <> neighbor").select("focal", "neighbor").distinct(), "simple")
    loops = simple.select("focal", F.col("focal").alias("neighbor")).distinct()
    near = materialize(k_hop(simple, k).unionByName(loops).distinct(), "ego")
    inside = (
        near.join(simple.where("focal < neighbor").select(F.col("focal").alias("a"), F.col("neighbor").alias("b")), F.col("neighbor") == F.col("a"))
        .select("focal", "a", "b")
        .join(near.select(F.col("focal"), F.col("neighbor").alias("b")), ["focal", "b"])
        .groupBy("focal")
        .agg(F.count(F.lit(1)).alias("edges"))
    )
    return near.groupBy("focal").agg(F.count(F.lit(1)).alias("nodes")).join(inside, "focal", "left").select("focal", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def meshedness(edges: DataFrame, k: int = 5) -> DataFrame:
    """(e - v + 1) / (2v - 5) of the ego graph."""
    n = ego_counts(edges, k)
    return n.select("focal", F.try_divide((F.col("edges") - F.col("nodes") + 1).cast("double"), (2 * F.col("nodes") - 5).cast("double")).alias("meshedness"))
