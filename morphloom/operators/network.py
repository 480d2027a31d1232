"""Street networks: junctions from lines, degrees, ego-graph measures, dead ends."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.operators.graph import degree, k_hop


def network(lines: DataFrame, key: str = "id", line: str = "line", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): junctions named by their rounded coordinates; edges with length and ends."""
    at = lambda p: F.concat_ws(" ", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    edges = lines.withColumns({"node_start": at(F.col(line)[0]), "node_end": at(F.element_at(line, -1)), "length": G.length(F.col(line)), "linearity": G.linearity(F.col(line))})
    nodes = degree(edges, "node_start", "node_end")
    return nodes, edges


def junction_graph(edges: DataFrame) -> DataFrame:
    """Junction adjacency, both ways, without loops; weight is the shortest edge between two."""
    both = edges.select(F.col("node_start").alias("focal"), F.col("node_end").alias("neighbor"), "length").unionByName(edges.select(F.col("node_end").alias("focal"), F.col("node_start").alias("neighbor"), "length"))
    return both.where("focal <> neighbor").groupBy("focal", "neighbor").agg(F.min("length").alias("weight"))


def ego_measures(edges: DataFrame, k: int = 5) -> DataFrame:
    """By junction, over its k-step ego graph: shares of degrees 1, 3 and 4, nodes per length,
    degree-weighted nodes per length, meshedness and the length of dead-end edges."""
    g = junction_graph(edges)
    deg = degree(edges, "node_start", "node_end")
    ends = g.select("focal").distinct()
    near = k_hop(g, k).unionByName(ends.select("focal", F.col("focal").alias("neighbor"))).distinct()
    kinds = near.join(deg, near["neighbor"] == deg["node"]).groupBy("focal")
    share = lambda d: F.avg((F.col("degree") == d).cast("double"))
    nodes = kinds.agg(share(1).alias("dead_ends"), share(3).alias("three_way"), share(4).alias("four_way"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("degree") - 1).alias("weighted"))
    dead = deg.where("degree = 1").select(F.col("node").alias("dead"))
    e = edges.select(F.col("node_start").alias("a"), F.col("node_end").alias("b"), "length")
    e = e.join(dead.select(F.col("dead").alias("a"), F.lit(True).alias("_a")), "a", "left").join(dead.select(F.col("dead").alias("b"), F.lit(True).alias("_b")), "b", "left")
    e = e.select("a", "b", "length", F.coalesce("_a", "_b", F.lit(False)).alias("dead"))
    inner = near.join(e, near["neighbor"] == F.col("a")).select("focal", "a", "b", "length", "dead").join(near.select("focal", F.col("neighbor").alias("b")), ["focal", "b"])
    inner = inner.groupBy("focal").agg(F.sum("length").alias("length"), F.sum(F.when(F.col("dead"), F.col("length")).otherwise(0.0)).alias("dead_end_length"), F.count(F.lit(1)).alias("edges"))
    out = nodes.join(inner, "focal", "left")
    return out.select(
        "focal", "dead_ends", "three_way", "four_way", "dead_end_length",
        F.try_divide(F.col("nodes").cast("double"), F.col("length")).alias("node_density"),
        F.try_divide(F.col("weighted").cast("double"), F.col("length")).alias("weighted_density"),
        F.try_divide((F.col("edges") - F.col("nodes") + 1).cast("double"), (2 * F.col("nodes") - 5).cast("double")).alias("meshedness"),
    )


def local_closeness(edges: DataFrame, k: int = 5) -> DataFrame:
    """(focal, closeness) in each junction's k-step ego graph, path length along edges.

    An ego graph is bounded by k; the shortest paths in it are found where its edges meet.
    """
    g = junction_graph(edges)
    total = g.select("focal").distinct().count()
    ends = g.select("focal").distinct()
    near = k_hop(g, k).unionByName(ends.select("focal", F.col("focal").alias("neighbor"))).distinct()
    inner = near.join(g.select(F.col("focal").alias("a"), F.col("neighbor").alias("b"), "weight"), near["neighbor"] == F.col("a")).select("focal", "a", "b", "weight")
    inner = inner.join(near.select("focal", F.col("neighbor").alias("b")), ["focal", "b"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["focal"].iloc[0]
        out: dict[str, list[tuple[str, float]]] = {}
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]):
            out.setdefault(a, []).append((b, w))
        far, heap = {}, [(0.0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in far:
                continue
            far[v] = d
            for b, w in out.get(v, ()):
                if b not in far:
                    heapq.heappush(heap, (d + w, b))
        reach = sum(far.values())
        close = (len(far) - 1) / reach * (len(far) - 1) / (total - 1) if reach and total > 1 else 0.0
        return pd.DataFrame({"focal": [start], "closeness": [close]})

    return inner.groupBy("focal").applyInPandas(run, "focal string, closeness double")


def merge_degree_two(edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, street): edges joined through junctions of degree two share a street number."""
    from morphloom.operators.components import connected_components

    ends = edges.select(F.explode(F.array("node_start", "node_end")).alias("node"), F.col(key).cast("bigint").alias("id"))
    through = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2 AND a <> b")
    comps = connected_components(through.select("a", "b"))
    return edges.select(F.col(key).cast("bigint").alias(key)).join(comps.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("street"))


