"""Connected components: a union-find where the edges fit one task, else large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.storage import materialize

EDGES_PER_FILE = 500_000
#: Up to so many distinct edges (some MB) one task answers faster than rounds of joins can.
ONE_TASK = 300_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest member of each node's neighbourhood.

    The join back to a node's minimum has plain keys on both sides, so adaptive execution can
    split a hub's edges; the minimum itself is combined before the shuffle.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _union_find(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the smallest of its component, and that smallest; all edges in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kind = None
        for b in batches:
            kind = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                if a != c:
                    root[max(a, c)] = min(a, c)
        nodes = [n for n in root if root[n] != n]
        for i in range(0, len(nodes), 50_000):
            some = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(n) for n in some], kind)], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest reachable node for every node that has an edge.

    Loops are kept as single components; null ends are ignored. Up to ``one_task`` distinct edges are
    united in one task. Beyond, rounds are logarithmic in the longest path; each is written to the
    shared folder, and two sums tell when nothing moves.
    """
    ends = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).dropna()
    now = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    nodes = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = now.where("u <> v")
    if (n := now.count()) <= one_task:
        now = materialize(_union_find(now), "united")
    else:
        mark = None
        for _ in range(max_rounds):
            now = materialize(_star(_star(now, large=True), large=False).repartition(1 + 2 * n // EDGES_PER_FILE), "edges")
            seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if seen == mark or seen[0] == 0:
                break
            mark, n = seen, seen[0]
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
