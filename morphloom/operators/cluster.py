"""Clustering: density, contiguity-constrained Ward, condensed trees, cuts, and their scores.

Trees are built by numpy kernels, one connected component (or region) in a task, as components
are independent; everything around them is relational.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.operators.components import connected_components
from morphloom.operators.spatial import within_distance
from morphloom.storage import materialize


def dbscan(points: DataFrame, key: str, eps: float, min_weight: float = 5, weight: str | None = None) -> DataFrame:
    """(key, cluster): the smallest core key of the cluster, -1 for noise.

    A core has at least ``min_weight`` within ``eps``, itself included; cores within eps share a
    cluster; a border point joins the cluster of its smallest core neighbour.
    """
    own = points.select(F.col(key).alias("id"), F.col("x").cast("double"), F.col("y").cast("double"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    pairs = materialize(within_distance(own, own, eps).select("id", "r_id", "r_w"), "pairs")
    cores = materialize(pairs.groupBy("id").agg(F.sum("r_w").alias("near")).where(F.col("near") >= min_weight).select("id"), "cores")
    to_core = pairs.join(cores.select(F.col("id").alias("r_id")), "r_id", "left_semi")
    core_edges = to_core.join(cores, "id", "left_semi").select("id", "r_id")
    clusters = connected_components(core_edges, "id", "r_id").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    border = to_core.join(cores, "id", "left_anti").groupBy("id").agg(F.min("r_id").alias("r_id"))
    border = border.join(clusters.select(F.col("id").alias("r_id"), "cluster"), "r_id").select("id", "cluster")
    found = clusters.unionByName(border)
    return own.select("id").join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def ward_tree(x: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """Linkage (left, right, distance, size) by Ward's rule, merging only neighbours if given.

    Ties are broken by node number, so that the tree does not depend on the order of edges.
    Unconnected parts are joined at the end as if adjacent.
    """
    n = len(x)
    size, mean = [1.0] * n, [row.astype(float) for row in x]
    near: dict[int, set[int]] = {i: set() for i in range(n)}
    if edges is None:
        edges = np.array([(i, j) for i in range(n) for j in range(i)]).reshape(-1, 2)
    for a, b in edges.tolist():
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def cost(a: int, b: int) -> float:
        return math.sqrt(2 * size[a] * size[b] / (size[a] + size[b]) * float(((mean[a] - mean[b]) ** 2).sum()))

    heap = [(cost(a, b), min(a, b), max(a, b)) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    alive, out = set(range(n)), []
    while len(alive) > 1:
        if not heap:
            left = sorted(alive)
            for a, b in zip(left, left[1:]):
                near[a].add(b)
                near[b].add(a)
                heapq.heappush(heap, (cost(a, b), a, b))
        d, a, b = heapq.heappop(heap)
        if a not in alive or b not in alive:
            continue
        new = len(size)
        size.append(size[a] + size[b])
        mean.append((size[a] * mean[a] + size[b] * mean[b]) / size[new])
        near[new] = (near.pop(a) | near.pop(b)) - {a, b}
        alive -= {a, b}
        alive.add(new)
        for c in near[new]:
            near[c] -= {a, b}
            near[c].add(new)
            heapq.heappush(heap, (cost(c, new), c, new))
        out.append((a, b, d, size[new]))
    return np.array(out).reshape(-1, 4)


def single_tree(x: np.ndarray) -> np.ndarray:
    """Single linkage from a minimum spanning tree (Prim)."""
    n = len(x)
    if n < 2:
        return np.empty((0, 4))
    best, of, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    left[0], at, links = False, 0, []
    for _ in range(n - 1):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = left & (d < best)
        best[closer], of[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        left[at] = False
        links.append((best[at], of[at], at))
    root, size, out = list(range(2 * n - 1)), [1] * (2 * n - 1), []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for k, (d, a, b) in enumerate(sorted(links)):
        a, b, new = find(a), find(b), n + k
        root[a] = root[b] = new
        size[new] = size[a] + size[b]
        out.append((min(a, b), max(a, b), d, size[new]))
    return np.array(out)


def monotone(linkage: np.ndarray, step: float = 0.01) -> np.ndarray:
    """Distances made non-decreasing: each that falls becomes its predecessor plus ``step``."""
    out = linkage.copy()
    for i in range(1, len(out)):
        if out[i, 2] < out[i - 1, 2]:
            out[i, 2] = out[i - 1, 2] + step
    return out


def leaf_clusters(linkage: np.ndarray, n: int, min_size: int, excess_of_mass: bool = False) -> np.ndarray:
    """Labels from the condensed tree: its leaves, or the most stable clusters; noise is -1.

    Going down from the root, a split whose parts both have ``min_size`` makes two clusters; a
    smaller part falls out of the cluster as noise at that level.
    """
    if n <= min_size or not len(linkage):
        return np.full(n, -1)
    children = {n + i: (int(a), int(b)) for i, (a, b, *_) in enumerate(linkage)}
    size = lambda v: 1 if v < n else int(linkage[v - n, 3])
    lam = lambda v: 1.0 / max(linkage[v - n, 2], 1e-12)

    def under(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            w = todo.pop()
            if w < n:
                out.append(w)
            else:
                todo.extend(children[w])
        return out

    root = n + len(linkage) - 1
    parts: dict[int, list[int]] = {}
    stability: dict[int, float] = {}
    todo = [(root, root, 0.0)]
    while todo:
        cluster, v, born = todo.pop()
        stability.setdefault(cluster, 0.0)
        while v >= n:
            a, b = children[v]
            gain = lam(v) - born
            if size(a) >= min_size and size(b) >= min_size:
                stability[cluster] += gain * size(v)
                parts[cluster] = [a, b]
                todo += [(a, a, lam(v)), (b, b, lam(v))]
                break
            small, large = (a, b) if size(a) < size(b) else (b, a)
            if size(large) < min_size:
                stability[cluster] += gain * size(v)
                break
            stability[cluster] += gain * size(small)
            v = large
    chosen = [c for c in stability if c not in parts]
    if excess_of_mass:
        best: dict[int, tuple[float, list[int]]] = {}
        for c in sorted(stability, key=size):
            below = [best[p] for p in parts.get(c, ())]
            total = sum(s for s, _ in below)
            best[c] = (total, [x for _, cs in below for x in cs]) if below and (total > stability[c] or c == root) else (stability[c], [c])
        chosen = best[root][1]
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(chosen, key=lambda c: min(under(c)))):
        labels[under(c)] = k  # what falls out of a chosen cluster on the way down belongs to it
    return labels


def flat_cut(linkage: np.ndarray, n: int, t: float) -> np.ndarray:
    """Labels 0.. of the parts left when merges above ``t`` are undone, in order of first member."""
    root = list(range(n + len(linkage)))

    def find(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    for i, (a, b, d, _) in enumerate(linkage):
        if d <= t:
            root[find(int(a))] = root[find(int(b))] = n + i
    tops = [find(i) for i in range(n)]
    order = {v: k for k, v in enumerate(dict.fromkeys(tops))}
    return np.array([order[v] for v in tops])


def cluster_components(cells: DataFrame, edges: DataFrame, key: str, columns: Sequence[str], min_size: int, excess_of_mass: bool = False) -> DataFrame:
    """(key, component, cluster): Ward within each component of the graph, then leaf extraction.

    Components of at most ``min_size`` are all noise. One task holds one component.
    """
    comps = connected_components(edges.select("focal", "neighbor"), "focal", "neighbor").select(F.col("node").alias(key), "component")
    data = cells.select(F.col(key).cast("bigint").alias(key), *(F.col(c).cast("double").alias(c) for c in columns)).join(comps, key, "left").withColumn("component", F.coalesce("component", F.col(key)).cast("bigint"))
    inner = edges.where("focal < neighbor").join(comps.select(F.col(key).alias("focal"), "component"), "focal")
    links = inner.select("component", F.col("focal").cast("bigint").alias("focal"), F.col("neighbor").cast("bigint").alias("neighbor"))

    def run(pdf: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        n = len(pdf)
        labels = np.full(n, -1)
        if n > min_size and len(graph):
            at = {v: i for i, v in enumerate(pdf[key].tolist())}
            pairs = np.array([(at[a], at[b]) for a, b in zip(graph["focal"].tolist(), graph["neighbor"].tolist()) if a in at and b in at]).reshape(-1, 2)
            labels = leaf_clusters(monotone(ward_tree(pdf[list(columns)].to_numpy(float), pairs)), n, min_size, excess_of_mass)
        return pd.DataFrame({key: pdf[key].to_numpy(), "component": pdf["component"].to_numpy(), "cluster": labels})

    return data.groupBy("component").cogroup(links.groupBy("component")).applyInPandas(run, f"{key} bigint, component bigint, cluster bigint")


def tree_table(linkage: np.ndarray, spark) -> DataFrame:
    """(node, left, right, distance, size) rows of a linkage; node n + i is merge i."""
    n = len(linkage) + 1
    rows = [(n + i, int(a), int(b), float(d), int(s)) for i, (a, b, d, s) in enumerate(linkage)]
    return spark.createDataFrame(rows, "node bigint, left bigint, right bigint, distance double, size bigint")


def multi_cut(linkage: np.ndarray, n: int, cuts: Sequence[float]) -> pd.DataFrame:
    """One column a cut: level_1 (highest cut) to level_k, for each observation."""
    return pd.DataFrame({f"level_{i + 1}": flat_cut(linkage, n, t) for i, t in enumerate(sorted(cuts, reverse=True))})


def newick(linkage: np.ndarray, names: Sequence[str], cutoff: float = 0.0) -> str:
    """Tree above a cutoff in Newick form; what lies below becomes a leaf named by its first member."""
    n = len(linkage) + 1
    first: dict[int, int] = {i: i for i in range(n)}
    for i, (a, b, *_) in enumerate(linkage):
        first[n + i] = min(first[int(a)], first[int(b)])
    height = lambda v: 0.0 if v < n else float(linkage[v - n, 2])
    text: dict[int, str] = {}
    for v in range(2 * n - 1):
        if v < n or height(v) <= cutoff:
            text[v] = str(names[first[v]])
        else:
            a, b = int(linkage[v - n, 0]), int(linkage[v - n, 1])
            text[v] = "(" + ",".join(f"{text[c]}:{height(v) - max(height(c), cutoff):.6g}" for c in (a, b)) + ")"
    return text[2 * n - 2] + ";"


def leaves_under(tree: DataFrame) -> DataFrame:
    """(node, side, leaf) of every split: the observations under its left and right branch.

    Paths to ancestors double in length each round, so that a tree of any depth takes as many
    rounds as its depth has binary digits.
    """
    nodes = materialize(tree.select("node"), "nodes")
    sides = [tree.select(F.col(side).alias("at"), "node", F.lit(side).alias("side"), F.lit(1).alias("steps")) for side in ("left", "right")]
    paths, span = materialize(sides[0].unionByName(sides[1]), "paths"), 1
    while True:
        far = paths.where(F.col("steps") == span).select(F.col("at").alias("below"), F.col("node").alias("via"))
        on = paths.select(F.col("at").alias("via"), "node", "side", F.col("steps").alias("more"))
        longer = materialize(far.join(on, "via").select(F.col("below").alias("at"), "node", "side", (F.col("more") + span).alias("steps")), "paths")
        if longer.isEmpty():
            break
        paths, span = paths.unionByName(longer), 2 * span
    return paths.join(nodes.withColumnRenamed("node", "at"), "at", "left_anti").select("node", "side", F.col("at").alias("leaf"))


def split_analysis(tree: DataFrame, features: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(node, char, difference): mean under the left branch less mean under the right."""
    under = leaves_under(tree).join(features, F.col("leaf") == features[key])
    side = lambda c, s: F.avg(F.when(F.col("side") == s, F.col(c)))
    wide = under.groupBy("node").agg(*((side(c, "left") - side(c, "right")).alias(c) for c in columns))
    return wide.unpivot(["node"], list(columns), "char", "difference")


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label among a row's neighbours; ties to the smaller label as a string."""
    votes = neighbours.join(labels.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label")), "id")
    counts = votes.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "label")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "label")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, as one row."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    table = contingency(df, a, b)
    both = table.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    one = lambda c, name: table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(name))
    parts = {**both.first().asDict(), **one(a, "a").first().asDict(), **one(b, "b").first().asDict()}
    total = parts["total"] * (parts["total"] - 1) / 2
    expected = parts["a"] * parts["b"] / total
    top = (parts["a"] + parts["b"]) / 2
    return df.sparkSession.createDataFrame([(float((parts["both"] - expected) / (top - expected)) if top != expected else 1.0,)], "ari double")


def adjusted_mutual_information(table: np.ndarray) -> float:
    """Adjusted mutual information of a contingency table (arithmetic mean of entropies)."""
    n, a, b = table.sum(), table.sum(1), table.sum(0)
    p = table[table > 0] / n
    mi = float((p * np.log(p * n * n / np.outer(a, b)[table > 0])).sum())
    h = lambda v: float(-(v[v > 0] / n * np.log(v[v > 0] / n)).sum())
    lg = np.array([math.lgamma(i + 1) for i in range(int(n) + 1)])
    emi = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            if len(k):
                logp = lg[x] + lg[y] + lg[int(n) - x] + lg[int(n) - y] - lg[int(n)] - lg[k] - lg[x - k] - lg[y - k] - lg[int(n) - x - y + k]
                emi += float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    top = (h(a) + h(b)) / 2
    return (mi - emi) / (top - emi) if abs(top - emi) > 1e-15 else 1.0


def adjusted_mutual_information_of(table: DataFrame, a: str, b: str) -> DataFrame:
    """The same from a contingency table (a, b, n), as one row: sums over pairs of different margin sizes.

    Classes with equal sizes have equal expected terms, so that one term is made for each pair of
    sizes, and by its chance of every overlap; nothing as long as the data reaches the driver.
    """
    n = F.col("n").cast("double")
    rows = lambda c: table.groupBy(c).agg(F.sum(n).alias(f"s_{c}"))
    ra, rb = materialize(rows(a), "margin"), materialize(rows(b), "margin")
    total = ra.agg(F.sum(f"s_{a}")).first()[0]
    entropy = lambda r, c: r.agg(-F.sum(F.col(f"s_{c}") / total * F.log(F.col(f"s_{c}") / total))).first()[0]
    mi = table.join(ra, a).join(rb, b).agg(F.sum(n / total * F.log(n * total / (F.col(f"s_{a}") * F.col(f"s_{b}"))))).first()[0]
    sizes = lambda r, c, name: r.groupBy(F.col(f"s_{c}").alias(name)).agg(F.count(F.lit(1)).alias(f"times_{name}"))
    x, y = sizes(ra, a, "x"), sizes(rb, b, "y")

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = 0.0
            for p, q, times in zip(part["x"], part["y"], part["times"]):
                lg = lambda v: np.array([math.lgamma(u + 1) for u in np.atleast_1d(v)])
                k = np.arange(max(1, p + q - total), min(p, q) + 1)
                if len(k):
                    chance = lg(p) + lg(q) + lg(total - p) + lg(total - q) - lg(total) - lg(k) - lg(p - k) - lg(q - k) - lg(total - p - q + k)
                    out += times * float((k / total * np.log(total * k / (p * q)) * np.exp(chance)).sum())
            yield pd.DataFrame({"e": [out]})

    # margins of different sizes only: at most about the root of twice the rows on each side
    pairs = x.withColumn("_all", F.lit(0)).join(y.withColumn("_all", F.lit(0)), "_all").select("x", "y", (F.col("times_x") * F.col("times_y")).alias("times"))
    emi = pairs.repartition(F.xxhash64("x", "y")).mapInPandas(expected, "e double").agg(F.sum("e")).first()[0] or 0.0
    top = (entropy(ra, a) + entropy(rb, b)) / 2
    return table.sparkSession.createDataFrame([((mi - emi) / (top - emi) if abs(top - emi) > 1e-15 else 1.0,)], "ami double")


def internal_scores(df: DataFrame, label: str, columns: Sequence[str]) -> dict[str, float]:
    """Davies-Bouldin and Calinski-Harabasz from centroids; only one row a cluster is gathered."""
    centre = df.groupBy(label).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), F.count(F.lit(1)).alias("n"))
    d2 = sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in columns[1:]), (F.col(columns[0]) - F.col(f"m_{columns[0]}")) * (F.col(columns[0]) - F.col(f"m_{columns[0]}")))
    spread = df.join(centre, label).groupBy(label).agg(F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w"))
    rows = centre.join(spread, label).orderBy(label).toPandas()
    m, s, n = rows[[f"m_{c}" for c in columns]].to_numpy(float), rows["s"].to_numpy(float), rows["n"].to_numpy(float)
    k = len(rows)
    worst = np.empty(k)
    for i in range(k):  # one class against all: no table of all pairs
        gap = np.sqrt(((m - m[i]) ** 2).sum(1))
        gap[i] = np.inf
        worst[i] = ((s + s[i]) / gap).max()
    overall = (m * n[:, None]).sum(0) / n.sum()
    between, within = float((n * ((m - overall) ** 2).sum(1)).sum()), float(rows["w"].sum())
    return {"davies_bouldin": float(worst.mean()), "calinski_harabasz": float(between / within * (n.sum() - k) / (k - 1))}
