"""Evaluation of groupings and graphs: deviations, sensitivity, agreement with references, patches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from morphloom.functions import geometry as G
from morphloom.operators import aggregates as A
from morphloom.operators import cluster as C
from morphloom.operators import graph, spatial
from morphloom.operators import relational as R
from morphloom.operators.components import connected_components
from morphloom.operators.quantiles import exact_percentiles
from morphloom.storage import materialize


def deviating_features(df: DataFrame, label: str, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(label, char, deviation): the k characters whose median in a class is furthest, squared, from the global median."""
    overall = {c: (exact_percentiles(df, c, [0.5]) or [0.0])[0] for c in columns}
    medians = df.groupBy(label).agg(*(F.median(c).alias(c) for c in columns))
    long = R.to_long(medians, [label], columns)
    middle = F.create_map(*(F.lit(v) for c in columns for v in (c, overall[c])))
    far = long.withColumn("deviation", F.pow(F.col("value") - middle[F.col("char")], 2)).where("deviation IS NOT NULL")
    w = Window.partitionBy(label).orderBy(F.desc("deviation"), "char")
    return far.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(label, "char", "deviation")


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the order of a hash of their key: the same ones on every run and partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def settle_singletons(labels: DataFrame, edges: DataFrame, key: str, label: str) -> DataFrame:
    """Labels that only one row has become the most frequent label among its neighbours, the smallest on a tie; others stay."""
    single = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(label)
    alone = labels.join(single, label, "left_semi").select(F.col(key).alias("focal"))
    near = edges.where("focal <> neighbor").join(alone, "focal", "left_semi").join(labels.select(F.col(key).alias("neighbor"), label), "neighbor")
    mode = A.mode_smallest(near, ["focal"], label).select(F.col("focal").alias(key), F.col(label).alias("_l"))
    return labels.join(mode, key, "left").withColumn(label, F.coalesce("_l", label)).drop("_l")


def split_share(labels: DataFrame, edges: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """(level, share): the share of rows whose neighbourhood, itself included, holds more than one cluster."""
    near = graph.with_self(edges, labels, key)
    kinds = graph.neighbourhood(near, labels, key, [(F.countDistinct(c) > 1).cast("double").alias(c) for c in levels])
    return kinds.agg(*(F.avg(c).alias(c) for c in levels)).unpivot([], list(levels), "level", "share")


def percentile_band(df: DataFrame, group: str, columns: Sequence[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows that lie between two percentiles of their group in every column."""
    q = df.groupBy(group).agg(*(F.percentile(F.col(c).cast("double"), F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns))
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1])
    return df.join(q, group).where(inside).select(*df.columns)


def diagnostics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(char, range_in_std, flat_start): a column's range in deviations, and whether its minimum is its first quartile."""
    rows = []
    stats = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.stddev_samp(c).alias("s")).alias(c) for c in columns)).first()
    for c in columns:
        first = exact_percentiles(df, c, [0.25])
        s = stats[c]
        rows.append((c, (s.hi - s.lo) / s.s if s.s else None, None if first is None else s.lo == first[0]))
    return df.sparkSession.createDataFrame(rows, "char string, range_in_std double, flat_start boolean")


#: Ranges that pair distances are counted in; distances that are told one by one; rows of a block that meet another block at a time.
RANGES, FEW, STRIPE = 4096, 20_000, 64


def median_pair_distance(df: DataFrame, group: str, key: str, vector: str, block: int = 2048) -> DataFrame:
    """(group, median): the median distance of all pairs in a group (the smaller id first).

    Rows of a group are dealt to blocks, and each pair of blocks is a task's matrix, taken in stripes.
    Squared distances, from products, are counted in ranges; the range that holds the median is cut
    again until few are left, which are then measured by differences. Products are off by ``slack`` at
    most, and so is what stands at a rank: ranges are widened by it. No pair leaves its task but the last few.
    """
    own = df.select(group, F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    sizes = own.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_b"), F.max(norm).alias("_norm"))
    dealt = own.join(sizes, group).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_b").cast("bigint")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: F.struct(F.least("_i", j).alias("i"), F.greatest("_i", j).alias("j")))
    met = materialize(dealt.select(group, "id", "v", "_i", F.explode(pairs).alias("p")).select(group, "id", "v", "_i", "p.i", "p.j"), "blocks")
    kind = df.schema[group].dataType.simpleString()
    norms = {r[0]: r["_norm"] for r in sizes.collect()}

    def counted(asked: dict) -> list:
        """(group, part, k, d, n) of each group's asked ranges: squared distances below (k is -1), in the k-th part, or one by one."""

        def run(keys: tuple, t: pa.Table) -> pa.Table:
            name = keys[0].as_py()
            ids, at = t.column("id").to_numpy(), t.column("_i").to_numpy()
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            i, j = keys[1].as_py(), keys[2].as_py()
            a, b, ida, idb = x[at == i], x[at == j], ids[at == i], ids[at == j]
            slack, squares = 1e-11 * norms[name] + 1e-290, (b**2).sum(1)
            out: list[tuple[int, int, float, int]] = []
            asks = asked.get(name, [])
            below, n, told = [0] * len(asks), np.zeros((len(asks), RANGES), np.int64), [[np.empty(0)] for _ in asks]
            for s in range(0, len(a) if asks else 0, STRIPE):
                p = a[s : s + STRIPE]
                rough = (p**2).sum(1)[:, None] + squares - 2 * p @ b.T
                if i == j:
                    rough[ida[s : s + STRIPE, None] >= idb[None]] = np.nan  # each pair once
                for part, (lo, hi, single) in enumerate(asks):
                    rim = slack if single else 0.0
                    below[part] += int((rough < lo - rim).sum())
                    near = (rough >= lo - rim) & (rough <= hi + rim)
                    if single:
                        r, c = np.nonzero(near)
                        d = np.concatenate([np.empty(0), *(((p[r[u : u + 16384]] - b[c[u : u + 16384]]) ** 2).sum(1) for u in range(0, len(r), 16384))])
                        below[part] += int((d < lo).sum())
                        told[part].append(d[(d >= lo) & (d <= hi)])
                    else:
                        at_ = ((rough[near] - lo) * (RANGES / (hi - lo))).astype(np.int64)
                        n[part] += np.bincount(np.clip(at_, 0, RANGES - 1), minlength=RANGES)
            for part, (_, _, single) in enumerate(asks):
                out.append((part, -1, 0.0, below[part]))
                out += [(part, 0, v, m) for v, m in zip(*(z.tolist() for z in np.unique(np.concatenate(told[part]), return_counts=True)))] if single else [(part, k, 0.0, int(n[part, k])) for k in np.flatnonzero(n[part]).tolist()]
            part, k, d, m = zip(*out) if out else ((), (), (), ())
            return pa.table([pa.array([name] * len(out), keys[0].type), pa.array(part, pa.int32()), pa.array(k, pa.int64()), pa.array(d, pa.float64()), pa.array(m, pa.int64())], names=[group, "part", "k", "d", "n"])

        found = met.groupBy(group, "i", "j").applyInArrow(run, f"{group} {kind}, part int, k bigint, d double, n bigint")
        return found.groupBy(group, "part", "k", "d").agg(F.sum("n").alias("n")).collect()

    # from products, a squared distance of copies may fall below zero
    asked = {g: [(-1e-9 * v, 4.0 * v * (1 + 1e-9) + 1e-300, False)] for g, v in norms.items() if v is not None}
    ranks: dict = {}  # of the two in the middle, from 0, the part asked for each, or its value
    while asked:
        by: dict = {}
        for r in counted(asked):
            by.setdefault((r[0], r["part"]), []).append((r["k"], r["d"], r["n"]))
        following: dict = {}
        for g, asks in asked.items():
            if g not in ranks:
                total = sum(n for k, _, n in by.get((g, 0), []))
                ranks[g] = [[w, 0, None] for w in ((total - 1) // 2, total // 2)] if total else []
            todo: list = []
            for rank in ranks[g]:
                if rank[2] is not None:
                    continue
                lo, hi, single = asks[rank[1]]
                seen = 0
                for k, d, n in sorted(by[g, rank[1]]):
                    if seen <= rank[0] < seen + n:
                        break
                    seen += n
                if single:
                    rank[2] = math.sqrt(d)
                    continue
                step, slack = (hi - lo) / RANGES, 1e-11 * norms[g] + 1e-290
                k = max(k, 0)
                ask = (lo + k * step - 2 * slack - 1e-3 * step, lo + (k + 1) * step + 2 * slack + 1e-3 * step, n <= FEW or step <= 8 * slack)
                if ask not in todo:
                    todo.append(ask)
                rank[1] = todo.index(ask)
            if todo:
                following[g] = todo
        asked = following
    rows = [(g, v[0][2] + (v[1][2] - v[0][2]) * 0.5) for g, v in ranks.items() if v]
    return df.sparkSession.createDataFrame(rows, T.StructType([df.schema[group], T.StructField("median", T.DoubleType())]))


def class_distances(profiles: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(a, b, distance) of every two class profiles: one row a class on either side."""
    v = F.array(*(F.col(c).cast("double") for c in columns))
    a, b = profiles.select(F.col(label).alias("a"), v.alias("va"), F.lit(0).alias("_k")), profiles.select(F.col(label).alias("b"), v.alias("vb"), F.lit(0).alias("_k"))
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, x: t + x))
    return a.join(b, "_k").where("a < b").select("a", "b", gap.alias("distance"))


def pruned_patches(edges: DataFrame, values: DataFrame, key: str, vector: str, most: float, keep: int = 100) -> DataFrame:
    """(key, patch): components of the edges whose ends are at most ``most`` apart in features; the ``keep``
    largest are numbered from 0 by size (then by name), the rest is -1."""
    v = values.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    e = edges.where("focal < neighbor").join(v.select(F.col("_id").alias("focal"), F.col("_v").alias("va")), "focal").join(v.select(F.col("_id").alias("neighbor"), F.col("_v").alias("vb")), "neighbor")
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, x: t + x))
    comps = connected_components(e.where(gap <= most).select("focal", "neighbor"), "focal", "neighbor")
    every = materialize(values.select(F.col(key).alias("node")).join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "patches")
    top = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(keep)
    numbered = top.withColumn("patch", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).cast("int")).select("component", "patch")
    return every.join(F.broadcast(numbered), "component", "left").select(F.col("node").alias(key), F.coalesce("patch", F.lit(-1)).alias("patch"))


def strong_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component): nodes that reach each other along directed edges, named by their smallest.

    Forward and backward reach by the smallest label, as for components; nodes for which both agree are
    settled and leave the graph with their edges, the rest goes on.
    """
    now = materialize(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "arcs")
    going = materialize(edges.select(F.explode(F.array(left, right)).alias("node")).distinct(), "nodes")
    out, nothing = None, F.lit((1 << 63) - 1)

    def spread(label: DataFrame, arcs: DataFrame) -> DataFrame:
        """The smallest label that reaches each node."""
        mark = None
        while True:
            come = arcs.join(label.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("_l"))
            label = materialize(label.join(come, "node", "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label")), "labels")
            seen = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if seen == mark:
                return label
            mark = seen

    for _ in range(max_rounds):
        forward = spread(going.withColumn("label", F.col("node")), now).withColumnRenamed("label", "f")
        # who reaches the root of its region does so inside the region: the root has no smaller label upstream
        inner = now.join(forward.select(F.col("node").alias("u"), F.col("f").alias("fu")), "u").join(forward.select(F.col("node").alias("v"), F.col("f").alias("fv")), "v").where("fu = fv")
        roots = forward.select("node", F.when(F.col("node") == F.col("f"), F.col("node")).otherwise(nothing).alias("label"))
        back = spread(roots, inner.select(F.col("v").alias("u"), F.col("u").alias("v")))
        done = materialize(back.join(forward, "node").where("label = f").select("node", F.col("f").alias("component")), "done")
        out = done if out is None else out.unionByName(done)
        going = materialize(going.join(done, "node", "left_anti"), "nodes")
        if going.isEmpty():
            return out
        now = materialize(now.join(going.select(F.col("node").alias("u")), "u", "left_semi").join(going.select(F.col("node").alias("v")), "v", "left_semi"), "arcs")
    raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")


def capacity_parts(edges: DataFrame, weights: DataFrame, key: str, most: float, max_rounds: int = 60) -> DataFrame:
    """(key, part): connected parts of at most ``most`` in weight, grown by merging neighbours.

    Each round every part points at its lightest neighbour it can join; parts that point at each
    other, and then the smaller name of two, merge. A row heavier than ``most`` is a part of its own.
    """
    part = materialize(weights.select(F.col(key).alias("node"), F.col(key).alias("part"), F.col("weight").cast("double").alias("w")), "parts")
    for _ in range(max_rounds):
        total = materialize(part.groupBy("part").agg(F.sum("w").alias("s")), "totals")
        e = edges.where("focal <> neighbor").join(part.select(F.col("node").alias("focal"), F.col("part").alias("p")), "focal").join(part.select(F.col("node").alias("neighbor"), F.col("part").alias("q")), "neighbor").where("p <> q").select("p", "q").distinct()
        fits = e.join(total.select(F.col("part").alias("p"), F.col("s").alias("sp")), "p").join(total.select(F.col("part").alias("q"), F.col("s").alias("sq")), "q").where(F.col("sp") + F.col("sq") <= most)
        best = fits.groupBy("p").agg(F.min(F.struct((F.col("sp") + F.col("sq")).alias("s"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).alias("e"))
        both = best.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merged = materialize(both.select(F.col("b").alias("part"), F.col("a").alias("_to")), "merged")
        if merged.isEmpty():
            break
        part = materialize(part.join(merged, "part", "left").select("node", F.coalesce("_to", "part").alias("part"), "w"), "parts")
    return part.select(F.col("node").alias(key), "part")


def moran_significance(edges: DataFrame, values: DataFrame, key: str, value: str, permutations: int = 99, seed: int = 1) -> DataFrame:
    """(focal, moran, p): local Moran's I and the pseudo p-value of as many seeded permutations of the other values.

    A permutation gives each neighbour slot the value of a row drawn by a hash of (slot, round):
    drawn values are looked up by number, so no row's neighbourhood needs all values.
    """
    own = materialize(R.dense_ids(values.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), ["_k"], "i"), "numbered")
    stats = own.agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"), F.count(F.lit(1)).alias("n")).first()
    z = own.select("_k", "i", ((F.col("_v") - F.lit(stats.m)) / F.lit(stats.s or 1.0)).alias("z"))
    truth = graph.local_moran(edges, values, key, value)
    slots = edges.where("focal <> neighbor").select("focal", "neighbor").distinct().select("focal", "neighbor", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("turn"))
    drawn = slots.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "focal", "neighbor", "turn"), F.lit(stats.n)))
    lag = drawn.join(z.select("i", F.col("z").alias("_z")), "i").groupBy("focal", "turn").agg(F.avg("_z").alias("lag"))
    tried = lag.join(z.select(F.col("_k").alias("focal"), "z"), "focal").withColumn("_m", F.col("z") * F.col("lag")).join(truth, "focal")
    larger = tried.groupBy("focal").agg(F.sum((F.col("_m") >= F.col("moran")).cast("int")).alias("_n"))
    count = F.least(F.coalesce("_n", F.lit(0)), permutations - F.coalesce("_n", F.lit(0)))
    return truth.join(larger, "focal", "left").select("focal", "moran", ((count + 1) / F.lit(float(permutations + 1))).alias("p"))


def grid_search(configurations: Iterable[dict], run: Callable[..., DataFrame], truth: DataFrame, key: str, label: str) -> DataFrame:
    """(configuration as JSON, clusters, noise, ari): each configuration's grouping (key, cluster) scored against ``truth``."""
    import json

    rows = []
    for c in configurations:
        got = materialize(run(**c).select(key, "cluster"), "grouping").join(truth.select(key, F.col(label).alias("_t")), key)
        s = got.agg(F.countDistinct("cluster").alias("k"), F.avg((F.col("cluster") < 0).cast("double")).alias("noise")).first()
        rows.append((json.dumps(c, sort_keys=True), s.k, s.noise, C.adjusted_rand(got, "_t", "cluster").first().ari))
    return truth.sparkSession.createDataFrame(rows, "configuration string, clusters bigint, noise double, ari double")


def without_each(df: DataFrame, columns: Sequence[str], run: Callable[[list[str]], DataFrame], key: str) -> DataFrame:
    """(left_out, ari): the grouping without each character against the grouping with all of them."""
    full = materialize(run(list(columns)).select(key, F.col("cluster").alias("_full")), "grouping")
    rows = []
    for c in columns:
        part = run([x for x in columns if x != c]).select(key, "cluster")
        rows.append((c, C.adjusted_rand(full.join(part, key), "_full", "cluster").first().ari))
    return df.sparkSession.createDataFrame(rows, "left_out string, ari double")


def boundary_distances(reference: DataFrame, clusters: DataFrame, key: str, step: float = 10.0, most: float = 500.0, ring: str = "ring") -> DataFrame:
    """(key, n, mean, missed): distance of points every ``step`` along reference boundaries to the nearest cluster boundary, at most ``most``."""
    points = reference.select(F.col(key).alias("_ref"), F.explode(G.resampled(F.col(ring), step)).alias("p")).select("_ref", "p.x", "p.y").withColumn("_p", F.concat_ws(" ", "_ref", "x", "y")).dropDuplicates(["_p"])
    lines = clusters.select(F.monotonically_increasing_id().alias("line_id"), F.col(ring).alias("line"))
    near = spatial.nearest_segment(points, lines, "_p", "line_id", most / 8, max_distance=most)
    out = points.join(near, "_p", "left").groupBy("_ref").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.sum(F.col("distance").isNull().cast("int")).alias("missed"))
    return out.withColumnRenamed("_ref", key)


def validation_groups(cells: DataFrame, spots: DataFrame, radius: float, key: str = "id", name: str = "name") -> DataFrame:
    """(name, key): cells whose point lies within ``radius`` of a named spot; a cell may be in several groups."""
    pairs = spatial.within_distance(cells.select(key, "x", "y"), spots.select(F.col(name).alias("_n"), "x", "y"), radius)
    return pairs.select(F.col("r__n").alias(name), key)


def relabel_by_distance(points: DataFrame, key: str, label: str, reach: float, min_size: int = 75) -> DataFrame:
    """(key, label): a group is split where its members are further apart than ``reach``; parts of ``min_size`` or fewer are noise.

    Parts are named label_component, noise label_-1.
    """
    own = points.select(F.col(key).alias("id"), label, "x", "y")
    pairs = spatial.within_distance(own, own, reach).where((F.col(label) == F.col(f"r_{label}")) & (F.col("id") < F.col("r_id")))
    comps = connected_components(pairs.select("id", "r_id"), "id", "r_id")
    named = own.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    token = F.when(F.col("_n") > min_size, F.col("component").cast("string")).otherwise(F.lit("-1"))
    return named.join(sizes, "component").select(F.col("id").alias(key), F.concat_ws("_", F.col(label).cast("string"), token).alias(label))


def crosswalk(buildings: DataFrame, mapping: DataFrame, key: str, group: str, fine: str, coarse: str) -> DataFrame:
    """(key, coarse): a building's class in another cut: by its group, or, for noise without one, by its finest class."""
    by_group = mapping.select(group, F.col(coarse).alias("_g")).dropDuplicates([group])
    by_fine = mapping.groupBy(fine).agg(F.min(coarse).alias("_f"))
    return buildings.join(by_group, group, "left").join(by_fine, fine, "left").select(key, F.coalesce("_g", "_f").alias(coarse))


def kmeans_then_ward(df: DataFrame, key: str, columns: Sequence[str], centres: Sequence[Sequence[float]], cut: float, rounds: int = 10) -> DataFrame:
    """(key, cluster): rows take the flat cluster of their k-means centre in the Ward tree of the centres."""
    from morphloom.operators import learn

    near = materialize(learn.lloyd(df, columns, centres, rounds).select(key, *columns, F.col("cluster").alias("_c")), "centres")
    rows = near.groupBy("_c").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).orderBy("_c").toPandas()  # one row a centre
    flat = C.flat_cut(C.monotone(C.ward_tree(rows[list(columns)].to_numpy(float))), len(rows), cut)
    to = df.sparkSession.createDataFrame([(int(c), int(k)) for c, k in zip(rows["_c"], flat)], "_c int, cluster int")
    return near.join(F.broadcast(to), "_c").select(key, "cluster")


def halved(df: DataFrame, key: str, columns: Sequence[str], levels: int, rounds: int = 10) -> DataFrame:
    """(key, cluster): recursive two-means; a part's name is twice its parent's, plus its side.

    The centres of a part start a deviation to either side of its mean in its widest column. All parts
    of a level are split by the same passes over the table.
    """
    now = materialize(df.select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.lit(1).cast("bigint").alias("cluster")), "halves")
    gap = lambda side: sum(((F.col(c) - F.col(f"{side}_{c}")) ** 2 for c in columns), F.lit(0.0))
    for _ in range(levels):
        s = now.groupBy("cluster").agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}") for c in columns))
        widest = F.greatest(*(F.col(f"s_{c}") for c in columns)) if len(columns) > 1 else F.col(f"s_{columns[0]}")
        first = F.lit(None)
        for c in reversed(columns):
            first = F.when(F.col(f"s_{c}") == widest, F.lit(c)).otherwise(first)
        s = s.withColumn("_w", first)
        move = lambda c, way: F.col(f"m_{c}") + F.when(F.col("_w") == c, F.lit(way) * F.col(f"s_{c}")).otherwise(0.0)
        centres = materialize(s.select("cluster", *(move(c, -1.0).alias(f"a_{c}") for c in columns), *(move(c, 1.0).alias(f"b_{c}") for c in columns)), "centres")
        for _ in range(rounds):
            told = now.join(centres, "cluster").withColumn("_side", (gap("b") < gap("a")).cast("int"))
            mean = lambda c, side, name: F.coalesce(F.avg(F.when(F.col("_side") == side, F.col(c))), F.first(f"{name}_{c}")).alias(f"{name}_{c}")
            centres = materialize(told.groupBy("cluster").agg(*(mean(c, 0, "a") for c in columns), *(mean(c, 1, "b") for c in columns)), "centres")
        now = materialize(now.join(centres, "cluster").withColumn("cluster", 2 * F.col("cluster") + (gap("b") < gap("a")).cast("bigint")).select(key, *columns, "cluster"), "halves")
    return now.select(key, "cluster")


def inconsistency(linkage: np.ndarray, depth: int = 10) -> np.ndarray:
    """How far each merge's distance lies above those of the merges up to ``depth`` levels below it, in their deviations."""
    n = len(linkage) + 1
    out = np.zeros(len(linkage))
    for i in range(len(linkage)):
        seen, level = [], [n + i]
        for _ in range(depth):
            seen += [linkage[v - n, 2] for v in level if v >= n]
            level = [int(c) for v in level if v >= n for c in linkage[v - n, :2]]
        s = np.std(seen, ddof=1) if len(seen) > 1 else 0.0
        out[i] = (linkage[i, 2] - np.mean(seen)) / s if s > 0 else 0.0
    return out


def smallest_core(x: np.ndarray, size: int = 75) -> np.ndarray:
    """Members of the lowest single-linkage cluster with at least ``size`` members: a group's core."""
    z = C.single_tree(x)
    n = len(x)
    for i in range(len(z)):
        if z[i, 3] >= size:
            todo, members = [n + i], []
            while todo:
                v = todo.pop()
                members += [v] if v < n else []
                todo += [] if v < n else [int(z[v - n, 0]), int(z[v - n, 1])]
            return np.sort(members)
    return np.arange(n)


def tightened(x: np.ndarray, labels: np.ndarray, deviations: float = 1.0) -> np.ndarray:
    """Labels with the members gone to noise that join their cluster's single-linkage tree above mean + ``deviations`` standard deviations."""
    out = labels.copy()
    for k in np.unique(labels[labels >= 0]):
        at = np.flatnonzero(labels == k)
        z = C.single_tree(x[at])
        if len(z) > 1:
            flat = C.flat_cut(z, len(at), z[:, 2].mean() + deviations * z[:, 2].std())
            out[at[flat != np.bincount(flat).argmax()]] = -1
    return out


def bandwidth(x: np.ndarray, points: int = 2**12) -> float:
    """Improved Sheather-Jones bandwidth of a sample: the fixed point of the plug-in rule on a cosine transform."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    span = np.ptp(x) or 1.0
    low, high = x.min() - span / 2, x.max() + span / 2
    n = len(np.unique(x))
    density = np.histogram(x, bins=points, range=(low, high))[0] / len(x)
    k = np.arange(1, points)
    middle = (np.arange(points) + 0.5) / points
    squares = np.empty(points - 1)
    for a in range(0, points - 1, 256):  # cosine transform in blocks of frequencies
        squares[a : a + 256] = (2 * np.cos(np.pi * k[a : a + 256, None] * middle) @ density / 2) ** 2
    k2 = (k**2).astype(float)

    def rule(t: float) -> float:
        f = 2 * math.pi**14 * (k2**7 * squares * np.exp(-k2 * math.pi**2 * t)).sum()
        for s in range(6, 1, -1):
            odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
            time = (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (n * f)) ** (2 / (3 + 2 * s))
            f = 2 * math.pi ** (2 * s) * (k2**s * squares * np.exp(-k2 * math.pi**2 * time)).sum()
        return t - (2 * n * math.sqrt(math.pi) * f) ** -0.4

    a, b = 1e-9, 0.1
    if not (rule(a) < 0 < rule(b)):
        return float(0.9 * min(x.std(), np.subtract(*np.percentile(x, [75, 25])) / 1.34) * len(x) ** -0.2)
    for _ in range(200):
        c = (a + b) / 2
        a, b = (c, b) if rule(c) < 0 else (a, c)
    return math.sqrt(b) * (high - low)


def compare_scalers(df: DataFrame, label: str, columns: Sequence[str], subsets: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(scaler, columns, davies_bouldin): how well classes part under each scaling of each subset of characters."""
    rows = []
    for name, own in (subsets or {"all": columns}).items():
        known_rows = df.select(label, *own).dropna()
        scaled = {"standard": A.zscore(known_rows, list(own)), "robust": A.robust_scale(known_rows, own), "power": A.power_scale(known_rows, own)}
        rows += [(s, name, C.internal_scores(t, label, list(own))["davies_bouldin"]) for s, t in scaled.items()]
    return df.sparkSession.createDataFrame(rows, "scaler string, columns string, davies_bouldin double")


def inertia_by_size(sizes: Iterable[int], run: Callable[[int], DataFrame], values: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(size, clusters, noise, inertia): for each minimum size, the squared spread inside the groups and the share left as noise."""
    rows = []
    for size in sizes:
        got = materialize(run(size).select(key, "cluster"), "grouping")
        inside = A.inertia(got.where("cluster >= 0").join(values, key), "cluster", columns).agg(F.sum("inertia"), F.count(F.lit(1))).first()
        noise = got.agg(F.avg((F.col("cluster") < 0).cast("double"))).first()[0]
        rows.append((size, inside[1], noise, inside[0]))
    return values.sparkSession.createDataFrame(rows, "size bigint, clusters bigint, noise double, inertia double")


def profile_tree(profiles: DataFrame, label: str, columns: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Names and single linkage of class profiles: one row a class."""
    rows = profiles.orderBy(label).toPandas()
    return [str(v) for v in rows[label]], C.single_tree(rows[list(columns)].to_numpy(float))


def regional_tree(cells: DataFrame, key: str, region: str, columns: Sequence[str], cut: float, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(key, group) of each region's own Ward cut, and the merges of a second tree over the groups' medians.

    Neighbours of the first tree are those of one region among each row's k nearest; groups are numbered
    over all regions.
    """
    from morphloom.operators import ward

    own = cells.select(F.col(key).cast("bigint").alias("id"), region, *columns)
    scaled = materialize(A.zscore(own, list(columns), [region]).withColumn("v", F.array(*columns)), "regional")
    # regions are kept apart by a coordinate that no feature distance reaches across
    code = R.factorize(scaled.select("id", region, "v"), region, "_r").withColumn("v", F.concat("v", F.array(F.col("_r") * F.lit(1e6))))
    near = spatial.knn(code, code, "id", "v", k).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance").where("distance < 5e5")
    merges = ward.ward_merges(scaled.select("id", F.lit(1).alias("size"), "v"), near)
    side = lambda end: scaled.select(F.col("id").alias(end), F.col(region).alias(f"_{end}"))
    inside = merges.join(side("left"), "left").join(side("right"), "right").where("_left = _right").drop("_left", "_right")
    groups = materialize(ward.cut_levels(scaled, inside, [cut]).withColumnRenamed("level_1", "group"), "groups")
    medians = groups.join(own, "id").groupBy("group").agg(*(F.median(c).alias(c) for c in columns))
    top = materialize(A.zscore(medians, list(columns)).select(F.col("group").alias("id"), F.lit(1).alias("size"), F.array(*columns).alias("v")), "medians")
    pairs = spatial.knn(top, top, "id", "v", k).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return groups.select(F.col("id").alias(key), "group"), ward.ward_merges(top, pairs)
