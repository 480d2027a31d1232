"""Kernels against brute force and closed forms."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions import scalar as S
from morphloom.functions import shapes
from morphloom.operators import aggregates as A
from morphloom.operators import cluster as C
from morphloom.operators import graph, network, spatial, tessellation
from morphloom.operators.components import connected_components
from morphloom.operators.relational import dense_ids
from morphloom.sources import readers, sinks
from morphloom.sources.paged import PagedFeatures
from morphloom.storage import fresh_path
from morphloom.streaming import landing

coordinates = st.tuples(st.integers(-20, 20), st.integers(-20, 20))


@given(st.lists(coordinates, min_size=1, max_size=30))
def test_circle_holds_all_points_and_is_tight(points):
    p = np.array(points, float)
    x, y, r = shapes.enclosing_circle(p)
    d = np.hypot(p[:, 0] - x, p[:, 1] - y)
    assert d.max() <= r + 1e-6
    assert r <= max((np.hypot(*(a - b)) for a in p for b in p), default=0) / math.sqrt(3) + 1e-6


@given(st.floats(1, 50), st.floats(1, 50), st.floats(0, 89))
def test_turned_rectangle(w, h, angle):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    p = np.array([(0, 0), (w, 0), (w, h), (0, h)]) @ np.array([[c, s], [-s, c]])
    long, short, _ = shapes.minimum_rectangle(p)
    assert math.isclose(long, max(w, h), rel_tol=1e-6) and math.isclose(short, min(w, h), rel_tol=1e-6)


def test_simplify_clip_hausdorff():
    line = np.array([(0, 0), (1, 0.05), (2, 0), (3, 5), (4, 0)], float)
    assert shapes.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    square, other = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)
    assert shapes.ring_area(shapes.clip_convex(square, other)) == 1.0
    assert math.isclose(shapes.hausdorff(square, square + 1), math.sqrt(2))


def brute_ward(x, edges):
    groups, links = {i: [i] for i in range(len(x))}, []
    near = {tuple(sorted(e)) for e in edges.tolist() if e[0] != e[1]}
    n = len(x)

    def cost(a, b):
        p, q = x[groups[a]], x[groups[b]]
        return math.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum())

    while near:
        a, b = min(near, key=lambda e: (cost(*e), e))
        links.append(cost(a, b))
        groups[n] = groups.pop(a) + groups.pop(b)
        near = {tuple(sorted(n if v in (a, b) else v for v in e)) for e in near if e != (a, b)}
        near = {e for e in near if e[0] != e[1]}
        n += 1
    return links


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_ward_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, 3))
    edges = np.array([(i, i + 1) for i in range(11)] + [tuple(rng.integers(0, 12, 2)) for _ in range(8)])
    assert np.allclose(C.ward_tree(x, edges)[:, 2], brute_ward(x, edges))


def test_monotone_leaves_and_cuts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    z = C.monotone(C.ward_tree(x))
    assert (np.diff(z[:, 2]) >= 0).all()
    for eom in (False, True):
        labels = C.leaf_clusters(z, 60, 10, eom)
        assert all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40)) and len(set(labels)) == 3
    assert len(set(C.flat_cut(z, 60, 2.0))) == 3 and len(set(C.flat_cut(z, 60, 0.0))) == 60
    assert len(C.single_tree(x)) == 59 and len(set(C.flat_cut(C.single_tree(x), 60, 2.0))) == 3
    assert C.newick(z, [str(i) for i in range(60)], 2.0).count(",") == 2
    assert set(C.leaf_clusters(z, 60, 60)) == {-1}
    same = np.array([0] * 20 + [1] * 20 + [2] * 20)
    assert math.isclose(C.adjusted_mutual_information(np.eye(3) * 20), 1.0) and A.penalised_inertia(10, 2, 3) < 0
    assert len(same) == 60


def test_components_are_union_find(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (200, 150)):
        e = rng.integers(0, n, (m, 2))
        chain = [(i, i + 1) for i in range(1000, 1040)]
        root = {}

        def find(v):
            root.setdefault(v, v)
            while root[v] != v:
                v = root[v]
            return v

        for a, b in [*map(tuple, e.tolist()), *chain]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        df = spark.createDataFrame([*map(tuple, e.tolist()), *chain, (None, 3), (5, None)], "a long, b long")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == {v: find(v) for v in root}


def test_k_hop_keeps_walks_and_does_not_depend_on_partitions(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (4, 4)], "focal long, neighbor long")
    for parts in (1, 7):
        reach = lambda k, parts=parts: {(r.focal, r.neighbor) for r in graph.k_hop(e.repartition(parts), k).collect()}
        assert reach(1) == {(1, 2), (2, 1), (2, 3), (3, 2), (4, 4)}
        assert reach(2) == reach(1) | {(1, 1), (2, 2), (3, 3), (1, 3), (3, 1)}
        assert reach(2) <= reach(3)


def test_rings(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(ring,)], "r array<struct<x:double,y:double>>")
    r = F.col("r")
    got = df.select(G.area(r), G.length(r), G.centroid(r)["x"], G.centroid(r)["y"], G.corners(r), G.contains_point(r, F.lit(1.0), F.lit(1.0)), G.contains_point(r, F.lit(5.0), F.lit(1.0)), G.point_line_distance(F.lit(6.0), F.lit(1.0), r), G.linearity(F.slice(r, 1, 3)), G.line_orientation(F.slice(r, 1, 2)), G.signed_area(G.swap_axes(r))).first()
    assert tuple(got) == (8.0, 12.0, 2.0, 1.0, 4, True, False, 2.0, math.hypot(4, 2) / 6, 0.0, -8.0)


def test_scalars(spark):
    flags = "array<struct<values:array<string>,between:array<double>>>"
    rows = [(1, [(["is_tunnel"], [0.2, 0.7])]), (2, [(["is_tunnel"], None)]), (3, [(["other"], [0.0, 1.0])]), (4, None)]
    df = spark.createDataFrame(rows, f"id long, flags {flags}")
    got = {r.id: (r.s, r.d) for r in df.select("id", S.tunnel_share(F.col("flags")).alias("s"), S.is_long_tunnel(F.col("flags"), F.lit(120.0)).alias("d")).collect()}
    assert math.isclose(got[1][0], 0.5) and got[1][1] and got[2] == (0.0, True) and got[3] == (-1.0, False) and not got[4][1]
    one = spark.range(1).select(S.hit_count(F.lit('<x numberMatched="123">')), S.hit_count(F.lit("none")), S.nan_to_zero(F.lit(float("nan"))), S.last_token(F.lit("1_2_-1")), S.morton(F.lit(3), F.lit(0)), S.morton(F.lit(0), F.lit(3)))
    assert tuple(one.first()) == (123, None, 0.0, "-1", 5, 10)


def test_strict_nan_and_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r for r in A.multi_stat(df, ["k"], ["v"], strict_nan=True).collect()}
    assert math.isnan(got["a"]["v__25"]) and got["a"]["v__median"] == 1.0 and got["b"]["v__25"] == 2.5
    ids = dense_ids(df.where("v IS NOT NULL"), ["v"], "i").orderBy("v").collect()
    assert [r.i for r in ids] == [0, 1, 2]


def test_network(spark):
    lines = [(0, [(0.0, 0.0), (1.0, 0.0)]), (1, [(0.0, 0.0), (-1.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 1.0)]), (3, [(0.0, 0.0), (0.0, -1.0)])]
    df = spark.createDataFrame(lines, "id long, line array<struct<x:double,y:double>>")
    nodes, edges = network.network(df)
    assert sorted(r.degree for r in nodes.collect()) == [1, 1, 1, 1, 4]
    m = {r.focal: r for r in network.ego_measures(edges, 2).collect()}
    assert m["0.0 0.0"].dead_ends == 0.8 and m["0.0 0.0"].dead_end_length == 4.0 and m["0.0 0.0"].meshedness == 0.0
    c = {r.focal: r.closeness for r in network.local_closeness(edges, 2).collect()}
    assert c["0.0 0.0"] == 1.0 and math.isclose(c["1.0 0.0"], 4 / 7)
    row = spark.createDataFrame([(i, [(float(i), 0.0), (i + 1.0, 0.0)]) for i in range(4)], "id long, line array<struct<x:double,y:double>>")
    assert {r.street for r in network.merge_degree_two(network.network(row)[1]).collect()} == {0}


def test_tessellation_covers_the_enclosure(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    ring = "array<struct<x:double,y:double>>"
    buildings = spark.createDataFrame([(1, box(1.0, 1.0, 2.0, 2.0)), (2, box(7.0, 1.0, 2.0, 2.0))], f"id long, ring {ring}")
    enclosures = spark.createDataFrame([(0, box(0.0, 0.0, 10.0, 4.0)), (1, box(200.0, 0.0, 2.0, 2.0))], f"eID long, ring {ring}")
    cells = tessellation.tessellate(buildings, enclosures, 0.5, 50.0)
    areas = {(r.eID, r.building): r.area for r in tessellation.cell_areas(cells, 0.5).collect()}
    assert areas == {(0, 1): 20.0, (0, 2): 20.0, (1, -1): 4.0}
    assert {(r.focal, r.neighbor, r.weight) for r in tessellation.cell_contiguity(cells).collect()} == {(1, 2, 8.0), (2, 1, 8.0)}
    over = spatial.polygon_overlaps(buildings, buildings, 5.0)
    assert {(r.id, r.r_id, r.overlap) for r in over.collect()} == {(1, 1, 4.0), (2, 2, 4.0)}
    roads = spark.createDataFrame([(9, [(0.0, 2.0), (5.0, 2.0)])], f"id long, line {ring}")
    assert [r.id for r in tessellation.away_from_lines(buildings, roads, 0.3, 2.0).collect()] == [2]


def test_sources_and_sinks(spark, tmp_path):
    at = f"{tmp_path}/r"
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    shift = lambda k: [[(x + k, y) for x, y in r] for r in ring]
    df = spark.createDataFrame([(i, 0.5, shift(10.0 * i)) for i in range(20)], "region_id long, value double, rings array<array<struct<x:double,y:double>>>")
    sinks.write_release(df, f"{at}/release")
    near = readers.read_box(spark, f"{at}/release", (-1.0, -1.0, 15.0, 5.0), ["region_id"])
    assert sorted(r.region_id for r in near.collect()) == [0, 1]
    assert "PushedFilters: [IsNotNull(minx)" in near._jdf.queryExecution().toString()
    sinks.write_missing_regions(df.where("region_id < 3"), f"{at}/regions")
    sinks.write_missing_regions(df.where("region_id < 5"), f"{at}/regions")
    assert spark.read.parquet(f"{at}/regions").count() == 5
    sinks.write_float32(df, f"{at}/f32", ["region_id"])
    assert dict(spark.read.parquet(f"{at}/f32").dtypes) == {"region_id": "bigint", "value": "float"}
    (tmp_path / "a.geojson").write_text(json.dumps({"features": [{"properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]}}, {"properties": {"id": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}}]}))
    assert [(r.id, r.part, r.rings[0][0].x) for r in readers.read_geojson(spark, f"{tmp_path}/a.geojson", "id:long").orderBy("id", "part").collect()] == [(1, 0, 0.0), (2, 0, 0.0), (2, 1, 5.0)]
    (tmp_path / "w.csv").write_text('id,wkt\n1,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n')
    assert readers.read_wkt_csv(spark, f"{tmp_path}/w.csv", "id long, wkt string").first().rings[0][2].y == 1.0
    np.save(tmp_path / "z.npy", C.ward_tree(np.arange(6.0).reshape(3, 2)))
    assert readers.read_linkage(spark, f"{tmp_path}/z.npy").count() == 2
    (tmp_path / "feed.xml").write_text('<feed><entry><title>A</title><link href="http://x/1"/></entry></feed>')
    assert tuple(readers.read_feed(spark, f"{tmp_path}/feed.xml").first()) == ("A", "http://x/1")


def test_paged_source(spark, tmp_path):
    for start in (0, 2, 4):
        (tmp_path / f"{start}.json").write_text(json.dumps({"features": [{"properties": {"i": start + k}, "geometry": None} for k in range(min(2, 5 - start))]}))
    spark.dataSource.register(PagedFeatures)
    df = spark.read.format("paged_features").option("template", f"file://{tmp_path}/{{start}}.json").option("total", 5).option("count", 2).load()
    assert sorted(json.loads(r.properties)["i"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_landing_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, 1.0)], "region_id long, v double").write.parquet(f"{tmp_path}/in/{i}")
    stream = landing.read_landing(spark, f"{tmp_path}/in/*", "region_id long, v double")
    landing.run_stage(stream, lambda d: d.groupBy("region_id").agg(F.sum("v").alias("v")), f"{tmp_path}/out", fresh_path(spark, "stream")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_nearest_and_knn_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 100, (60, 2)), rng.uniform(0, 100, (40, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id long, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "other long, x double, y double")
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    got = {r.id: (r.other, round(r.distance, 9)) for r in spatial.nearest(left, right, "id", "other", 2.0).collect()}
    assert got == {i: (int(d[i].argmin()), round(float(d[i].min()), 9)) for i in range(60)}
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(a)], "id long, v array<double>")
    near = {(r.query_id, r.rank): r.id for r in spatial.knn(rows, rows, "id", "v", 3, shard_rows=16).collect()}
    dd = np.hypot(*(a[:, None] - a[None]).transpose(2, 0, 1)) + np.diag([np.inf] * 60)
    assert near == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(dd[i].argsort()[:3])}


@pytest.mark.parametrize("k", [1, 5])
def test_quantile_uniform(spark, k):
    df = spark.createDataFrame([(float(i // k),) for i in range(20)], "v double")
    got = [r.q for r in A.quantile_uniform(df, "v", "q").orderBy("v").collect()]
    assert got == sorted(got) and 0 <= got[0] <= got[-1] <= 1
