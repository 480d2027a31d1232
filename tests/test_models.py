"""Projection, outlines and library models."""

import math

import numpy as np
from pyspark.sql import functions as F

from morphloom.functions.projection import to_equal_area
from morphloom.operators import learn, outline


def test_projection_at_known_points(spark):
    x, y = to_equal_area(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame([(10.0, 52.0), (5.0, 50.0)], "lon double, lat double").select(x, y).collect()
    assert np.allclose([tuple(r) for r in got], [(4321000, 3210000), (3962799.45, 2999718.85)], atol=0.01)


def test_hulls_and_triangles(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (60, 2)))] + [(k, 100 + 10 * k + i, float(c[0]), float(c[1])) for k in (0, 1) for i, c in enumerate([(-1, -1), (2, -1), (2, 2), (-1, 2)])]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double").repartition(5)
    for r in outline.hulls(df, "g").collect():
        assert {(p.x, p.y) for p in r.ring} == {(-1, -1), (2, -1), (2, 2), (-1, 2)}
    p = rng.uniform(0, 1, (25, 2))
    t = outline.delaunay(p)
    for a, b, c in t:  # no point inside a circumcircle
        m = np.array([p[b] - p[a], p[c] - p[a]]) * 2
        centre = p[a] + np.linalg.solve(m, [(p[b] - p[a]) @ (p[b] - p[a]), (p[c] - p[a]) @ (p[c] - p[a])])
        assert (np.hypot(*(p - centre).T) > np.hypot(*(p[a] - centre)) - 1e-9).all()
    edges = outline.delaunay_edges(df, "id", "g")
    assert edges.count() > 100
    parts = outline.natural_cities(edges, 20)
    assert {r.component % 2 for r in parts.collect()} == {0, 1}


def test_models(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), float(rng.normal(5 * (i % 2), 0.2)), float(rng.normal(0, 1)), "ab"[i % 2]) for i in range(80)], "id long, u double, v double, label string")
    for bisecting in (False, True):
        got = learn.kmeans(df, ["u", "v"], 2, bisecting=bisecting)
        assert got.groupBy("label").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    assert math.isclose(learn.principal_components(df, ["u", "v"], 2).agg(F.corr("pc1", "pc2")).first()[0], 0, abs_tol=1e-6)
    assert learn.importances(df, ["u", "v"], "label")["a"]["u"] > 0.8
    assert learn.agreement(learn.predict_class(df, ["u", "v"], "label"), "label", "predicted").first().kappa == 1.0
