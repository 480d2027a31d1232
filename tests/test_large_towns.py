"""What a town's characters send through the driver: nothing that grows with the town."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions import shapes
from morphloom.operators import graph
from morphloom.operators import spatial
from morphloom.plans import characters


def chosen(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_street_profiles_are_not_broadcast(spark):
    """F16: edges of all buildings or ticks of all streets were broadcast by a guessed size."""
    x = F.col("id") * 30.0
    none = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    b = spark.range(4000).select("id", G.rectangle(x + 3.0, F.lit(2.0), F.lit(9.0), F.lit(5.0)).alias("ring"), none.alias("holes"))
    s = spark.range(1000).select(F.col("id").alias("nID"), F.array(G.point(x, F.lit(0.0)), G.point(x + 30.0, F.lit(0.0))).alias("line"))
    out = characters.street_profile(s, b)
    assert re.search(r"SortMergeJoin \[_k", chosen(out)) and not re.search(r"BroadcastHashJoin \[_k", chosen(out))
    row = out.agg(F.min("sdsSPW"), F.max("sdsSPW"), F.min("sdsSPO"), F.max("sdsSPO")).first()
    assert [round(v, 6) for v in row] == [27.0, 27.0, 0.85, 0.85]


def test_street_graphs_are_not_broadcast(spark):
    """all ends of streets were broadcast."""
    ends = spark.range(6000).select("id", F.explode(F.array(F.concat_ws(" ", "id"), F.concat_ws(" ", F.col("id") + 1))).alias("p"))
    edges = graph.shared_value_edges(ends, "id", "p")
    assert "Broadcast" not in chosen(edges) and edges.count() == 2 * 5999


def test_rows_without_a_hit_are_not_told_by_broadcast(spark, monkeypatch):
    """all rows that had found their nearest line were broadcast."""
    asked = []
    monkeypatch.setattr(spatial, "materialize", lambda df, name, f=spatial.materialize: asked.append(chosen(df)) or f(df, name))
    rows = spark.range(5000)
    out = spatial.widening(rows, "id", 1.0, lambda df, reach: df.where(F.col("id") % 7 < reach).select("id"))
    assert out.count() == out.distinct().count() == 5000 and len(asked) == 8
    assert not any("Broadcast" in p for p in asked)


def test_orientations_are_not_broadcast(spark):
    """alignment broadcast the other side, and cells were given all their characters for one."""
    x = F.col("id") * 10.0
    cells = spark.range(4000).select("id", F.lit(0).alias("eID"), G.rectangle(x, F.lit(0.0), F.lit(10.0), F.lit(20.0)).alias("ring"))
    own = characters.cell_shapes(cells).select("id", "stcOri")
    out = characters.alignment(spark.range(4000).withColumn("o", F.lit(3.0)), "id", "o", own, "id", "stcOri", "a")
    assert "Broadcast" not in chosen(out)
    assert tuple(out.agg(F.count("a"), F.min("a"), F.max("a")).first()) == (4000, 3.0, 3.0)


def test_values_and_dimensions_are_not_broadcast(spark):
    """values of all neighbours and all sides of the wide table were broadcast."""
    edges = spark.range(3000).select(F.col("id").alias("focal"), (F.col("id") + 1).alias("neighbor"))
    near = graph.neighbourhood(edges, spark.range(3001).withColumn("v", F.col("id") * 2.0), "id", [F.sum("v").alias("v")])
    assert "Broadcast" not in chosen(near) and near.agg(F.sum("v")).first()[0] == 2.0 * sum(range(1, 3001))
    cells = spark.range(3000).select("id", (F.col("id") % 7).alias("eID"), (F.col("id") % 5).alias("nID"), (F.col("id") % 3).alias("node"))
    side = lambda n, key, value: spark.range(n).select(F.col("id").alias(key), (F.col("id") * 1.0).alias(value))
    wide = characters.primary(cells, side(3000, "id", "b"), side(7, "eID", "e"), side(5, "nID", "s"), side(3, "node", "n"))
    assert "Broadcast" not in chosen(wide)
    assert wide.where("b = id AND e = id % 7 AND s = id % 5 AND n = id % 3").count() == 3000


def test_upright_rings_have_the_measures_of_any(spark):
    """circles and rectangles of upright rings were searched for, as those of any ring are."""
    rings = [[(1.0, 2.0), (4.0, 2.0), (4.0, 9.0), (1.0, 9.0), (1.0, 2.0)], [(5.0, 1.0), (5.0, 3.0), (0.5, 3.0), (0.5, 1.0), (5.0, 1.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    for ring in rings:
        w, h = shapes._sides([{"x": x, "y": y} for x, y in ring])
        p = np.array(ring)
        a, b, o = shapes.minimum_rectangle(p)
        assert math.isclose(a, max(w, h)) and math.isclose(b, min(w, h)) and min(o % 90, 90 - o % 90) < 1e-9
        assert math.isclose(shapes.enclosing_circle(p)[2], math.hypot(w, h) / 2)
    for other in ([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (-1.0, 1.0), (0.0, 0.0)]):
        assert shapes._sides([{"x": x, "y": y} for x, y in other]) is None
