"""The nearest line of upright and other outlines, with and without Python, against plain geometry."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.functions import overlay as O
from morphloom.functions import polygons as K
from morphloom.operators import polygons

RINGS = "array<array<struct<x:double,y:double>>>"
LINE = "array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_nearest_lines_of_any_shape(spark):
    rng = np.random.default_rng(5)
    shapes = [[box(*rng.uniform(0, 60, 2), *rng.uniform(1, 6, 2))] for _ in range(30)]
    shapes += [[box(20.0, 20.0, 12.0, 12.0), box(24.0, 24.0, 4.0, 4.0)], [[(5.0, 5.0), (9.0, 5.0), (5.0, 9.0), (5.0, 5.0)]]]
    lines = [[(0.0, 10.0), (60.0, 10.0)], [(30.0, 0.0), (30.0, 40.0)], [(26.0, 25.0), (26.0, 27.0)], [(0.0, 60.0), (60.0, 30.0)], [(50.0, 50.0), (55.0, 50.0), (55.0, 58.0)]]
    rows = spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r] for r in s]) for i, s in enumerate(shapes)], f"id long, rings {RINGS}")
    roads = spark.createDataFrame(list(enumerate(lines)), f"nID long, line {LINE}")
    got = {r.id: (r.nID, round(r.distance, 9)) for r in polygons.nearest_line(rows, roads, "id", "nID", 3.0).collect()}
    edges = [np.stack([q[:-1], q[1:]], 1) for q in map(np.array, lines)]
    far = [[K.segment_gap(O.closed_edges([np.array(r)[:-1] for r in s]), e) for e in edges] for s in shapes]
    want = {i: min((round(d, 9), k) for k, d in enumerate(f)) for i, f in enumerate(far)}
    assert got == {i: (k, d) for i, (d, k) in want.items()}


def test_plain_pairs_need_no_python_and_no_driver(spark, monkeypatch):
    """every pair was measured in Python, and the boxes of all buildings were broadcast."""

    @F.arrow_udf(T.DoubleType())
    def refuse(rings: pa.Array, line: pa.Array) -> pa.Array:
        if rings.null_count < len(rings):
            raise ValueError("measured in Python")
        return pa.nulls(len(rings), pa.float64())

    monkeypatch.setattr(K, "line_distance", refuse)
    asked = []
    monkeypatch.setattr(polygons.P, "materialize", lambda df, name, f=polygons.P.materialize: asked.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    x = F.col("id") * 10.0
    ring = F.array(*(F.struct((x + a).alias("x"), F.lit(b).alias("y")) for a, b in box(1.0, 2.0, 6.0, 5.0)))
    rows = spark.range(12_000).select("id", F.array(ring).alias("rings"))
    roads = spark.range(12_000).select(F.col("id").alias("nID"), F.array(*(F.struct((F.col("id") * 10.0 + a).alias("x"), F.lit(-1.0).alias("y")) for a in (0.0, 10.0))).alias("line"))
    out = polygons.nearest_line(rows, roads, "id", "nID", 5.0).where("id = nID").agg(F.count(F.lit(1)), F.min("distance"), F.max("distance")).first()
    assert tuple(out) == (12_000, 3.0, 3.0)
    assert "Broadcast" not in asked[0]
