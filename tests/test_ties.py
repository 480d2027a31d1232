"""Ties of the nearest classes."""

import math

from morphloom.operators import spatial
from morphloom.plans import taxonomy


def test_ties_go_to_the_smaller_id_whatever_their_number(spark):
    """only 2 k rows were measured, so that of three as near the smallest could be lost."""
    at = [(math.cos(t), math.sin(t)) for t in (0, math.pi / 2, math.pi)]
    rows = spark.createDataFrame([(i, [float(round(at[i % 3][0])), float(round(at[i % 3][1]))]) for i in range(40, 0, -1)], "id long, v array<double>")
    asked = spark.createDataFrame([(100, [0.0, 0.0])], "id long, v array<double>")
    assert [(r.rank, r.id) for r in spatial.knn(asked, rows, "id", "v", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_noise_between_two_classes_is_a_tie(spark):
    """scaled rows equally far from two classes could differ in the last bit."""
    classes = spark.createDataFrame([(f"c{i:02d}", 0.5 * i, 7.25) for i in range(30)], "label string, a double, b double")
    middles = [(i, 0.5 * i + 0.25, 950.1 + i) for i in range(29)]
    got = {r.g: r.label for r in taxonomy.assign_noise(spark.createDataFrame(middles, "g long, a double, b double"), classes, "g", "label", ["a", "b"], 1).collect()}
    assert got == {i: f"c{i + 1:02d}" for i in range(29)}
