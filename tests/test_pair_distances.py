"""The median of all pair distances, a range at a time."""

import itertools
import math
import statistics

import numpy as np

from morphloom.operators import evaluate


def test_median_of_pairs_narrows_its_range(spark, monkeypatch):
    """every pair's distance went to the median's one group, and a block pair took 2 GB."""
    monkeypatch.setattr(evaluate, "FEW", 3)
    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=(90, 5)), 1: np.repeat(rng.normal(size=(3, 5)), 7, axis=0), 2: 1e6 + rng.normal(size=(40, 5)), 3: rng.normal(size=(1, 5)), 4: np.array([[0.0] * 5, [1.0] + [0.0] * 4, [3.0] + [0.0] * 4, [3.0] + [0.0] * 4])}
    rows = [(g, 1000 * g + i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>")
    got = {r.label: r.median for r in evaluate.median_pair_distance(df, "label", "id", "v", block=16).collect()}
    want = {g: statistics.median(math.dist(a, b) for a, b in itertools.combinations(x.tolist(), 2)) for g, x in groups.items() if len(x) > 1}
    assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], rel_tol=1e-9, abs_tol=1e-12) for g in want)
