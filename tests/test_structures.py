"""Joined structures: closed forms of upright buildings against the overlay, which is left for all others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphloom.functions import overlay as O
from morphloom.functions import polygons as K
from morphloom.functions import upright as U
from morphloom.operators import polygons as P
from morphloom.plans import characters as C

NONE = np.full((1, 2), np.nan)


def ring(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def closed(r):
    return [(float(x), float(y)) for x, y in np.concatenate([r, r[:1]])]


def told(a, b, hole, r):
    return [v[0] for v in U.measures(a, b, hole, r, 16)] + [U.radii(a, b, r, 16)[0]]


def test_two_grown_boxes_have_the_measures_of_their_union():
    """each pair of houses was united and grown by the overlay, some milliseconds each."""
    rng, steps = np.random.default_rng(5), set()
    for _ in range(160):
        low, size = rng.integers(0, 8, (2, 2)), rng.integers(1, 9, (2, 2))
        both = np.concatenate([low, low + size], 1) * rng.choice([0.5, 1.0]) + rng.choice([0.0, 4321.25])
        a, b = both[:1], both[1:]
        if U.holds(a, b, NONE, 0.25)[0]:
            (part,) = O.buffer(O.union([[ring(*a[0])], [ring(*b[0])]]), 0.1, 16)
            m = K.measures(part)
            assert told(a, b, NONE, 0.1) == pytest.approx([*m[:6], m[9]], abs=1e-6)
            steps.add(int(U.concave(a, b)[0]))
    assert steps == {0, 1, 2, 4}


def test_a_grown_box_with_a_courtyard_has_the_measures_of_the_overlay():
    a, hole = np.array([[3.0, 2.0, 11.0, 7.0]]), np.array([[1.0, 2.0]])
    (part,) = O.buffer([[ring(*a[0]), ring(5, 3, 6, 5)[::-1]]], 0.25, 16)
    m = K.measures(part)
    assert U.holds(a, a, hole, 0.25)[0] and told(a, a, hole, 0.25) == pytest.approx([*m[:6], m[9]], abs=1e-9)


def test_no_closed_form_where_growth_changes_the_outline():
    box = lambda *v: np.array([v], float)
    a = box(0, 0, 4, 4)
    for b in (box(4, 4, 8, 8), box(4.4, 0, 8, 4), box(4, 0.2, 8, 4), box(4, 0, 8, np.inf), box(np.nan, 0, 8, 4), box(4, 0, 4, 4)):
        assert not U.holds(a, b, NONE, 0.25)[0]
    assert not U.holds(a, a, np.array([[0.5, 3.0]]), 0.25)[0] and not U.holds(a, box(4, 0, 8, 4), np.array([[1.0, 1.0]]), 0.25)[0]


TOWN = [
    (0, ring(0, 0, 10, 6), []), (1, ring(10, 0, 20, 9), []),  # share a wall
    (2, ring(40, 0, 48, 8), [ring(42, 2, 43, 3)]),  # a courtyard
    (3, ring(60, 0, 66, 5), []), (4, ring(66.3, 0, 72, 5), []),  # a gap
    (5, ring(80, 0, 84, 5), []), (6, ring(84, 0, 88, 6), []), (7, ring(88, 0, 92, 4), []),  # three
    (8, np.array([(100, 0), (106, 1), (105, 6), (99, 5)], float), []),  # turned
    (9, ring(120, 0, 140, 20), [ring(124, 4, 136, 16)]), (10, ring(124.2, 8, 130, 12), []), (11, ring(131, 8, 134, 12), []),  # in a courtyard, near and far
    (12, ring(150, 0, 155, 5), []), (13, np.array([(155.2, 1), (160, 1), (160, 4), (156, 5)], float), []),  # one of two upright
]


def town(spark):
    rows = [(i, closed(o), [closed(h) for h in holes] or None) for i, o, holes in TOWN]
    return spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")


def test_near_pairs_are_those_of_all_pairs(spark):
    got = {(r.focal, r.neighbor): r.distance for r in P.near_pairs(C.with_rings(town(spark)), "id", 0.5, 20.0).collect()}
    gap = {(i, j): K.polygon_gap([a, *x], [b, *y]) for i, a, x in TOWN for j, b, y in TOWN if i < j}
    assert got == pytest.approx({k: v for k, v in gap.items() if v <= 0.5}) and (9, 10) in got and (12, 13) in got


def test_structures_are_those_of_the_overlay(spark, monkeypatch):
    """All kinds at once: with the closed forms, and with the overlay for all."""
    b = town(spark)
    touching = P.fuzzy_contiguity(C.with_rings(b), "id", 0.25, 20.0)
    fast = {r.id: r.asDict() for r in C.structure_chars(b, touching).collect()}
    some = P.upright_structures

    def none(buildings, components, key, component, rings, *args):
        known, _ = some(buildings, components, key, component, rings, *args)
        left = buildings.select(key, rings).join(components, key, "left").withColumn(component, F.coalesce(component, key))
        return known.limit(0), left

    monkeypatch.setattr(P, "upright_structures", none)
    slow = {r.id: r.asDict() for r in C.structure_chars(b, touching).collect()}
    assert sorted(fast) == sorted(slow) == list(range(14))
    for i, row in slow.items():
        assert fast[i] == pytest.approx(row, abs=1e-5)
    assert [fast[i]["mibCou"] for i in (0, 2, 3, 5, 9, 11)] == [2, 1, 2, 3, 2, 1]


def test_upright_buildings_are_not_united(spark, monkeypatch):
    """single buildings and pairs all went through unions, group by group."""

    def refuse(*args, **kwargs):
        raise AssertionError("a union was made")

    b = town(spark).where("id < 3")
    touching = P.fuzzy_contiguity(C.with_rings(b), "id", 0.25, 20.0)
    monkeypatch.setattr(P, "dissolve", refuse)
    got = C.structure_chars(b, touching).select("id", "component", "mibCou", "libNCo").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2, 0), (1, 0, 2, 0), (2, 2, 1, 1)]


def test_characters_of_groups_are_made_once(spark):
    """each of six steps made all characters again, Python included."""
    from morphloom.plans import taxonomy as X

    slow = F.udf(lambda v: float(v), "double")
    made = spark.range(40).select("id", *(slow(F.col("id") % 7 + 1).alias(c) for c in ("mibFR", "sdbAre", "sdbPer", "sdbLAL")), (F.col("id") % 3 / 3).alias("ssbElo"), F.lit(0).alias("libNCo"))
    out = X.group_chars(made, spark.range(40).select("id", (F.col("id") % 2).cast("string").alias("label")))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.label: r for r in out.collect()}
    assert sorted(rows) == ["0", "1"] and rows["0"].limAre == sum(sorted((i % 7 + 1 for i in range(0, 40, 2)), reverse=True)[:10])
