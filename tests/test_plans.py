"""The entity characters and the taxonomy over a small made-up town."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphloom.operators import context, graph
from morphloom.plans import characters, taxonomy

RING = "array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


@pytest.fixture(scope="module")
def town(spark):
    """A row of ten square cells with a building each, in two enclosures; three streets meet."""
    cells = [(i, box(10.0 * i, 0.0, 10.0, 10.0), i // 5) for i in range(10)]
    buildings = [(i, box(10.0 * i + 2, 2.0, 4.0 + i % 2, 5.0), None) for i in range(9)] + [(9, box(92.0, 2.0, 6.0, 6.0), [box(93.0, 3.0, 2.0, 2.0)])]
    streets = [(0, [(0.0, 12.0), (50.0, 12.0)]), (1, [(50.0, 12.0), (100.0, 12.0)]), (2, [(50.0, 12.0), (50.0, 40.0)])]
    edges = [(i, j, 1.0) for i in range(10) for j in (i - 1, i + 1) if 0 <= j < 10]
    return {
        "cells": spark.createDataFrame(cells, f"id long, ring {RING}, eID long"),
        "buildings": spark.createDataFrame(buildings, f"id long, ring {RING}, holes array<{RING}>"),
        "enclosures": spark.createDataFrame([(0, box(0.0, 0.0, 50.0, 10.0)), (1, box(50.0, 0.0, 50.0, 10.0))], f"eID long, ring {RING}"),
        "streets": spark.createDataFrame(streets, f"nID long, line {RING}"),
        "edges": spark.createDataFrame(edges, "focal long, neighbor long, weight double"),
    }


def test_primary_characters(spark, town):
    b = characters.building_chars(town["buildings"])
    got = {r.id: r for r in b.collect()}
    assert got[0].sdbAre == 20.0 and got[0].sdbPer == 18.0 and got[0].ssbCor == 4 and got[0].ssbSqu < 1e-9 and math.isclose(got[0].ssbERI, 1.0)
    assert math.isclose(got[0].ssbCCM, math.hypot(2, 2.5)) and got[0].ssbCCD < 1e-6
    assert got[9].sdbCoA == 4.0 and got[9].sdbAre == 32.0
    c = characters.cell_chars(town["cells"], town["edges"], b)
    cell = {r.id: r for r in c.collect()}
    assert cell[0].mdcAre == 200.0 and cell[5].mdcAre == 300.0 and cell[0].sicCAR == 0.2 and math.isclose(cell[0].mtcWNe, 1 / 40)
    assert math.isclose(cell[0].ltcWRB, 1 / 400) and math.isclose(cell[4].ltcWRB, 2 / 700)
    assert math.isclose(cell[0].micBAD, np.std([20, 25], ddof=1))
    e = characters.enclosure_chars(town["enclosures"], town["cells"], b, spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "focal long, neighbor long, weight double"))
    enclosure = {r.eID: r for r in e.collect()}
    assert enclosure[0].likWCe == 5 / 500 and enclosure[0].likWBB == 110 / 500 and enclosure[0].ltkWNB == 1 / 120
    attached = town["cells"].select((F.col("id") / 5).cast("long").alias("nID"), F.lit(100.0).alias("cell_area"), F.lit(20.0).alias("building_area"))
    star = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3) if i != j], "focal long, neighbor long, weight double")
    s = characters.street_chars(town["streets"], star, attached)
    street = {r.nID: r for r in s.collect()}
    assert street[0].sdsLen == 50.0 and street[0].sdsAre == 500.0 and street[0].sisBpM == 0.1 and street[2].ldsRea == 10 and street[2].sisBpM is None
    n = characters.node_chars(town["streets"])
    assert sorted(r.mtdDeg for r in n.collect()) == [1, 1, 1, 3]
    joined = characters.structure_chars(town["buildings"], spark.createDataFrame([(0, 1), (1, 0)], "focal long, neighbor long"))
    row = {r.id: r for r in joined.collect()}
    assert row[1].mibCou == 2 and row[1].libNCo == 0 and row[9].libNCo == 1 and math.isclose(row[1].mibAre, 45 + 0.1 * 38 + 2 * math.pi * 0.01, rel_tol=1e-4)
    assert row[2].mibFR == row[2].mibSCo and math.isclose(row[2].mibFR, (20 + 1.8 + math.pi / 100) / (18 + math.pi / 5), rel_tol=1e-4)
    around = {r.id: r.ltcBuA for r in characters.building_context(b, town["edges"], joined).collect()}
    assert math.isclose(around[0], 1 / 2) and math.isclose(around[2], 3 / 3)
    wide = characters.primary(c.withColumns({"nID": F.lit(0).cast("long"), "node": F.lit("50.0 12.0")}), b, e, s, n)
    assert wide.count() == 10 and {"ssbERI", "ldkAre", "sdsLen", "mtdDeg"} <= set(wide.columns)


def test_context_over_neighbourhoods(spark, town):
    values = spark.createDataFrame([(i, float(i * i), 10.0 * i, 0.0) for i in range(10)], "id long, v double, x double, y double")
    loops = graph.with_self(town["edges"], values, "id")
    got = {r.focal: r for r in context.percentile_context(loops, 3, values, "id", ["v"]).collect()}
    for i in range(10):
        near = [j * j for j in range(10) if abs(i - j) <= 3]
        assert np.allclose([got[i]["v__5"], got[i]["v__50"], got[i]["v__95"]], np.percentile(near, [5, 50, 95]))
    one = {r.focal: r for r in context.weighted_context(loops, 1, values, "id", ["v"], "inverse").collect()}
    assert one[0].median == 1.0 and one[0].iqr == 0.0 and one[5].median == (16 + 36) / 2
    gaps = spark.createDataFrame([(i, i + 1, 10.0 + i) for i in range(9)], "focal long, neighbor long, distance double")
    mean = {r.focal: r.mean for r in context.mean_pair_distance(loops, gaps, 1).collect()}
    assert mean[0] == 10.0 and mean[3] == 12.5
    for kernel in ("gaussian", "other"):
        assert context.weighted_context(loops, 2, values, "id", ["v"], kernel, 0).count() == 10


def test_taxonomy_of_two_kinds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "r", float(rng.normal(0 if i < 30 else 9, 0.3)), float(rng.normal(0 if i < 30 else 9, 0.3))) for i in range(60)] + [(-1, "r", 0.0, 0.0), (100, "r", 0.1, 0.1)]
    cells = spark.createDataFrame(rows, "id long, region string, a double, b double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "focal long, neighbor long, weight double")
    labels = taxonomy.delineate(cells, edges, "id", ["a", "b"], "region", min_size=10)
    got = {r.id: r.label for r in labels.collect()}
    assert len(got) == 61 and len({got[i] for i in range(30)}) == 1 and len({got[i] for i in range(60)}) == 2 and got[100].endswith("-1")
    stats = taxonomy.group_stats(cells, labels, "id", ["a", "b"])
    assert sorted(r["size"] for r in stats.collect()) == [30, 30]
    merges, levels = taxonomy.taxonomy(stats.select("label", F.col("a__median").alias("a"), F.col("b__median").alias("b")), "label", ["a", "b"], [0.5, 100.0])
    assert merges.count() == 1 and sorted((r.level_1, r.level_2) for r in levels.collect()) == [(0, 0), (0, 1)]
    classes = stats.select("label", F.col("a__median").alias("a"), F.col("b__median").alias("b"))
    voted = taxonomy.assign_noise(spark.createDataFrame([(7, 0.1, 0.2), (8, 9.0, 8.8)], "g long, a double, b double"), classes, "g", "label", ["a", "b"], 1)
    assert {r.g: r.label for r in voted.collect()} == {7: got[0], 8: got[40]}
    named = taxonomy.unique_noise_labels(cells.where("id >= 50 OR id = 0"), edges.where("focal >= 50 AND neighbor >= 50"), "id", "region")
    assert len({r.label for r in named.collect()}) == 3
    settled = taxonomy.settle_structures(spark.createDataFrame([(1, "a_1"), (2, "a_-1"), (3, "a_-1"), (4, "a_-1")], "id long, label string"), spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, component long"), "id")
    assert {r.id: r.label for r in settled.collect()} == {1: "a_1", 2: "a_1", 3: "a_1", 4: "a_-1"}
    b = spark.createDataFrame([(i, 10.0 * i, 0.0, 100.0 + i, 40.0, 12.0, 5.0, 0.5, 0) for i in range(12)], "id long, x double, y double, sdbAre double, sdbPer double, sdbLAL double, mibFR double, ssbElo double, libNCo int")
    one = b.select("id", F.lit("g").alias("label"))
    row = taxonomy.group_chars(b, one).first()
    assert row.limMTC == 1.0 and row.limLPS and row.limAre == sum(100.0 + i for i in range(2, 12)) and row.limPer == 400.0
    assert taxonomy.spacing(b, one, 15.0).first().limSDi == 0.0
