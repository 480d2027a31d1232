"""Evaluation loops and file formats: small cases with known answers."""

import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphloom.operators import aggregates as A
from morphloom.operators import cluster as C
from morphloom.operators import evaluate as E
from morphloom.operators import learn
from morphloom.operators.quantiles import exact_percentiles
from morphloom.sources import formats, readers, sinks
from morphloom.storage import fresh_path
from morphloom.streaming import landing


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(6 * (i % 3), 0.4, 3)), i % 3) for i in range(90)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, truth int").repartition(4)


def test_percentiles_without_one_reducer(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500).round(1), [3.0] * 400])
    rows = [(float(v),) for v in x] + [(None,), (float("nan"),)] * 5
    df = spark.createDataFrame(rows, "v double").repartition(7)
    at = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(exact_percentiles(df, "v", at), np.percentile(x, [100 * p for p in at]))
    assert exact_percentiles(df.where("v IS NULL"), "v", [0.5]) is None
    weighted = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 1.0), ("g", float("nan"), 9.0), ("g", 3.0, None)], "k string, v double, w double")
    assert A.weighted_percentiles(weighted, ["k"], "v", "w").first().p75 == 2.0


def test_power_transform_straightens(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=400))], "v double")
    before, after = (t.agg(F.skewness("v")).first()[0] for t in (df, A.power_scale(df, ["v"])))
    assert before > 2 and abs(after) < 0.4


def grouping(blobs, k=3, columns=("a", "b", "c")):
    centres = [[6.0 * i] * len(columns) for i in range(k)]
    return learn.lloyd(blobs, list(columns), centres, 5)


def test_searches_over_configurations(spark, blobs):
    got = E.grid_search([{"k": 2}, {"k": 3}], lambda k: grouping(blobs, k), blobs, "id", "truth").collect()
    score = {json.loads(r.configuration)["k"]: r.ari for r in got}
    assert score[3] == 1.0 and score[2] < 0.8
    out = E.without_each(blobs, ["a", "b", "c"], lambda cs: grouping(blobs, 3, cs), "id").collect()
    assert {r.left_out for r in out} == {"a", "b", "c"} and all(r.ari > 0.9 for r in out)
    two = E.kmeans_then_ward(blobs, "id", ["a", "b", "c"], [[float(v)] * 3 for v in (-0.5, 0.5, 6, 12)], 4.0)
    joined = two.join(blobs.select("id", "truth"), "id")
    assert C.adjusted_rand(joined, "truth", "cluster").first().ari == 1.0
    parts = E.halved(blobs, "id", ["a", "b", "c"], 2).join(blobs.select("id", "truth"), "id")
    assert parts.groupBy("cluster").agg(F.countDistinct("truth").alias("n")).agg(F.max("n")).first()[0] == 1


def test_parts_of_bounded_weight(spark):
    side = 8
    edges = [(i, j) for i in range(side * side) for j in (i - 1, i + 1, i - side, i + side) if 0 <= j < side * side and (abs(i - j) == side or i // side == j // side)]
    weights = spark.createDataFrame([(i, 1.0 + (i == 5) * 20) for i in range(side * side)], "id long, weight double")
    parts = E.capacity_parts(spark.createDataFrame(edges, "focal long, neighbor long"), weights, "id", 10.0)
    own = {r.id: r.part for r in parts.collect()}
    sizes = {p: [i for i in own if own[i] == p] for p in set(own.values())}
    assert sizes[own[5]] == [5] and all(len(v) <= 10 for v in sizes.values()) and len(sizes) <= 20
    near = {frozenset(e) for e in edges}
    for members in sizes.values():
        seen, todo = set(), [members[0]]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [u for u in members if frozenset((u, v)) in near]
        assert seen == set(members)


def test_moran_with_permutations(spark):
    n = 40
    values = spark.createDataFrame([(i, float(i < 20)) for i in range(n)], "id long, v double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(i - 3, i + 4) if 0 <= j < n and i != j], "focal long, neighbor long, weight double")
    got = {r.focal: r for r in E.moran_significance(edges, values, "id", "v", 199).collect()}
    assert len(got) == n and got[2].moran > 0.9 and got[5].p < 0.06 and got[19].p > 0.1


def test_kernels_on_trees_and_samples():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 3, (20, 2))])
    assert set(E.smallest_core(x, 30)) <= set(range(60)) and np.isin(E.smallest_core(x, 30), np.arange(40)).mean() > 0.9
    z = C.ward_tree(np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(9, 0.1, (20, 2))]))
    assert E.inconsistency(z).argmax() == len(z) - 1
    tight = E.tightened(np.concatenate([rng.normal(0, 0.1, (30, 2)), [[5.0, 5.0]]]), np.zeros(31, int))
    assert tight[30] == -1 and (tight[:30] == 0).mean() > 0.8
    h = E.bandwidth(rng.normal(size=4000))
    assert 0.12 < h < 0.26  # a normal sample's best is near 1.06 n ** -0.2 = 0.2


def test_boundary_points(spark):
    ring = lambda s: [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s), (0.0, 0.0)]
    kind = "id long, ring array<struct<x:double,y:double>>"
    reference = spark.createDataFrame([(1, ring(100.0)), (2, [(9000.0, 0.0), (9010.0, 0.0), (9010.0, 10.0), (9000.0, 0.0)])], kind)
    got = {r.id: r for r in E.boundary_distances(reference, spark.createDataFrame([(7, ring(110.0))], kind), "id").collect()}
    assert got[1].n == 40 and got[1].missed == 0 and 0 < got[1].mean < 10 and got[2].missed == got[2].n


def wkb(kind, *rings, order="<"):
    head = struct.pack(order + "BI", order == "<", kind)
    if kind == 3:
        return head + struct.pack(order + "I", len(rings)) + b"".join(struct.pack(order + "I", len(r)) + struct.pack(f"{order}{2 * len(r)}d", *(v for p in r for v in p)) for r in rings)
    return head + struct.pack(order + "I", len(rings)) + b"".join(rings)


SQUARE = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
HOLE = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]


def test_wkb_and_geoparquet(spark):
    one, two = wkb(3, SQUARE, HOLE), wkb(6, wkb(3, SQUARE), wkb(3, HOLE, order=">"))
    assert [k for k, _ in formats.wkb_parts(two)] == ["Polygon", "Polygon"] and len(formats.wkb_parts(one)[0][1]) == 2
    point = struct.pack("<BIIddd", 1, 1 | 0x20000000 | 0x80000000, 3035, 1.0, 2.0, 3.0)
    assert formats.wkb_parts(point) == [("Point", [[{"x": 1.0, "y": 2.0}]])]
    path = fresh_path(spark, "geo")
    spark.createDataFrame([(1, one), (2, two), (3, None)], "id long, geometry binary").write.parquet(path)
    got = formats.read_geoparquet(spark, path).collect()
    assert sorted((r.id, r.part, len(r.rings)) for r in got) == [(1, 0, 2), (2, 0, 1), (2, 1, 1)]


def test_geopackage(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT); CREATE TABLE houses (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT); INSERT INTO gpkg_contents VALUES ('houses', 'features'), ('notes', 'attributes'); INSERT INTO gpkg_geometry_columns VALUES ('houses', 'geom');")
    header = b"GP\0\x03" + struct.pack("<i", 3035) + struct.pack("<4d", 0, 2, 0, 2)
    con.executemany("INSERT INTO houses (geom, name) VALUES (?, ?)", [(header + wkb(3, SQUARE), "one"), (None, "none"), (b"GP\0\x01" + struct.pack("<i", 0) + wkb(6, wkb(3, SQUARE), wkb(3, HOLE)), "two")])
    con.commit()
    con.close()
    at = f"file://{tmp_path}/a.gpkg"
    assert [(r.layer, r.n) for r in formats.list_layers(spark, at).collect()] == [("houses", 3)]
    got = formats.read_geopackage(spark, at, "houses").collect()
    assert [(json.loads(r.attributes)["name"], r.part, r.kind) for r in got] == [("one", 0, "Polygon"), ("none", 0, None), ("two", 0, "Polygon"), ("two", 1, "Polygon")]
    with pytest.raises(Exception, match="no feature layer"):
        formats.read_geopackage(spark, at, "streets").collect()


def test_shapefile(spark, tmp_path):
    def polygon(*rings):
        flat = [p for r in rings for p in r]
        starts = np.cumsum([0, *(len(r) for r in rings)])[:-1]
        return struct.pack("<i4d2i", 5, 0, 0, 2, 2, len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)

    records = [polygon(SQUARE, HOLE), polygon(SQUARE, SQUARE), struct.pack("<i2d", 1, 5.0, 6.0), struct.pack("<i", 0)]
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    fields = b"".join(name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for name, kind, width in ((b"name", b"C", 6), (b"floors", b"N", 3)))
    rows = b"".join(b" " + n.ljust(6) + f.rjust(3) for n, f in ((b"one", b"2"), (b"two", b"1.5"), (b"three", b""), (b"", b"4")))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4B IHH", 3, 1, 1, 1, 4, 32 + len(fields) + 1, 10) + b"\0" * 20 + fields + b"\r" + rows)
    got = formats.read_shapefile(spark, f"file://{tmp_path}").orderBy("feature", "part").collect()
    assert [(r.feature, r.part, r.kind, len(r.rings or [])) for r in got] == [(0, 0, "Polygon", 2), (1, 0, "Polygon", 1), (1, 1, "Polygon", 1), (2, 0, "Point", 1), (3, 0, None, 0)]
    assert json.loads(got[0].attributes) == {"name": "one", "floors": 2} and json.loads(got[3].attributes) == {"name": "three", "floors": None}


def test_sheet_feed_and_download(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>code</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert [json.loads(r.cells) for r in formats.read_sheet(spark, f"file://{tmp_path}/a.xlsx").collect()] == [{"code": "7", "None": None, "name": "x"}]
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="h"/></entry><entry/></feed>')
    assert [tuple(r) for r in formats.read_feed(spark, f"file://{tmp_path}/feed.xml").collect()] == [("t", "h"), (None, None)]
    assert formats.download(f"file://{tmp_path}/feed.xml", str(tmp_path / "copy.xml")) == (tmp_path / "copy.xml").stat().st_size
    with pytest.raises(OSError):
        formats.download(f"file://{tmp_path}/none", str(tmp_path / "x"), tries=2, wait=0.01)


def test_small_artefacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "region_id long, name string, x__median double")
    sinks.write_json_map(df, f"file://{tmp_path}/map", "region_id", "name")
    assert spark.read.text(f"file://{tmp_path}/map").first().value == '{"1":"a"}'
    df.write.parquet(f"file://{tmp_path}/cells_17.parquet")
    assert readers.read_regions(spark, f"file://{tmp_path}/cells_*.parquet", r"cells_(\w+)\.parquet").first().region_id == "17"
    stream = landing.read_landing(spark, f"file://{tmp_path}/cells_*", "region_id long, name string, x__median double")
    timed = stream.withColumn("at", F.timestamp_seconds("region_id"))
    assert {"window", "name", "n"} == set(landing.windowed_counts(timed, "at", "name").columns)


def test_scalers_sizes_and_regional_trees(spark, blobs):
    scores = E.compare_scalers(blobs, "truth", ["a", "b", "c"], {"all": ["a", "b", "c"], "two": ["a", "b"]}).collect()
    assert len(scores) == 6 and all(0 < r.davies_bouldin < 1 for r in scores)
    rows = E.inertia_by_size([2, 3], lambda k: grouping(blobs, k), blobs, "id", ["a", "b", "c"]).collect()
    assert rows[0].inertia > rows[1].inertia and rows[1].clusters == 3 and rows[0].noise == 0.0
    names, z = E.profile_tree(blobs.groupBy("truth").agg(F.avg("a").alias("a"), F.avg("b").alias("b")), "truth", ["a", "b"])
    assert names == ["0", "1", "2"] and len(z) == 2
    cells = blobs.withColumn("region", F.when(F.col("id") < 45, "west").otherwise("east"))
    groups, merges = E.regional_tree(cells, "id", "region", ["a", "b", "c"], 3.0)
    told = groups.join(cells, "id").groupBy("group").agg(F.countDistinct("region").alias("r"), F.countDistinct("truth").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert len(told) == 6 and all((r.r, r.t, r.n) == (1, 1, 15) for r in told) and merges.count() == 5
