"""Catalogue: the entity characters over a town laid out from the parts, with closed forms as SQL.

Part n (its key and one) stands in slot i of a block of ten, blocks in rows of sixteen. A cell is 10 by 20; a
building is full width for two of four neighbouring parts, which then share a wall, and has a
courtyard of 1 by 1 for one of eight. Streets run below and beside each block, in a grid.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.operators import graph, network
from morphloom.operators import polygons as P
from morphloom.plans import characters as C
from morphloom.plans import taxonomy as X
from morphloom.storage import materialize
from morphloom.storage import table as T

QUERIES, SQL = {}, {}

#: One row a part: block, slot, corner of the block and of the building, its sides, hole or not.
TOWN = """k0 AS (SELECT p_partkey + 1 AS n, p_size FROM part),
    t AS (SELECT n, (n - 1) // 10 AS b, (n - 1) % 10 AS i, n % 4 IN (1, 2) AS full_, n % 8 = 7 AS hole, CASE WHEN n % 4 IN (1, 2) THEN 10.0 ELSE 3.0 + p_size % 5 END AS w, 4.0 + n % 7 AS h FROM k0),
    g AS (SELECT *, (b % 16) * 110.0 AS bx, (b // 16) * 40.0 AS by_, w * h - CASE WHEN hole THEN 1 ELSE 0 END AS a, 2 * (w + h) AS p FROM t)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def layout(spark, d) -> DataFrame:
    k = F.col("p_partkey") + 1
    block, slot = F.floor((k - 1) / 10).cast("bigint"), ((k - 1) % 10).cast("bigint")
    wide = F.when((k % 4).isin(1, 2), 10.0).otherwise(3.0 + F.col("p_size") % 5)
    t = T(spark, d, "part").select(k.cast("bigint").alias("id"), block.alias("eID"), slot.alias("i"), wide.alias("w"), (4.0 + k % 7).alias("h"), (k % 8 == 7).alias("hole"), (k % 4).isin(1, 2).alias("full"))
    return t.withColumns({"bx": F.col("eID") % 16 * 110.0, "by": F.floor(F.col("eID") / 16) * 40.0})


def buildings(spark, d) -> DataFrame:
    x, y = F.col("bx") + 10 * F.col("i") + F.when(F.col("full"), 0.0).otherwise(1.0), F.col("by") + 2.0
    hole = F.array(G.rectangle(x + 1, y + 1, F.lit(1.0), F.lit(1.0)))
    return layout(spark, d).select("id", "eID", G.rectangle(x, y, F.col("w"), F.col("h")).alias("ring"), F.when(F.col("hole"), hole).alias("holes"))


def cells(spark, d) -> DataFrame:
    return layout(spark, d).select("id", "eID", G.rectangle(F.col("bx") + 10 * F.col("i"), F.col("by"), F.lit(10.0), F.lit(20.0)).alias("ring"))


def blocks(spark, d) -> DataFrame:
    return layout(spark, d).select("eID", "bx", "by").distinct()


def enclosures(spark, d) -> DataFrame:
    return blocks(spark, d).select("eID", G.rectangle(F.col("bx"), F.col("by"), F.lit(110.0), F.lit(20.0)).alias("ring"))


def streets(spark, d) -> DataFrame:
    b = blocks(spark, d)
    x, y = F.col("bx") - 4.0, F.col("by") - 5.0
    below = b.select((2 * F.col("eID")).alias("nID"), F.array(G.point(x, y), G.point(x + 110.0, y)).alias("line"))
    return below.unionByName(b.select((2 * F.col("eID") + 1).alias("nID"), F.array(G.point(x, y), G.point(x, y + 40.0)).alias("line")))


def ringed(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", F.array("ring"))


def cell_edges(spark, d) -> DataFrame:
    return materialize(P.queen_contiguity(ringed(cells(spark, d)), "id"), "cell_edges")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {TOWN} SELECT n AS id, a AS "sdbAre", p AS "sdbPer", CASE WHEN hole THEN 1.0 ELSE 0.0 END AS "sdbCoA", round(a / (pi() * (w * w + h * h) / 4), 6) AS "ssbCCo", 4 AS "ssbCor", 0.0 AS "ssbSqu",
    round(sqrt(a / (w * h)), 6) AS "ssbERI", round(least(w, h) / greatest(w, h), 6) AS "ssbElo", 0.0 AS "stbOri", round(sqrt(w * w + h * h), 6) AS "sdbLAL", round(sqrt(w * w + h * h) / 2, 6) AS "ssbCCM", 0.0 AS "ssbCCD" FROM g""")
def town_building_chars(spark, d):
    return rounded(C.building_chars(buildings(spark, d)))


_ARC = {"0.1": "(0.1 * 32 * sin(pi() / 64))", "0.25": "(0.25 * 32 * sin(pi() / 64))"}
#: Two buildings that share a wall: sums, the outline, and whether it has a step (5 convex corners, 1 concave).
PAIRS = f"""{TOWN}, j AS (SELECT g.*, coalesce(q.h, g.h) AS h2, q.n IS NOT NULL AS two, coalesce(q.a, 0) AS a2, least(g.n, coalesce(q.n, g.n)) AS component FROM g
        LEFT JOIN g q ON g.full_ AND q.full_ AND q.b = g.b AND q.n = CASE WHEN g.n % 4 = 1 THEN g.n + 1 ELSE g.n - 1 END),
    u AS (SELECT *, a + a2 AS area, CASE WHEN two THEN 40 + 2 * greatest(h, h2) ELSE p END AS rim, CASE WHEN two THEN 20.0 ELSE w END AS uw, greatest(h, h2) AS uh, CASE WHEN two AND h <> h2 THEN 1 ELSE 0 END AS step FROM j)"""


def _grown(r: str) -> str:
    """Area and rims of the outline grown by r: arcs of 64 steps a turn at convex corners, none at a concave one."""
    return f"area + rim * {r} + (4 + step) * 16 * {r} * {r} * sin(pi() / 32) / 2 - step * {r} * {r}"


@query(f"""WITH {PAIRS}, s AS (SELECT *, {_grown("0.1")} + CASE WHEN hole THEN 4 * 0.1 - 4 * 0.01 ELSE 0 END AS ga, rim + (4 + step) * {_ARC["0.1"]} - 2 * step * 0.1 AS outer_, CASE WHEN hole THEN 4 * 0.8 ELSE 0 END AS inner_ FROM u)
    SELECT n AS id, component, CASE WHEN two THEN 2 ELSE 1 END AS "mibCou", round(outer_ + inner_, 4) AS "mibLen", round(ga, 4) AS "mibAre", round((least(uw, uh) + 0.2) / (greatest(uw, uh) + 0.2), 4) AS "mibElo",
        round(sqrt(ga / ((uw + 0.2) * (uh + 0.2))) * 2 * (uw + uh + 0.4) / (outer_ + inner_), 4) AS "mibERI", round(ga / (outer_ + inner_), 4) AS "mibFR", round(ga / (outer_ + inner_), 4) AS "mibSCo",
        CASE WHEN hole THEN 1 ELSE 0 END AS "libNCo", round(rim + (4 + step) * {_ARC["0.25"]} - 2 * step * 0.25, 4) AS "ldbPWL" FROM s""")
def town_structures(spark, d):
    b = buildings(spark, d)
    touching = P.fuzzy_contiguity(C.with_rings(b), "id", 0.25, 20.0)
    return rounded(C.structure_chars(b, touching), 4).drop("mibCCo", "mibLAL")


@query(f"""WITH {PAIRS} SELECT n AS id, round(CASE WHEN two THEN least(h, h2) / (p + CASE WHEN hole THEN 4 ELSE 0 END) ELSE 0 END, 6) AS "mtbSWR" FROM u""")
def town_shared_walls(spark, d):
    return rounded(C.wall_chars(buildings(spark, d), 20.0))


#: Gaps between buildings of neighbouring slots: from right edge to left edge.
GAPS = f"""{TOWN}, e AS (SELECT l.n AS n1, r.n AS n2, l.b, l.i, (CASE WHEN r.full_ THEN 10.0 ELSE 11.0 END) - (CASE WHEN l.full_ THEN 0.0 ELSE 1.0 END) - l.w AS gap FROM g l JOIN g r ON l.b = r.b AND r.i = l.i + 1)"""


@query(f"""WITH {GAPS}, m AS (SELECT n, avg(gap) AS nd FROM (SELECT n1 AS n, gap FROM e UNION ALL SELECT n2, gap FROM e) x GROUP BY n)
    SELECT g.n AS id, round(m.nd, 6) AS "mtbNDi", round((SELECT avg(gap) FROM e WHERE e.b = g.b AND e.i >= g.i - 3 AND e.i + 1 <= g.i + 3), 6) AS "ltbIBD" FROM g LEFT JOIN m ON g.n = m.n""")
def town_building_distances(spark, d):
    return rounded(C.distance_context(buildings(spark, d), cell_edges(spark, d)))


@query(f"""WITH {PAIRS}, r AS (SELECT x.n, count(DISTINCT y.component) * 1.0 / count(*) AS s FROM u x JOIN u y ON x.b = y.b AND abs(x.i - y.i) <= 1 GROUP BY 1),
    k AS (SELECT x.n, avg(0.0) AS ali FROM u x JOIN u y ON x.b = y.b AND abs(x.i - y.i) = 1 GROUP BY 1) SELECT r.n AS id, round(s, 6) AS "ltcBuA", ali AS "mtbAli" FROM r LEFT JOIN k ON r.n = k.n""")
def town_building_context(spark, d):
    b = buildings(spark, d)
    touching = P.fuzzy_contiguity(C.with_rings(b), "id", 0.25, 20.0)
    comps = graph_components(touching, b)
    return rounded(C.building_context(C.building_chars(b), cell_edges(spark, d), comps))


def graph_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    from morphloom.operators.components import connected_components

    comps = connected_components(edges.select("focal", "neighbor"), "focal", "neighbor").withColumnRenamed("node", "id")
    return nodes.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"""WITH {TOWN}, n1 AS (SELECT x.n, count(*) - 1 AS k, stddev_samp(y.a) AS s FROM g x JOIN g y ON x.b = y.b AND abs(x.i - y.i) <= 1 GROUP BY 1), n3 AS (SELECT x.n, count(*) AS k, stddev_samp(y.a) AS s FROM g x JOIN g y ON x.b = y.b AND abs(x.i - y.i) <= 3 GROUP BY 1)
    SELECT g.n AS id, b AS "eID", 200.0 AS "sdcAre", 0.0 AS "stcOri", round(sqrt(500.0), 6) AS "sdcLAL", round(200 / (pi() * 125), 6) AS "sscCCo", 1.0 AS "sscERI", (n1.k + 1) * 200.0 AS "mdcAre", round(1 / (n3.k * 200.0), 9) AS "ltcWRB",
        round(coalesce(n1.s, 0), 6) AS "micBAD", round(coalesce(n3.s, 0), 6) AS "licBAD", round(n1.k / 60.0, 6) AS "mtcWNe", round(a / 200, 6) AS "sicCAR" FROM g JOIN n1 ON g.n = n1.n JOIN n3 ON g.n = n3.n""")
def town_cell_chars(spark, d):
    out = C.cell_chars(cells(spark, d), cell_edges(spark, d), C.building_chars(buildings(spark, d)))
    return rounded(out.withColumn("ltcWRB", F.round("ltcWRB", 9)), 9).select(*(F.round(c, 6).alias(c) if t == "double" and c != "ltcWRB" else F.col(c) for c, t in out.dtypes))


@query(f"""WITH {TOWN}, k AS (SELECT DISTINCT b FROM g), s AS (SELECT b, count(*) AS c, sum(a) AS a FROM g GROUP BY 1)
    SELECT s.b AS "eID", 2200.0 AS "ldkAre", 260.0 AS "ldkPer", round(2200 / (pi() * 12500 / 4), 6) AS "lskCCo", 1.0 AS "lskERI", round(sqrt(12500) * (4 / pi() - 16 * 2200.0 / 67600), 6) AS "lskCWA", 0.0 AS "ltkOri", round(c / 2200.0, 6) AS "likWCe", round(a / 2200, 6) AS "likWBB",
        round(((SELECT count(*) FROM k WHERE k.b // 16 = s.b // 16 AND abs(k.b - s.b) = 1)) / 260.0, 6) AS "ltkWNB" FROM s""")
def town_enclosure_chars(spark, d):
    e = enclosures(spark, d)
    return rounded(C.enclosure_chars(e, cells(spark, d), C.building_chars(buildings(spark, d)), P.queen_contiguity(ringed(e), "eID")))


#: The street of each building and cell: the one beside the block where it is nearer than the one below.
STREETS = f"""{TOWN}, k AS (SELECT DISTINCT b, (b % 16) * 110.0 - 4 AS x, (b // 16) * 40.0 - 5 AS y FROM g), st AS (SELECT 2 * b AS nid, x AS x1, y AS y1, x + 110 AS x2, y AS y2, 110.0 AS len FROM k UNION ALL SELECT 2 * b + 1, x, y, x, y + 40, 40.0 FROM k),
    at_ AS (SELECT g.*, EXISTS (SELECT 1 FROM k WHERE k.b = g.b + 1) AND (g.b + 1) % 16 <> 0 AS beyond FROM g),
    near AS (SELECT *, CASE WHEN i = 0 THEN 2 * b + 1 WHEN i = 9 AND full_ AND beyond THEN 2 * (b + 1) + 1 ELSE 2 * b END AS bstreet, CASE WHEN i = 0 THEN 2 * b + 1 ELSE 2 * b END AS cstreet FROM at_)"""


@query(f"""WITH {STREETS} SELECT n AS id, bstreet AS "nID", CASE WHEN bstreet = 2 * b THEN 7.0 WHEN bstreet = 2 * b + 1 THEN 4.0 + CASE WHEN full_ THEN 0 ELSE 1 END ELSE 6.0 END AS distance FROM near""")
def town_nearest_streets(spark, d):
    return rounded(P.nearest_line(C.with_rings(buildings(spark, d)), streets(spark, d), "id", "nID", 5.0))


def attached_to_streets(spark, d) -> DataFrame:
    """id, nID (the cell's street), cell_area and building_area of each cell."""
    found = P.nearest_line(ringed(cells(spark, d)), streets(spark, d), "id", "nID", 5.0).select("id", "nID")
    areas = C.building_chars(buildings(spark, d)).select("id", F.col("sdbAre").alias("building_area"))
    return materialize(found.withColumn("cell_area", F.lit(200.0)).join(areas.hint("merge"), "id", "left"), "attached")


#: Streets that meet at an end are neighbours.
_NEAR = f"""{STREETS}, ends AS (SELECT nid, x1 AS x, y1 AS y FROM st UNION ALL SELECT nid, x2, y2 FROM st), touch AS (SELECT DISTINCT p.nid, q.nid AS other FROM ends p JOIN ends q ON p.x = q.x AND p.y = q.y),
    two AS (SELECT DISTINCT t.nid, u.other FROM touch t JOIN touch u ON t.other = u.nid), three AS (SELECT DISTINCT t.nid, u.other FROM two t JOIN touch u ON t.other = u.nid),
    item AS (SELECT cstreet AS nid, count(*) AS c, sum(200.0) AS s, count(a) AS nb, coalesce(stddev_samp(a), 0) AS sd FROM near GROUP BY 1)"""


@query(f"""WITH {_NEAR} SELECT st.nid AS "nID", len AS "sdsLen", 1.0 AS "sssLin", item.s AS "sdsAre", round(item.sd, 6) AS "misBAD", round((SELECT avg(o.len) FROM three JOIN st o ON three.other = o.nid WHERE three.nid = st.nid), 6) AS "ldsMSL",
    (SELECT sum(c) FROM three JOIN item o ON three.other = o.nid WHERE three.nid = st.nid) AS "ldsRea", (SELECT sum(s) FROM three JOIN item o ON three.other = o.nid WHERE three.nid = st.nid) AS "ldsAre", round(nb / len, 6) AS "sisBpM" FROM st LEFT JOIN item ON st.nid = item.nid""")
def town_street_chars(spark, d):
    s = streets(spark, d)
    ends = s.select("nID", F.explode(F.array(F.col("line")[0], F.element_at("line", -1))).alias("p")).select("nID", F.concat_ws(" ", "p.x", "p.y").alias("p"))
    return rounded(C.street_chars(s, materialize(graph.shared_value_edges(ends, "nID", "p"), "street_edges"), attached_to_streets(spark, d)))


_TICKS = f"""{STREETS}, tick AS (SELECT b, x, y, j, x + (j + 0.5) * 3 AS tx FROM k, (SELECT unnest(range(0, 36)) AS j) z),
    up AS (SELECT t.b, t.j, 7.0 AS dist FROM tick t JOIN g ON g.b = t.b AND t.tx BETWEEN bx + 10 * i + CASE WHEN full_ THEN 0 ELSE 1 END AND bx + 10 * i + CASE WHEN full_ THEN 0 ELSE 1 END + w GROUP BY t.b, t.j),
    down AS (SELECT t.b, t.j, min(by_ + 2 + h) AS top, min(t.y - (by_ + 2 + h)) AS dist FROM tick t JOIN g ON g.b = t.b - 16 AND t.tx BETWEEN bx + 10 * i + CASE WHEN full_ THEN 0 ELSE 1 END AND bx + 10 * i + CASE WHEN full_ THEN 0 ELSE 1 END + w GROUP BY t.b, t.j HAVING min(t.y - (by_ + 2 + h)) <= 25),
    both_ AS (SELECT t.b, t.j, u.dist AS du, w.dist AS dw FROM tick t LEFT JOIN up u ON t.b = u.b AND t.j = u.j LEFT JOIN down w ON t.b = w.b AND t.j = w.j)"""


@query(f"""WITH {_TICKS} SELECT 2 * b AS "nID", round(coalesce(avg(du), 25) + coalesce(avg(dw), 25), 6) AS "sdsSPW", round(1 - (count(du) + count(dw)) / 72.0, 6) AS "sdsSPO",
    round(sqrt(greatest(0, (coalesce(sum(du * du), 0) + coalesce(sum(dw * dw), 0)) / nullif(count(du) + count(dw), 0) - power((coalesce(sum(du), 0) + coalesce(sum(dw), 0)) / nullif(count(du) + count(dw), 0), 2))), 5) AS "sdsSWD" FROM both_ GROUP BY b""")
def town_street_profile(spark, d):
    below = streets(spark, d).where("nID % 2 = 0")
    out = C.street_profile(below, buildings(spark, d))
    return out.select("nID", F.round("sdsSPW", 6).alias("sdsSPW"), F.round("sdsSPO", 6).alias("sdsSPO"), F.round("sdsSWD", 5).alias("sdsSWD"))


_NODES = f"""{STREETS}, fromto AS (SELECT nid, concat_ws(' ', CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE)) AS a, concat_ws(' ', CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE)) AS b, len FROM st),
    inc AS (SELECT a AS node, b AS other, len FROM fromto UNION ALL SELECT b, a, len FROM fromto), deg AS (SELECT node, count(*) AS d, avg(len) AS ml FROM inc GROUP BY 1),
    walk AS (SELECT node, node AS at_, 0 AS steps FROM deg UNION SELECT w.node, i.other, w.steps + 1 FROM walk w JOIN inc i ON w.at_ = i.node WHERE w.steps < 5),
    ego AS (SELECT node, at_, min(steps) AS steps FROM walk GROUP BY 1, 2),
    e5 AS (SELECT p.node, count(*) AS e, sum(f.len) AS len FROM ego p JOIN fromto f ON p.at_ = f.a JOIN ego q ON q.node = p.node AND q.at_ = f.b GROUP BY 1),
    e3 AS (SELECT p.node, sum(CASE WHEN da.d = 1 OR db.d = 1 THEN f.len ELSE 0 END) AS cds FROM ego p JOIN fromto f ON p.at_ = f.a AND p.steps <= 3 JOIN ego q ON q.node = p.node AND q.at_ = f.b AND q.steps <= 3 JOIN deg da ON da.node = f.a JOIN deg db ON db.node = f.b GROUP BY 1),
    n5 AS (SELECT ego.node, count(*) AS v, avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) AS p1, avg(CASE WHEN d = 3 THEN 1.0 ELSE 0 END) AS p3, avg(CASE WHEN d = 4 THEN 1.0 ELSE 0 END) AS p4, sum(d - 1) AS wd FROM ego JOIN deg ON ego.at_ = deg.node GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_NODES} SELECT deg.node, d AS "mtdDeg", round(ml, 6) AS "mtdMDi", round((e - v + 1) / (2.0 * v - 5), 6) AS "lcdMes", round(p3, 6) AS "linP3W", round(p4, 6) AS "linP4W", round(p1, 6) AS "linPDE", round(v / len, 6) AS "lddNDe", round(wd / len, 6) AS "linWID", cds AS "ldsCDL"
    FROM deg JOIN n5 ON deg.node = n5.node JOIN e5 ON deg.node = e5.node JOIN e3 ON deg.node = e3.node""")
def town_node_chars(spark, d):
    return rounded(C.node_chars(streets(spark, d)).drop("xcnSCl", "lcnClo"))


def attached_to_nodes(spark, d) -> DataFrame:
    """Cells with the nearer end of their street: node, cell_area, building_area."""
    from morphloom.operators import spatial as S

    _, edges = network.network(streets(spark, d), "nID")
    centre = G.centroid(F.col("ring"))
    at = cells(spark, d).select("id", centre["x"].alias("x"), centre["y"].alias("y")).join(attached_to_streets(spark, d).hint("merge"), "id")
    return materialize(S.nearest_node(at, edges, "nID").select("id", "node", "cell_area", "building_area"), "at_nodes")


_ENDS = _NODES.split(",\n    inc AS")[0]


@query(f"""WITH {_ENDS}, inc AS (SELECT a AS node, b AS other, len FROM fromto UNION ALL SELECT b, a, len FROM fromto), ends2 AS (SELECT near.n, near.a, CASE WHEN power(bx + 10 * i + 5 - st.x1, 2) + power(by_ + 10 - st.y1, 2) <= power(bx + 10 * i + 5 - st.x2, 2) + power(by_ + 10 - st.y2, 2) THEN concat_ws(' ', CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE)) ELSE concat_ws(' ', CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE)) END AS node FROM near JOIN st ON near.cstreet = st.nid),
    per AS (SELECT node, count(*) AS c, sum(200.0) AS s, coalesce(stddev_samp(a), 0) AS sd FROM ends2 GROUP BY 1), nb AS (SELECT DISTINCT node, other FROM inc WHERE node <> other)
    SELECT v.node, round(per.sd, 6) AS "midBAD", per.s AS "sddAre", (SELECT sum(c) FROM nb JOIN per o ON nb.other = o.node WHERE nb.node = v.node) AS "midRea", (SELECT sum(s) FROM nb JOIN per o ON nb.other = o.node WHERE nb.node = v.node) AS "midAre" FROM (SELECT DISTINCT node FROM inc) v LEFT JOIN per ON v.node = per.node""")
def town_node_context(spark, d):
    nodes, edges = network.network(streets(spark, d), "nID")
    return rounded(C.node_context(nodes, network.junction_graph(edges), attached_to_nodes(spark, d)))


@query(f"""WITH {STREETS} SELECT n AS id, 0.0 AS "stbCeA", CASE WHEN bstreet % 2 = 1 THEN 0.0 ELSE 0.0 END AS "stbSAl" FROM near""")
def town_alignments(spark, d):
    b = materialize(C.building_chars(buildings(spark, d)).select("id", "stbOri"), "b")
    own = b.join(P.nearest_line(C.with_rings(buildings(spark, d)), streets(spark, d), "id", "nID", 5.0).select("id", "nID").hint("merge"), "id")
    facing = streets(spark, d).select("nID", G.line_orientation(F.col("line")).alias("o"))
    shape = C.cell_shapes(cells(spark, d)).select("id", "stcOri")
    cell = C.alignment(b, "id", "stbOri", shape, "id", "stcOri", "stbCeA")
    return rounded(cell.join(C.alignment(own, "id", "stbOri", facing, "nID", "o", "stbSAl").hint("merge"), "id"))


@query(f"""WITH {_NEAR}, b2 AS (SELECT b, count(*) AS c, sum(a) AS s FROM g GROUP BY 1) SELECT near.n AS id, round(a, 6) AS "sdbAre", round(a / 200, 6) AS "sicCAR", round(b2.c / 2200.0, 6) AS "likWCe", round(b2.s / 2200, 6) AS "likWBB", st.len AS "sdsLen", item.s AS "sdsAre", round(item.nb / st.len, 6) AS "sisBpM",
    (SELECT count(*) FROM ends e WHERE e.x = st.x1 AND e.y = st.y1) AS "mtdDeg" FROM near JOIN b2 ON near.b = b2.b JOIN st ON near.cstreet = st.nid JOIN item ON item.nid = st.nid""")
def town_primary_chars(spark, d):
    """The wide table: each cell with its building, enclosure, street and that street's first node."""
    b = materialize(C.building_chars(buildings(spark, d)), "b")
    edges, s = cell_edges(spark, d), streets(spark, d)
    cell = C.cell_chars(cells(spark, d), edges, b)
    attached = attached_to_streets(spark, d)
    nodes, lines = network.network(s, "nID")
    cell = cell.join(attached.select("id", "nID").hint("merge"), "id", "left").join(lines.select("nID", F.col("node_start").alias("node")).hint("merge"), "nID", "left")
    e = C.enclosure_chars(enclosures(spark, d), cells(spark, d), b, P.queen_contiguity(ringed(enclosures(spark, d)), "eID"))
    st = C.street_chars(s, lines.select(F.col("nID").alias("focal"), F.col("nID").alias("neighbor"), F.lit(1.0).alias("weight")), attached)
    n = nodes.withColumnRenamed("degree", "mtdDeg")
    wide = C.primary(cell, b, e, st, n)
    return rounded(wide.select("id", "sdbAre", "sicCAR", "likWCe", "likWBB", "sdsLen", "sdsAre", "sisBpM", "mtdDeg"))


@query(f"""WITH {PAIRS}, f AS (SELECT *, ({_grown("0.1")} + CASE WHEN hole THEN 0.36 ELSE 0 END) / (rim + (4 + step) * {_ARC["0.1"]} - 2 * step * 0.1 + CASE WHEN hole THEN 3.2 ELSE 0 END) AS fr, least(w, h) / greatest(w, h) AS elo FROM u),
    m AS (SELECT b, median(a) AS md, median(CASE WHEN hole THEN 1 ELSE 0 END) AS mc FROM f GROUP BY 1), z AS (SELECT f.*, md, mc, fr < 8 AND elo < 0.9 AS thin FROM f JOIN m ON f.b = m.b),
    top AS (SELECT b, sum(CASE WHEN ra <= 10 THEN a END) AS "limAre", sum(CASE WHEN rp <= 10 THEN p END) AS "limPer", round(sum(CASE WHEN rl <= 10 THEN sqrt(w * w + h * h) END), 4) AS "limLAL" FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a DESC) AS ra, row_number() OVER (PARTITION BY b ORDER BY p DESC) AS rp, row_number() OVER (PARTITION BY b ORDER BY w * w + h * h DESC) AS rl FROM f) x GROUP BY 1),
    q AS (SELECT b, round(sum(CASE WHEN thin THEN a ELSE 0 END) / sum(a), 6) AS mfr, round(avg(CASE WHEN thin THEN 1.0 ELSE 0 END), 6) AS mtc, round(sum(CASE WHEN thin AND a > md THEN a ELSE 0 END) / sum(CASE WHEN a > md THEN a END), 6) AS lmfr, max(mc) AS mc, sum(CASE WHEN thin THEN a ELSE 0 END) / sum(a) > 0.4 AS large FROM z GROUP BY 1)
    SELECT concat('block_', q.b) AS label, mfr AS "limMFR", mtc AS "limMTC", lmfr AS "limLMFR", large OR mc > 0 AS "limLPS", "limAre", "limPer", "limLAL" FROM q JOIN top ON q.b = top.b""")
def town_group_chars(spark, d):
    b = buildings(spark, d)
    touching = P.fuzzy_contiguity(C.with_rings(b), "id", 0.25, 20.0)
    full = C.building_chars(b).join(C.structure_chars(b, touching).hint("merge"), "id")
    labels = b.select("id", F.concat_ws("_", F.lit("block"), F.col("eID").cast("string")).alias("label"))
    out = X.group_chars(full, labels)
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("limMFR", "limMTC", "limLMFR")), "limLPS", "limAre", "limPer", F.round("limLAL", 4).alias("limLAL"))


@query(f"""WITH {PAIRS} SELECT component, round(max(area), 6) AS area, round(max(rim) + max(CASE WHEN hole THEN 4 ELSE 0 END), 6) AS perimeter, 1 AS parts, max(CASE WHEN hole THEN 1 ELSE 0 END) AS holes, max(4 + 2 * step) AS corners FROM u GROUP BY 1""")
def town_dissolved(spark, d):
    b = C.with_rings(buildings(spark, d))
    own = b.join(graph_components(P.fuzzy_contiguity(b, "id", 0.25, 20.0), b), "id")
    parts = P.dissolve(own, ["component"], "rings", 200.0)
    rings = F.col("rings")
    return parts.groupBy("component").agg(F.round(F.sum(G.polygon_area(rings)), 6).alias("area"), F.round(F.sum(G.perimeter(rings)), 6).alias("perimeter"), F.count(F.lit(1)).alias("parts"), F.sum(F.size(rings) - 1).alias("holes"), F.max(F.size(rings[0]) - 1).alias("corners"))


