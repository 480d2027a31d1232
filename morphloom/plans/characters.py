"""The primary characters of each entity, as plans over rings, lines and neighbour graphs.

Inputs: buildings (id, ring, holes), cells (id, ring, eID; a negative id has no building),
enclosures (eID, ring), streets (nID, line). Outputs are keyed by the entity's id, so that
``primary`` joins them by key and never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions.scalar import ratio
from morphloom.functions.polygons import polygon_distance
from morphloom.functions.shapes import shape_chars
from morphloom.operators import context, graph, network, polygons, spatial
from morphloom.operators import relational as R
from morphloom.operators.components import connected_components
from morphloom.storage import materialize


def building_chars(buildings: DataFrame) -> DataFrame:
    """Size and shape of buildings; round ones (compactness of 0.95 and more) have no corners."""
    b = buildings.withColumn("s", shape_chars("ring")).withColumn("rings", F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    area, perimeter = G.polygon_area(F.col("rings")), G.length(F.col("ring"))
    compact = G.circular_compactness(area, F.col("s.radius"))
    centre = G.centroid(F.col("ring"))
    corner = F.slice("ring", 1, F.size("ring") - 1)
    reach = F.transform(corner, lambda p: F.hypot(p["x"] - F.col("c.x"), p["y"] - F.col("c.y")))
    made = b.select(
        "id", area.alias("sdbAre"), perimeter.alias("sdbPer"), G.courtyard_area(F.col("rings")).alias("sdbCoA"), compact.alias("ssbCCo"),
        F.when(compact >= 0.95, 0).otherwise(G.corners(F.col("ring"))).alias("ssbCor"), F.when(compact >= 0.95, 90.0).otherwise(G.squareness(F.col("ring"))).alias("ssbSqu"),
        G.equivalent_rectangular_index(area, perimeter, F.col("s.mrr_area"), F.col("s.mrr_perimeter")).alias("ssbERI"), F.col("s.elongation").alias("ssbElo"), F.col("s.orientation").alias("stbOri"),
        (2 * F.col("s.radius")).alias("sdbLAL"), centre.alias("c"), "ring",
    )
    n = F.size("_r")
    mean = F.aggregate("_r", F.lit(0.0), lambda t, v: t + v) / n
    return made.withColumn("_r", reach).withColumn("ssbCCM", mean).withColumn("ssbCCD", F.sqrt(F.aggregate(F.transform("_r", lambda v: (v - F.col("ssbCCM")) * (v - F.col("ssbCCM"))), F.lit(0.0), lambda t, v: t + v) / n)).drop("_r", "c", "ring")


def cell_shapes(cells: DataFrame) -> DataFrame:
    """Size and shape of cells, and their perimeter as ``_p``."""
    c = cells.withColumn("s", shape_chars("ring"))
    area, perimeter = G.area(F.col("ring")), G.length(F.col("ring"))
    return c.select("id", "eID", area.alias("sdcAre"), perimeter.alias("_p"), F.col("s.orientation").alias("stcOri"), (2 * F.col("s.radius")).alias("sdcLAL"), G.circular_compactness(area, F.col("s.radius")).alias("sscCCo"), G.equivalent_rectangular_index(area, perimeter, F.col("s.mrr_area"), F.col("s.mrr_perimeter")).alias("sscERI"))


def cell_chars(cells: DataFrame, edges: DataFrame, buildings: DataFrame) -> DataFrame:
    """Size, shape and context of cells; empty cells have no coverage."""
    own, areas = cell_shapes(cells), buildings.select("id", "sdbAre").hint("merge")
    loops = graph.with_self(edges, own, "id")
    n = graph.cardinalities(edges, own, "id").select(F.col("focal").alias("id"), "n")
    near = graph.neighbourhood(loops, own.select(F.col("id").alias("_id"), "sdcAre"), "_id", [F.sum("sdcAre").alias("mdcAre")]).withColumnRenamed("focal", "id")
    wide = graph.partial_apply(loops, 3, own, "id", [F.countDistinct("eID").alias("_e"), F.sum("sdcAre").alias("_a")]).select(F.col("focal").alias("id"), ratio(F.col("_e"), F.col("_a")).alias("ltcWRB"))
    built = own.select("id").join(areas, "id", "left").select("id", F.coalesce("sdbAre", F.lit(0.0)).alias("_b"))
    spread = [graph.partial_apply(loops, k, built, "id", [F.coalesce(F.stddev_samp("_b"), F.lit(0.0)).alias(name)]).withColumnRenamed("focal", "id") for k, name in ((1, "micBAD"), (3, "licBAD"))]
    out = own.join(n, "id", "left").join(near, "id", "left").join(wide, "id", "left").join(areas, "id", "left")
    for s in spread:
        out = out.join(s, "id", "left")
    return out.withColumns({"mtcWNe": ratio(F.col("n"), F.col("_p")), "sicCAR": ratio(F.col("sdbAre"), F.col("sdcAre"))}).drop("_p", "n", "sdbAre")


def enclosure_chars(enclosures: DataFrame, cells: DataFrame, buildings: DataFrame, edges: DataFrame) -> DataFrame:
    e = enclosures.withColumn("s", shape_chars("ring"))
    area, perimeter = G.area(F.col("ring")), G.length(F.col("ring"))
    diameter = 2 * F.col("s.radius")
    own = e.select("eID", area.alias("ldkAre"), perimeter.alias("ldkPer"), G.circular_compactness(area, F.col("s.radius")).alias("lskCCo"), G.equivalent_rectangular_index(area, perimeter, F.col("s.mrr_area"), F.col("s.mrr_perimeter")).alias("lskERI"), G.compactness_weighted_axis(diameter, area, perimeter).alias("lskCWA"), F.col("s.orientation").alias("ltkOri"))
    inside = cells.join(buildings.select("id", "sdbAre"), "id", "left").groupBy("eID").agg(F.count(F.lit(1)).alias("_n"), F.sum("sdbAre").alias("_b"))
    n = graph.cardinalities(edges, own, "eID").select(F.col("focal").alias("eID"), F.col("n").alias("_k"))
    out = own.join(inside, "eID", "left").join(n, "eID", "left")
    return out.withColumns({"likWCe": ratio(F.col("_n"), F.col("ldkAre")), "likWBB": ratio(F.coalesce("_b", F.lit(0.0)), F.col("ldkAre")), "ltkWNB": ratio(F.col("_k"), F.col("ldkPer"))}).drop("_n", "_b", "_k")


def street_chars(streets: DataFrame, street_edges: DataFrame, attached: DataFrame) -> DataFrame:
    """``attached`` has nID and the areas of the cell and the building each item stands for."""
    own = streets.select("nID", G.length(F.col("line")).alias("sdsLen"), G.linearity(F.col("line")).alias("sssLin"))
    per = attached.groupBy("nID").agg(F.sum("cell_area").alias("sdsAre"), F.count("building_area").alias("_n"), F.coalesce(F.stddev_samp("building_area"), F.lit(0.0)).alias("misBAD"))
    loops = graph.with_self(street_edges, own, "nID")
    mean = graph.partial_apply(loops, 3, own, "nID", [F.avg("sdsLen").alias("ldsMSL")]).withColumnRenamed("focal", "nID")
    reach = graph.reached(loops, 3, attached, "nID", "cell_area", [F.sum("_n").alias("ldsRea"), F.sum("_s").alias("ldsAre")], own, "nID").withColumnRenamed("focal", "nID")
    out = own.join(per, "nID", "left").join(mean, "nID", "left").join(reach, "nID", "left")
    return out.withColumn("sisBpM", ratio(F.when(F.col("_n") > 0, F.col("_n")), F.col("sdsLen"))).drop("_n")


def node_chars(streets: DataFrame) -> DataFrame:
    """Junctions by their coordinates: degree, incident length, squares, ego-graph measures."""
    nodes, edges = network.network(streets, "nID")
    g = network.junction_graph(edges)
    mean = graph.mean_incident_length(edges, "node_start", "node_end", "length").withColumnRenamed("mean_length", "mtdMDi")
    out = nodes.withColumnRenamed("degree", "mtdDeg").join(mean, "node", "left").join(graph.square_clustering(g).withColumnRenamed("clustering", "xcnSCl"), "node", "left")
    ego = network.ego_measures(edges, 5).select(F.col("focal").alias("node"), F.col("meshedness").alias("lcdMes"), F.col("three_way").alias("linP3W"), F.col("four_way").alias("linP4W"), F.col("dead_ends").alias("linPDE"), F.col("node_density").alias("lddNDe"), F.col("weighted_density").alias("linWID"), F.col("dead_end_length").alias("ldsCDL"))
    ego = ego.drop("ldsCDL").join(network.ego_measures(edges, 3).select(F.col("focal").alias("node"), F.col("dead_end_length").alias("ldsCDL")), "node", "left")
    close = network.local_closeness(edges, 5).select(F.col("focal").alias("node"), F.col("closeness").alias("lcnClo"))
    return out.join(ego, "node", "left").join(close, "node", "left")


def with_rings(buildings: DataFrame) -> DataFrame:
    """``buildings`` with ring and holes as one array of rings."""
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return buildings.withColumn("rings", F.concat(F.array("ring"), F.coalesce("holes", none)))


def structure_chars(buildings: DataFrame, touching: DataFrame, tile: float | None = None, same_as_released: bool = True) -> DataFrame:
    """What a building's joined structure is like: (id, component, mibCou, mibLen, mibAre, mibElo, mibERI,
    mibCCo, mibLAL, mibFR, mibSCo, libNCo, ldbPWL).

    Structures are components of ``touching``. Their shape is that of the union grown by 0.1;
    courtyards and the outer wall are those of the union of buildings grown by 0.25. The released
    mibSCo repeats mibFR; with ``same_as_released`` off it is the square compactness it is named for.
    """
    comps = connected_components(touching.select("focal", "neighbor"), "focal", "neighbor").withColumnRenamed("node", "id")

    def shaped(m: Column, o: Column, radius: Column) -> list[Column]:
        area, perimeter = m["area"], m["perimeter"]
        facade = G.facade_ratio(area, perimeter)
        square = (4 * F.sqrt(area) / perimeter) * (4 * F.sqrt(area) / perimeter)
        return [
            F.col("count").alias("mibCou"), perimeter.alias("mibLen"), area.alias("mibAre"), ratio(m["shortest"], m["longest"]).alias("mibElo"),
            G.equivalent_rectangular_index(area, perimeter, m["longest"] * m["shortest"], 2 * (m["longest"] + m["shortest"])).alias("mibERI"), G.circular_compactness(area, radius).alias("mibCCo"),
            (2 * radius).alias("mibLAL"), facade.alias("mibFR"), (facade if same_as_released else square).alias("mibSCo"), o["n_rings"].cast("int").alias("libNCo"), o["outer_length"].alias("ldbPWL"),
        ]

    known, rest = polygons.upright_structures(with_rings(buildings), comps, "id", "component", "rings", 0.1, 0.25, 16)
    m, o = F.col("m"), F.col("o")
    out = known.select(F.explode("members").alias("id"), "component", *shaped(m, o, F.col("radius")))
    if rest is None:
        return out
    whole = polygons.structure_measures(polygons.dissolve(rest, ["component"], "rings", tile), "component", "rings", 0.1, 16, tile)
    walls = polygons.outer_walls(rest, "component", "rings", 0.25, 16, tile)
    count = rest.groupBy("component").agg(F.count(F.lit(1)).alias("count"))
    each = lambda df, name: df.select("component", F.struct(*(c for c in df.columns if c != "component")).alias(name))
    other = count.join(each(whole, "m"), "component").join(each(walls, "o"), "component").select("component", *shaped(m, o, F.col("m.radius")))
    return out.unionByName(rest.select("id", "component").join(other, "component"))


def wall_chars(buildings: DataFrame, size: float, tolerance: float = 0.15) -> DataFrame:
    """mtbSWR: the share of a building's rim that runs along others."""
    b = with_rings(buildings)
    walls = polygons.shared_walls(b, "id", size, tolerance).groupBy(F.col("focal").alias("id")).agg(F.sum("length").alias("_w"))
    return b.select("id", G.perimeter(F.col("rings")).alias("_p")).join(walls, "id", "left").select("id", ratio(F.coalesce("_w", F.lit(0.0)), F.col("_p")).alias("mtbSWR"))


def building_context(buildings: DataFrame, edges: DataFrame, structures: DataFrame) -> DataFrame:
    """ltcBuA, mtbAli: structures per building among neighbours; difference of orientation.

    Neighbours are those of the building's cell that have a building too.
    """
    near = graph.subgraph(edges, buildings, "id")
    loops = graph.with_self(near, buildings, "id")
    share = graph.neighbourhood(loops, structures.select(F.col("id").alias("_id"), "component"), "_id", [ratio(F.countDistinct("component"), F.count(F.lit(1))).alias("ltcBuA")]).withColumnRenamed("focal", "id")
    ali = context.neighbour_difference(near, buildings, "id", "stbOri", "mtbAli").withColumnRenamed("focal", "id")
    return buildings.select("id").join(share, "id", "left").join(ali, "id", "left")


def distance_context(buildings: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """mtbNDi, ltbIBD: mean distance to neighbours, and between all neighbours within k steps.

    Steps go over all cells, distances are between neighbouring cells' buildings.
    """
    b = with_rings(buildings).select("id", "rings")
    pairs = edges.where("focal < neighbor").select("focal", "neighbor").join(b.select(F.col("id").alias("focal"), F.col("rings").alias("_a")), "focal").join(b.select(F.col("id").alias("neighbor"), F.col("rings").alias("_b")), "neighbor")
    gaps = materialize(pairs.select("focal", "neighbor", polygon_distance("_a", "_b").alias("distance")), "gaps")
    both = gaps.unionByName(gaps.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), "distance"))
    near = both.groupBy(F.col("focal").alias("id")).agg(F.avg("distance").alias("mtbNDi"))
    loops = edges.where("focal <> neighbor").select("focal", "neighbor").unionByName(edges.select(F.explode(F.array("focal", "neighbor")).alias("focal")).distinct().select("focal", F.col("focal").alias("neighbor")))
    around = context.mean_pair_distance(loops, gaps, k).select(F.col("focal").alias("id"), F.col("mean").alias("ltbIBD"))
    return b.select("id").join(near, "id", "left").join(around, "id", "left")


def alignment(rows: DataFrame, key: str, own: str, other: DataFrame, link: str, orientation: str, name: str) -> DataFrame:
    """(key, name): absolute difference of a row's orientation and that of what it is linked to (by ``link``)."""
    side = other.select(F.col(link).alias("_k"), F.col(orientation).alias("_o"))
    return rows.join(side.hint("merge"), rows[link] == side["_k"], "left").select(key, F.abs(F.col(own) - F.col("_o")).alias(name))


def street_profile(streets: DataFrame, buildings: DataFrame, distance: float = 3.0, tick: float = 50.0) -> DataFrame:
    """sdsSPW, sdsSPO, sdsSWD: width between facades, share of ticks without any, spread of the hits.

    Every ``distance`` along a street a tick goes out on either side, half of ``tick`` long; a side
    without any hit counts as that far.
    """
    half = tick / 2.0
    part = streets.select("nID", F.posexplode(G.segments(F.col("line"))).alias("k", "s")).withColumn("_l", F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y"))).where("_l > 0")
    n = F.greatest(F.lit(1), F.floor(F.col("_l") / distance).cast("int"))
    at = part.select("nID", "k", "s", "_l", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), n.alias("n")).withColumn("t", (F.col("i") + 0.5) * F.least(F.lit(distance), F.col("_l")) / F.col("_l"))
    c = F.col
    ux, uy = (c("s.b.x") - c("s.a.x")) / c("_l"), (c("s.b.y") - c("s.a.y")) / c("_l")
    px, py = c("s.a.x") + c("t") * (c("s.b.x") - c("s.a.x")), c("s.a.y") + c("t") * (c("s.b.y") - c("s.a.y"))
    ticks = at.select("nID", F.concat_ws(" ", "nID", "k", "i").alias("tick"), px.alias("px"), py.alias("py"), F.explode(F.array(F.struct((-uy).alias("dx"), ux.alias("dy"), F.lit(1).alias("side")), F.struct(uy.alias("dx"), (-ux).alias("dy"), F.lit(-1).alias("side")))).alias("d"))
    ticks = ticks.select("nID", "tick", "px", "py", "d.*").withColumns({"minx": F.least(c("px"), c("px") + half * c("dx")), "maxx": F.greatest(c("px"), c("px") + half * c("dx")), "miny": F.least(c("py"), c("py") + half * c("dy")), "maxy": F.greatest(c("py"), c("py") + half * c("dy"))})
    e = polygons.segments_of(with_rings(buildings), "id")
    e = e.withColumns({"minx": F.least("ax", "bx"), "maxx": F.greatest("ax", "bx"), "miny": F.least("ay", "by"), "maxy": F.greatest("ay", "by")})
    ex, ey = c("r_bx") - c("r_ax"), c("r_by") - c("r_ay")
    cross = c("dx") * ey - c("dy") * ex
    wx, wy = c("r_ax") - c("px"), c("r_ay") - c("py")
    far, along = F.try_divide(wx * ey - wy * ex, cross), F.try_divide(wx * c("dy") - wy * c("dx"), cross)
    hits = spatial.box_join(ticks, e, tick).withColumns({"_far": far, "_along": along}).where(c("_far").between(0.0, half) & c("_along").between(0.0, 1.0))
    near = hits.groupBy("nID", "tick", "side").agg(F.min("_far").alias("d"))
    every = ticks.select("nID", "tick", "side").join(near, ["nID", "tick", "side"], "left")
    mean = lambda s: F.coalesce(F.avg(F.when(c("side") == s, c("d"))), F.lit(half))
    out = every.groupBy("nID").agg((mean(1) + mean(-1)).alias("sdsSPW"), F.avg(c("d").isNull().cast("double")).alias("sdsSPO"), F.stddev_pop("d").alias("sdsSWD"))
    return streets.select("nID").join(out, "nID", "left")


def node_context(nodes: DataFrame, node_edges: DataFrame, attached: DataFrame) -> DataFrame:
    """midBAD, sddAre, midRea, midAre: spread of building areas and cell area at a node, count and area of
    the cells at its neighbours. ``attached`` has node, cell_area and building_area (null without a building)."""
    per = attached.groupBy("node").agg(F.coalesce(F.stddev_samp("building_area"), F.lit(0.0)).alias("midBAD"), F.sum("cell_area").alias("sddAre"))
    around = graph.reached(node_edges, 1, attached, "node", "cell_area", [F.sum("_n").alias("midRea"), F.sum("_s").alias("midAre")], nodes, "node").withColumnRenamed("focal", "node")
    return nodes.select("node").join(per, "node", "left").join(around, "node", "left")


def primary(cells: DataFrame, buildings: DataFrame, enclosures: DataFrame, streets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The wide table: every cell with what its building, enclosure, street and node have."""
    dims = [(buildings.withColumnRenamed("id", "_b"), "id", "_b"), (enclosures.withColumnRenamed("eID", "_e"), "eID", "_e"), (streets.withColumnRenamed("nID", "_s"), "nID", "_s"), (nodes.withColumnRenamed("node", "_n"), "node", "_n")]
    keep = [*cells.columns, *(c for d, *_ in dims for c in d.columns if not c.startswith("_"))]
    return R.star_join(cells, [(d.hint("merge"), left, right) for d, left, right in dims], list(dict.fromkeys(keep)))
