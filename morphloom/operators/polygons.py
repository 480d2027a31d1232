"""Polygons that meet: contiguity, union by group, cleaning of footprints, shared walls, enclosures.

``rings`` is an outer ring and its holes. Candidates come from bucket joins of boxes; exact tests
and unions run in Arrow batches. A union of many polygons is built in steps, by tiles and shares of
bounded size first, so that no task holds all of a large group's polygons.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.functions import geometry as G
from morphloom.functions import overlay as O
from morphloom.functions import polygons as K
from morphloom.functions import upright as U
from morphloom.operators import spatial as P
from morphloom.operators.components import connected_components
from morphloom.storage import materialize

#: Polygons that one task unites at a time.
TOGETHER = 128


def boxed(df: DataFrame, rings: str = "rings", by: float = 0.0) -> DataFrame:
    b = G.bounds(F.col(rings)[0])
    return df.withColumns({"minx": b["minx"] - by, "miny": b["miny"] - by, "maxx": b["maxx"] + by, "maxy": b["maxy"] + by})


def near_pairs(polygons: DataFrame, key: str, distance: float, size: float, rings: str = "rings") -> DataFrame:
    """(focal, neighbor, distance), each pair once with focal < neighbor: polygons at most ``distance`` apart.

    The gap of upright outlines is that of their boxes, unless one may lie in a hole of the other;
    only the other pairs are measured in Python, and only these need the polygons beside the boxes.
    """
    c = F.col
    own = P.with_boxes(polygons.select(c(key).alias("id"), c(rings).alias("g"), F.size(rings).alias("_n")), c("g")[0]).withColumns({n: c(n) + F.lit(s * distance / 2) for n, s in zip(("minx", "miny", "maxx", "maxy"), (-1, -1, 1, 1))})
    seen, others = P.extents(own, size, "_up")
    gap = lambda lo, hi: F.greatest(F.greatest(lo, f"r_{lo}") - F.least(hi, f"r_{hi}") + distance, F.lit(0.0))
    within = lambda a, b: (c(f"{a}minx") > c(f"{b}minx")) & (c(f"{a}miny") > c(f"{b}miny")) & (c(f"{a}maxx") < c(f"{b}maxx")) & (c(f"{a}maxy") < c(f"{b}maxy"))
    exact = ~(within("", "r_") & (c("r__n") > 1)) & ~(within("r_", "") & (c("_n") > 1))
    boxes = P.box_pairs(own.where("_up").drop("g", "_up"), "id", size, seen, 2.0).where("id <> r_id")
    boxes = boxes.select(F.least("id", "r_id").alias("focal"), F.greatest("id", "r_id").alias("neighbor"), F.when(exact, F.hypot(gap("minx", "maxx"), gap("miny", "maxy"))).alias("distance"))
    near = materialize(boxes.where(c("distance").isNull() | (c("distance") <= distance)), "near")
    pairs, unsure = near.where("distance IS NOT NULL"), near.where("distance IS NULL").select("focal", "neighbor")
    if not unsure.isEmpty():
        side = lambda n: own.select(c("id").alias(n), c("g").alias(f"g_{n}")).hint("merge")
        pairs = pairs.unionByName(unsure.join(side("focal"), "focal").join(side("neighbor"), "neighbor").select("focal", "neighbor", K.polygon_distance("g_focal", "g_neighbor").alias("distance")))
    if others:
        rest = P.uneven_joins(own.drop("_n"), own.drop("_n"), size, "_up", K.polygon_distance("g", "r_g"), "distance").where("id < r_id")
        pairs = pairs.unionByName(rest.select(c("id").alias("focal"), c("r_id").alias("neighbor"), "distance"))
    return pairs.where(c("distance") <= distance)


def fuzzy_contiguity(polygons: DataFrame, key: str, buffer: float, size: float, rings: str = "rings") -> DataFrame:
    """Polygons whose buffers meet: (focal, neighbor, weight), both ways, without loops."""
    once = near_pairs(polygons, key, 2 * buffer, size, rings)
    way = lambda a, b: F.struct(F.col(a).alias("focal"), F.col(b).alias("neighbor"))
    return once.select(F.inline(F.array(way("focal", "neighbor"), way("neighbor", "focal")))).withColumn("weight", F.lit(1.0))


def queen_contiguity(polygons: DataFrame, key: str, rings: str = "rings", digits: int = 6) -> DataFrame:
    """Polygons that share a vertex: (focal, neighbor, weight), both ways, without loops."""
    vertex = F.explode(F.flatten(rings)).alias("p")
    at = polygons.select(F.col(key).alias("id"), vertex).select("id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    other = at.withColumnRenamed("id", "neighbor")
    pairs = at.withColumnRenamed("id", "focal").join(other, ["x", "y"]).where("focal <> neighbor")
    return pairs.select("focal", "neighbor").distinct().withColumn("weight", F.lit(1.0))


def _united(df: DataFrame, keys: Sequence[str], rings: str, grow: float = 0.0, quarter: int = 8) -> DataFrame:
    """The union of each group as rows of parts; a group has to fit a task."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("part", T.IntegerType()), T.StructField(rings, K.RINGS_TYPE)])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        polygons = [p for p in map(K.to_polygon, t.column(rings).to_pylist()) if p]
        parts = (O.buffer(polygons, grow, quarter) if grow else O.union(polygons)) if polygons else []
        cols = [pa.array([k.as_py()] * len(parts), k.type) for k in key]
        return pa.table([*cols, pa.array(range(len(parts)), pa.int32()), pa.array([K.from_polygon(p) for p in parts], K.ARROW_RINGS)], names=[*keys, "part", rings])

    return df.select(*keys, rings).groupBy(*keys).applyInArrow(run, schema)


def dissolve(polygons: DataFrame, by: Sequence[str], rings: str = "rings", tile: float | None = None, grow: float = 0.0, quarter: int = 8) -> DataFrame:
    """(by, part, rings): the union of each group's polygons, after growing each by ``grow``.

    Groups of more than ``TOGETHER`` polygons are united in shares first: polygons of a tile (of
    side ``tile``; else any) together, until a share is left for each group. What the last step
    holds are outlines without the walls inside them.
    """
    by = list(by)
    now = polygons.where(F.col(rings).isNotNull()).select(*by, rings)
    if grow:
        now = materialize(now.select(*by, F.explode(K.buffered(grow, quarter)(rings)).alias(rings)), "grown")
    corner = G.bounds(F.col(rings)[0])
    where = F.xxhash64(F.floor(corner["minx"] / tile), F.floor(corner["miny"] / tile)) if tile else F.lit(0).cast("bigint")
    counts = now.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    while most > TOGETHER:
        shares = F.ceil(F.col("_n") / TOGETHER)
        # neighbours by tile come to one share where they can, so that walls go early
        dealt = now.join(counts, by).withColumn("_share", F.when(F.col("_n") <= TOGETHER, F.lit(0)).otherwise(F.pmod(where + F.xxhash64(rings) % F.greatest(F.lit(1), shares / 8).cast("bigint"), shares.cast("bigint"))))
        now = materialize(_united(dealt, [*by, "_share"], rings).select(*by, rings), "united")
        counts = now.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        left = counts.agg(F.max("_n")).first()[0]
        if left > 0.7 * most:  # what is left are parts that hardly touch: unite all of them
            break
        most = left
    # one polygon is its own union: it needs no group
    single = counts.where("_n = 1").select(*by)
    alone = now.join(single, by, "left_semi")
    alone = alone.select(*by, F.lit(0).alias("part"), rings) if grow else alone.select(*by, F.posexplode(K.made_valid(rings)).alias("part", rings))
    return alone.unionByName(_united(now.join(single, by, "left_anti"), by, rings))


def structure_measures(buildings: DataFrame, component: str, rings: str = "rings", grow: float = 0.0, quarter: int = 8, tile: float | None = None) -> DataFrame:
    """One row a component: measures of the union of its buildings grown by ``grow``.

    Sums over parts; rectangle and circle are those of the part with the largest area.
    """
    parts = dissolve(buildings, [component], rings, tile, grow, quarter)
    rows = parts.select(component, K.measured(rings).alias("m")).select(component, "m.*")
    own = ["longest", "shortest", "orientation", "mrr_area", "mrr_perimeter", "radius"]
    sums = [F.sum(c).alias(c) for c in ("area", "perimeter", "outer_length", "n_rings")]
    return rows.groupBy(component).agg(*sums, *(F.max_by(c, "area").alias(c) for c in own))


def plain_boxes(df: DataFrame, rings: str) -> DataFrame:
    """``boxed``, and in ``_up`` whether the polygon is its box."""
    return P.with_boxes(df, F.col(rings)[0], F.size(rings) == 1)


def outer_walls(buildings: DataFrame, component: str, rings: str = "rings", grow: float = 0.0, quarter: int = 8, tile: float | None = None) -> DataFrame:
    """(component, n_rings, outer_length): holes and outer rims of the union of its buildings grown by ``grow``."""
    parts = dissolve(buildings, [component], rings, tile, grow, quarter)
    return parts.groupBy(component).agg(F.sum(F.size(rings) - 1).alias("n_rings"), F.sum(G.length(F.col(rings)[0])).alias("outer_length"))


def upright_structures(buildings: DataFrame, components: DataFrame, key: str, component: str, rings: str = "rings", grow: float = 0.1, wall: float = 0.25, quarter: int = 16) -> tuple[DataFrame, DataFrame | None]:
    """What ``structure_measures`` (grown by ``grow``) and ``outer_walls`` (by ``wall``) tell of structures that are
    one upright building, with a courtyard at most, or two plain ones that meet; and the rows of all others with
    their component, None without any.

    ``components`` has the component of each building that is not alone. The first has, for each component, its
    measures as ``m``, its walls as ``o``, ``radius``, ``count``, and its buildings as ``members``. These are closed
    forms over whole columns, so that unions are left for what has none, and rings stay where they are.
    """
    box, hole = ("minx", "miny", "maxx", "maxy"), ("_x", "_y", "_x2", "_y2")
    outer, inner = F.col(rings)[0], F.get(rings, F.lit(1))
    made = F.struct(*(G.bounds(r)[c].alias(n) for r, names in ((outer, box), (inner, hole)) for c, n in zip(box, names)), G.upright(outer).alias("_up"), G.upright(inner).alias("_court"), F.size(rings).alias("_n"))
    c, within = F.col, 1e-3
    inside = (c("_x") > c("minx") + within) & (c("_y") > c("miny") + within) & (c("_x2") < c("maxx") - within) & (c("_y2") < c("maxy") - within)
    plain = c("_up") & ((c("_n") == 1) | ((c("_n") == 2) & c("_court") & inside))
    rows = buildings.select(key, F.inline(F.array(made))).select(key, *box, F.coalesce(plain, F.lit(False)).alias("_plain"), (c("_x2") - c("_x")).alias("_w"), (c("_y2") - c("_y")).alias("_h"))
    placed = lambda df: df.join(components.select(key, component).hint("merge"), key, "left").withColumn(component, F.coalesce(component, key))
    ends = [f(n, key).alias(f"{p}{n}") for p, f in (("a_", F.min_by), ("b_", F.max_by)) for n in box]
    per = placed(rows).groupBy(component).agg(F.count(F.lit(1)).alias("count"), F.min(key).alias("_low"), F.max(key).alias("_high"), *ends, F.bool_and("_plain").alias("_plain"), F.max("_w").alias("_w"), F.max("_h").alias("_h"))
    apart = c("count") == F.when(c("_low") == c("_high"), 1).otherwise(2)
    corners = [f"{p}{n}" for p in ("a_", "b_") for n in box]
    # without a number boxes have no closed form
    per = per.withColumn("a_minx", F.when(c("_plain") & apart, c("a_minx")))
    m, o = (U.grown(d, quarter, max(grow, wall))(*corners, "_w", "_h") for d in (grow, wall))
    per = materialize(per.select(component, "count", F.array_distinct(F.array("_low", "_high")).alias("members"), *corners, m.alias("m"), o.alias("o")), "upright")
    others = per.where("m IS NULL").select(component)
    known = per.where("m IS NOT NULL").withColumn("radius", U.grown_radius(grow, quarter)(*corners)).drop(*corners)
    if others.isEmpty():
        return known, None
    return known, materialize(placed(buildings.select(key, rings)).join(others.hint("merge"), component, "left_semi"), "structures")


def overlapping(polygons: DataFrame, key: str, size: float, rings: str = "rings") -> DataFrame:
    """(a, b, overlap) with a < b: pairs of any shape and the area they share."""
    own = plain_boxes(polygons.select(F.col(key).alias("id"), F.col(rings).alias("g")), "g")
    seen, others = P.extents(own, size, "_up")
    pairs = P.box_pairs(own.where("_up").drop("g", "_up"), "id", size, seen).where("id <> r_id").select(F.least("id", "r_id").alias("a"), F.greatest("id", "r_id").alias("b"), P.box_overlap().alias("overlap"))
    if others:
        rest = P.uneven_joins(own, own, size, "_up", K.shared_area("g", "r_g"), "overlap").where("id < r_id")
        pairs = pairs.unionByName(rest.select(F.col("id").alias("a"), F.col("r_id").alias("b"), "overlap"))
    return pairs.where("overlap > 1e-6")


#: Regions up to which each polygon is compared with all of them.
FEW_REGIONS = 16


def intersecting(polygons: DataFrame, regions: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """Rows of ``polygons`` that share area with any region: boxes first, then the exact overlay where one of the two is not its box.

    A few regions are part of the plan: one pass over the polygons tells what their boxes tell, and only
    the rest, if there is any, is joined.
    """
    areas = plain_boxes(regions.select(F.col(rings).alias("g")), "g")
    few = areas.select(F.coalesce("_up", F.lit(False)), *P._BOX).limit(FEW_REGIONS + 1).collect()
    if len(few) > FEW_REGIONS:
        return _intersecting(polygons, areas, size, rings)
    own = plain_boxes(polygons.select(F.struct("*").alias("_row"), F.col(rings).alias("g")), "g")
    side = lambda lo, hi: F.least(F.col(hi), F.lit(r[hi])) - F.greatest(F.col(lo), F.lit(r[lo]))
    sure, unsure, up = F.lit(False), F.lit(False), F.coalesce("_up", F.lit(False))
    for plain, *box in few:
        if None not in box:
            r = dict(zip(P._BOX, box))
            dx, dy = side("minx", "maxx"), side("miny", "maxy")
            unsure |= (dx >= 0) & (dy >= 0) & (~up if plain else F.lit(True))
            if plain:
                sure |= up & (dx > 0) & (dy > 0) & (dx * dy > 1e-9)
    sure = F.coalesce(sure, F.lit(False))
    hit, rest = own.where(sure).select("_row.*"), own.where(~sure & unsure).select("_row.*")
    return hit if rest.isEmpty() else hit.unionByName(_intersecting(rest, areas, size, rings))


def _intersecting(polygons: DataFrame, areas: DataFrame, size: float, rings: str) -> DataFrame:
    own = plain_boxes(polygons.withColumn("_n", F.monotonically_increasing_id()), rings)
    own = materialize(own, "numbered")
    near = P.split_join(own.select("_n", F.col(rings).alias("g"), "minx", "miny", "maxx", "maxy", "_up"), areas, size, "_up", P.box_overlap(), K.shared_area("g", "r_g"), "overlap")
    hit = near.where("overlap > 1e-9").select("_n").distinct()
    return own.join(hit, "_n", "left_semi").select(*polygons.columns)


def _merged(polygons: DataFrame, key: str, links: DataFrame, rings: str, tile: float | None) -> DataFrame:
    """(key, rings): linked polygons as one, under their smallest key; parts beyond the first get no row of their own."""
    comps = connected_components(links).select(F.col("node").alias(key), "component")
    joined = polygons.select(key, rings).join(comps, key)
    whole = dissolve(joined, ["component"], rings, tile).select(F.col("component").alias(key), rings)
    return polygons.select(key, rings).join(comps, key, "left_anti").unionByName(whole)


def merge_overlaps(polygons: DataFrame, key: str, size: float, merge_limit: float = 25.0, overlap_limit: float = 0.1, rings: str = "rings") -> DataFrame:
    """(key, rings): a polygon joins those it overlaps if it is small or shares ``overlap_limit`` of its area."""
    area = polygons.select(F.col(key).alias("id"), G.polygon_area(F.col(rings)).alias("area"))
    pairs = overlapping(polygons, key, size, rings)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    ask = both.join(area.withColumnRenamed("id", "a"), "a")
    links = ask.where((F.col("area") < merge_limit) | (F.col("overlap") >= overlap_limit * F.col("area"))).select("a", "b")
    return _merged(polygons, key, links, rings, size)


def trim_overlaps(polygons: DataFrame, key: str, size: float, rings: str = "rings") -> DataFrame:
    """(key, rings): what is left of each polygon once the smaller ones it overlaps are cut out.

    Of two of equal area the one with the larger key gives way. Parts become rows of the same key;
    a polygon cut away as a whole goes.
    """
    area = polygons.select(F.col(key).alias("id"), G.polygon_area(F.col(rings)).alias("area"), F.col(rings).alias("g"))
    pairs = overlapping(polygons, key, size, rings)
    side = lambda c: area.select(F.col("id").alias(c), F.col("area").alias(f"area_{c}"), F.col("g").alias(f"g_{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    gives = F.when((F.col("area_a") > F.col("area_b")), F.lit(True)).otherwise(F.lit(False))
    cuts = full.select(F.when(gives, F.col("a")).otherwise(F.col("b")).alias(key), F.when(gives, F.col("g_b")).otherwise(F.col("g_a")).alias("_cut"))
    knives = dissolve(cuts, [key], "_cut", size).groupBy(key).agg(F.collect_list("_cut").alias("_cuts"))

    cut = polygons.select(key, rings).join(knives, key).select(key, F.explode(K.without(rings, "_cuts")).alias(rings))
    return polygons.select(key, rings).join(knives.select(key), key, "left_anti").unionByName(cut)


def segments_of(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(id, ax, ay, bx, by): one row for each edge of each ring."""
    edges = polygons.select(F.col(key).alias("id"), F.explode(rings).alias("r")).select("id", F.explode(G.segments(F.col("r"))).alias("s"))
    return edges.select("id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax <> bx OR ay <> by")


def shared_walls(polygons: DataFrame, key: str, size: float, tolerance: float = 0.15, rings: str = "rings") -> DataFrame:
    """(focal, neighbor, length): how long two rims run along each other, at most ``tolerance`` apart.

    Edges that are parallel up to a few degrees are compared: the stretch of the one that lies
    beside the other counts. Both directions are given.
    """
    e = segments_of(polygons, key, rings)
    e = e.withColumns({"minx": F.least("ax", "bx") - tolerance / 2, "maxx": F.greatest("ax", "bx") + tolerance / 2, "miny": F.least("ay", "by") - tolerance / 2, "maxy": F.greatest("ay", "by") + tolerance / 2})
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("r_bx") - c("r_ax"), c("r_by") - c("r_ay")
    size_a, size_b = F.sqrt(dx * dx + dy * dy), F.sqrt(ex * ex + ey * ey)
    along = lambda x, y: ((c(x) - c("ax")) * dx + (c(y) - c("ay")) * dy) / size_a
    off = lambda x, y: F.abs((c(x) - c("ax")) * dy - (c(y) - c("ay")) * dx) / size_a
    shared = F.least(F.greatest(along("r_ax", "r_ay"), along("r_bx", "r_by")), size_a) - F.greatest(F.least(along("r_ax", "r_ay"), along("r_bx", "r_by")), F.lit(0.0))
    parallel = F.abs(dx * ey - dy * ex) <= 0.05 * size_a * size_b
    beside = (off("r_ax", "r_ay") <= tolerance) & (off("r_bx", "r_by") <= tolerance)
    pairs = P.box_join(e, e, size).where((c("id") != c("r_id")) & parallel & beside & (shared > 1e-9))
    return pairs.groupBy(c("id").alias("focal"), c("r_id").alias("neighbor")).agg(F.sum(shared).alias("length"))


def merge_touching(polygons: DataFrame, key: str, size: float, which: DataFrame, rings: str = "rings") -> DataFrame:
    """(key, rings): each polygon of ``which`` joins the neighbour of the longest shared wall, the smaller key on a tie."""
    walls = shared_walls(polygons, key, size, 1e-6, rings).join(which.select(F.col(key).alias("focal")), "focal", "left_semi")
    links = walls.groupBy("focal").agg(F.min(F.struct((-F.round("length", 6)).alias("l"), "neighbor")).alias("m")).select(F.col("focal").alias("a"), F.col("m.neighbor").alias("b"))
    return _merged(polygons, key, links, rings, size)


def collapsing(polygons: DataFrame, key: str, distance: float = 0.5, quarter: int = 2, rings: str = "rings") -> DataFrame:
    """Keys of polygons of which nothing is left when they shrink by ``distance``."""
    return polygons.select(key, F.size(K.buffered(-distance, quarter)(rings)).alias("_n")).where("_n = 0").select(key)


def clean_footprints(buildings: DataFrame, key: str = "id", size: float = 50.0, most: float = 200_000.0, tolerance: float | None = 0.1, merge_limit: float = 25.0, rings: str = "rings") -> DataFrame:
    """Valid single polygons without overlaps or slivers: (key, rings), keys numbered anew where parts were split."""
    valid = buildings.select(key, F.explode(K.made_valid(rings)).alias(rings))
    if tolerance:
        valid = valid.select(key, K.simplified_rings(tolerance)(rings).alias(rings))
    fresh = lambda df: materialize(df.where((F.size(F.col(rings)) > 0) & (G.polygon_area(F.col(rings)) > 0)).withColumn("_n", F.monotonically_increasing_id()).select(F.col("_n").alias(key), rings), "clean")
    small = fresh(valid.where(G.polygon_area(F.col(rings)) < most))
    apart = fresh(trim_overlaps(fresh(merge_overlaps(small, key, size, merge_limit, 0.1, rings)), key, size, rings))
    whole = fresh(merge_touching(apart, key, size, collapsing(apart, key, rings=rings), rings))
    return whole.select(key, K.normalized(rings).alias(rings))


def away_from_lines(buildings: DataFrame, lines: DataFrame, key: str, distance: float, size: float, rings: str = "rings", line: str = "line") -> DataFrame:
    """Buildings no line comes nearer to than ``distance``."""
    b = boxed(buildings.select(F.col(key).alias("id"), F.col(rings).alias("g")), "g", distance)
    box = G.bounds(F.col(line))
    s = lines.select(F.col(line).alias("line"), box["minx"].alias("minx"), box["miny"].alias("miny"), box["maxx"].alias("maxx"), box["maxy"].alias("maxy"))
    hit = P.box_join(b, s, size).where(K.line_distance("g", "r_line") <= distance).select(F.col("id").alias(key)).distinct()
    return buildings.join(hit, key, "left_anti")


def merge_estates(buildings: DataFrame, estates: DataFrame, key: str, size: float, area: float = 180.0, perimeter: float = 55.0, gap: float = 1e-3, rings: str = "rings") -> DataFrame:
    """Large buildings inside estates that touch become one: (key, rings)."""
    large = buildings.where((G.polygon_area(F.col(rings)) > area) & (G.length(F.col(rings)[0]) > perimeter))
    point = K.representative_point(rings)
    inside = P.points_in_polygons(large.select(key, point.alias("_p")).select(key, F.col("_p.x").alias("x"), F.col("_p.y").alias("y")), estates.select(F.col(rings)[0].alias("ring")), size).select(key).distinct()
    links = near_pairs(large.join(inside, key, "left_semi"), key, 2 * gap, size, rings).select(F.col("focal").alias("a"), F.col("neighbor").alias("b"))
    return _merged(buildings, key, links, rings, size)


def enclosures(streets: DataFrame, limits: DataFrame, by: Sequence[str], line: str = "line", rings: str = "rings") -> DataFrame:
    """(by, part, rings): faces of the plane cut by a region's streets and its limit; dead ends bound nothing.

    One task holds one region's lines: faces depend on all of them.
    """
    by = list(by)
    rim = limits.select(*by, F.explode(rings).alias(line))
    drawn = streets.select(*by, line).unionByName(rim)
    schema = T.StructType([*(drawn.schema[k] for k in by), T.StructField("part", T.IntegerType()), T.StructField(rings, K.RINGS_TYPE)])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        faces = O.faces([K.S._xy(x) for x in t.column(line).to_pylist()])
        cols = [pa.array([k.as_py()] * len(faces), k.type) for k in key]
        return pa.table([*cols, pa.array(range(len(faces)), pa.int32()), pa.array([K.from_polygon([f]) for f in faces], K.ARROW_RINGS)], names=[*by, "part", rings])

    return drawn.groupBy(*by).applyInArrow(run, schema)


def adaptive_limit(points: DataFrame, radii: DataFrame, key: str, by: Sequence[str] = (), x: str = "x", y: str = "y", quarter: int = 8) -> DataFrame:
    """The union of each point's circle: (by, part, rings)."""
    turn = [6.283185307179586 * i / (4 * quarter) for i in range(4 * quarter + 1)]
    round_ = F.array(*(G.point(F.col(x) + F.col("radius") * F.cos(F.lit(t)), F.col(y) + F.col("radius") * F.sin(F.lit(t))) for t in turn[:-1]), G.point(F.col(x) + F.col("radius"), F.col(y) + 0 * F.col("radius")))
    circles = points.join(radii, key).where("radius > 0").withColumn("_all", F.lit(0)).select(*by, "_all", F.array(round_).alias("rings"))
    return dissolve(circles, [*by, "_all"]).drop("_all")


def touching_cells(cells: DataFrame, key: str, centroids: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """Tessellation cleanup: dissolve by id, split, keep the part that holds the building's point (or any of an
    empty cell), one row an id."""
    parts = dissolve(cells, [key], rings, size)
    at = centroids.select(F.col(key).alias("_id"), "x", "y")
    hits = parts.join(at, parts[key] == at["_id"]).where(G.contains_point(F.col(rings)[0], F.col("x"), F.col("y"))).select(key, "part", rings)
    kept = hits.unionByName(parts.where(F.col(key) < 0))
    return kept.groupBy(key).agg(F.min_by(rings, "part").alias(rings))


def uncovered(buildings: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Buildings without a cell: to be dropped before the tessellation is made again."""
    return buildings.join(cells.select(key), key, "left_anti")


def nearest_line(polygons: DataFrame, lines: DataFrame, key: str, line_key: str, size: float, rings: str = "rings", line: str = "line", max_distance: float | None = None) -> DataFrame:
    """(key, line_key, distance): the line nearest to each polygon's rim, the smaller key on a tie.

    An upright rim and a straight line along an axis whose boxes are apart are as far as these; only
    the other pairs are measured in Python.
    """
    box = G.bounds(F.col(line))
    target = lines.select(F.col(line_key), F.col(line).alias("_line"), box["minx"].alias("minx"), box["miny"].alias("miny"), box["maxx"].alias("maxx"), box["maxy"].alias("maxy")).where("_line IS NOT NULL")
    pending = polygons.select(key, F.col(rings).alias("_g")).where("_g IS NOT NULL").withColumn("_b", G.bounds(F.col("_g")[0]))
    if target.isEmpty() or pending.isEmpty():
        return polygons.sparkSession.createDataFrame([], T.StructType([polygons.schema[key], lines.schema[line_key], T.StructField("distance", T.DoubleType())]))

    def ask(rows: DataFrame, reach: float) -> DataFrame:
        pairs = P.box_join(boxed(rows, "_g", reach), target, max(size, reach))
        gap = lambda lo, hi: F.greatest(F.greatest(f"_b.{lo}", f"r_{lo}") - F.least(f"_b.{hi}", f"r_{hi}"), F.lit(0.0))
        apart = F.hypot(gap("minx", "maxx"), gap("miny", "maxy"))
        exact = F.coalesce(G.upright(F.col("_g")[0]) & G.along_axis(F.col("r__line")) & (apart > 0), F.lit(False))
        measured = K.line_distance(F.when(~exact, F.col("_g")), F.when(~exact, F.col("r__line")))
        pairs = pairs.withColumn("distance", F.coalesce(F.when(exact, apart), measured))
        best = pairs.where(F.col("distance") <= reach).groupBy(key).agg(F.min(F.struct("distance", F.col(f"r_{line_key}").alias(line_key))).alias("_m"))
        return best.select(key, f"_m.{line_key}", "_m.distance")

    return P.widening(pending, key, size, ask, max_distance)


def point_square(x: Column, y: Column, half: float) -> Column:
    """A point's buffer with a square cap."""
    return F.array(G.rectangle(x - half, y - half, F.lit(2.0 * half), F.lit(2.0 * half)))
