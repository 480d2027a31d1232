"""Enclosed tessellation on a grid: each cell of an enclosure goes to its nearest building.

A general Voronoi diagram of outlines needs a geometry kernel; on a grid of stated resolution it
is a nearest-neighbour join of grid points to outline points, so it scales with the area and
needs no task to hold an enclosure. Areas are exact up to the resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.operators import spatial as P
from morphloom.operators.components import connected_components


def outline_points(buildings: DataFrame, step: float, key: str = "id", ring: str = "ring") -> DataFrame:
    """Points along each outline, at most ``step`` apart."""
    seg = buildings.select(F.col(key).alias("building"), F.explode(G.segments(F.col(ring))).alias("s"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")) / step).cast("int"))
    at = seg.select("building", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), n.alias("n"))
    part = lambda c: F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * F.col("i") / F.col("n")
    return at.select("building", part("x").alias("x"), part("y").alias("y")).distinct()


def grid_points(enclosures: DataFrame, step: float, key: str = "eID", ring: str = "ring") -> DataFrame:
    """Centres of the grid cells inside each enclosure, aligned to one grid for all."""
    b = enclosures.withColumn("_b", G.bounds(F.col(ring)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"_b.{lo}") / step).cast("bigint"), F.floor(F.col(f"_b.{hi}") / step).cast("bigint"))
    cells = b.select(key, ring, F.explode(span("minx", "maxx")).alias("cx"), span("miny", "maxy").alias("_ys")).select(key, ring, "cx", F.explode("_ys").alias("cy"))
    centre = lambda c: (F.col(c) + 0.5) * step
    cells = cells.withColumns({"x": centre("cx"), "y": centre("cy")})
    return cells.where(G.contains_point(F.col(ring), F.col("x"), F.col("y"))).select(key, "cx", "cy", "x", "y")


def tessellate(buildings: DataFrame, enclosures: DataFrame, step: float, reach: float) -> DataFrame:
    """(eID, building, cx, cy): grid cells by nearest outline within ``reach``; -1 without one."""
    grid = grid_points(enclosures, step).withColumn("cell", F.concat_ws(" ", "cx", "cy"))
    outline = outline_points(buildings, step).withColumn("point", F.struct("building", "x", "y"))
    hit = P.nearest(grid.dropDuplicates(["cell"]), outline, "cell", "point", step, reach)
    out = grid.join(hit.select("cell", F.col("point.building").alias("building")), "cell", "left")
    return out.select("eID", F.coalesce("building", F.lit(-1)).alias("building"), "cx", "cy")


def cell_areas(tessellation: DataFrame, step: float) -> DataFrame:
    return tessellation.groupBy("eID", "building").agg((F.count(F.lit(1)) * F.lit(step * step)).alias("area"))


def cell_contiguity(tessellation: DataFrame) -> DataFrame:
    """Cells that share a grid edge: (focal, neighbor, weight = shared edges)."""
    own = tessellation.select("building", "cx", "cy").where("building >= 0")
    sides = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    shifted = own.select(F.col("building").alias("focal"), F.explode(sides).alias("s")).select("focal", "s.cx", "s.cy")
    pairs = shifted.join(own.withColumnRenamed("building", "neighbor"), ["cx", "cy"]).where("focal <> neighbor")
    return pairs.groupBy("focal", "neighbor").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def adaptive_radius(gabriel: DataFrame, share: float = 0.6, most: float = 100.0) -> DataFrame:
    """Buffer radius of each building: a share of its longest Gabriel edge, at most ``most``."""
    ends = gabriel.select(F.explode(F.array("focal", "neighbor")).alias("id"), "weight")
    radius: Column = F.least(F.lit(most), share * F.max("weight"))
    return ends.groupBy("id").agg(radius.alias("radius"))


def merge_groups(buildings: DataFrame, overlaps: DataFrame, merge_limit: float = 25.0, share: float = 0.1) -> DataFrame:
    """(id, part_of): buildings that overlap another by ``share``, or overlap and are small, merge."""
    area = buildings.select("id", G.area(F.col("ring")).alias("area"))
    joined = overlaps.where("id <> r_id").join(area, "id")
    links = joined.where((F.col("area") < merge_limit) | (F.col("overlap") / F.col("area") >= share)).select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    comps = connected_components(links)
    return buildings.select("id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("part_of"))


def away_from_lines(buildings: DataFrame, lines: DataFrame, distance: float, size: float) -> DataFrame:
    """Buildings with no line within ``distance`` of their outline points."""
    points = outline_points(buildings, max(distance, size / 20)).withColumn("p", F.monotonically_increasing_id())
    near = P.nearest_segment(points, lines, "p", "id", size)
    hit = points.join(near.where(F.col("distance") <= distance), "p").select(F.col("building").alias("id")).distinct()
    return buildings.join(hit, "id", "left_anti")
