"""Cleaning of street lines: gaps, overshoots, clustered junctions, junctions that join two lines only.

Lines are ``array<struct<x,y>>`` with a bigint key. Every step is a join on places; only the lines of
one merged street meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions.polygons import ARROW_POINT
from morphloom.functions.scalar import is_long_tunnel
from morphloom.operators import network
from morphloom.operators import spatial as P
from morphloom.operators.components import connected_components
from morphloom.storage import materialize

LINE = "array<struct<x:double,y:double>>"
_LINES = pa.list_(ARROW_POINT)


def ends_of(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(id, last, x, y): both ends of each line; ``last`` tells which."""
    both = F.explode(F.array(F.struct(F.lit(False).alias("last"), F.col(line)[0].alias("p")), F.struct(F.lit(True).alias("last"), F.element_at(line, -1).alias("p")))).alias("e")
    return lines.select(F.col(key).alias("id"), both).select("id", "e.last", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def _moved(lines: DataFrame, key: str, line: str, places: DataFrame) -> DataFrame:
    """Lines whose ends stand where ``places`` (id, last, nx, ny) says; lines left without length go."""
    at = lambda flag, n: places.where(F.col("last") == flag).select(F.col("id").alias(key), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias(n))
    out = lines.join(at(False, "_a"), key, "left").join(at(True, "_b"), key, "left")
    inner = F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(0)))
    made = F.concat(F.array(F.coalesce("_a", F.col(line)[0])), inner, F.array(F.coalesce("_b", F.element_at(line, -1))))
    return out.withColumn(line, made).drop("_a", "_b").where(G.length(F.col(line)) > 0)


def consolidate(lines: DataFrame, key: str, tolerance: float, line: str = "line", which: Column | None = None) -> DataFrame:
    """Line ends that are chained within ``tolerance`` become one place, their mean; ``which`` limits the ends (by degree)."""
    ends = materialize(ends_of(lines, key, line), "ends")
    spots = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))
    spots = materialize((spots if which is None else spots.where(which)).withColumn("spot", F.monotonically_increasing_id()), "spots")
    near = P.within_distance(spots.select("spot", "x", "y"), spots.select("spot", "x", "y"), tolerance).where("spot < r_spot").select("spot", "r_spot")
    comps = connected_components(near, "spot", "r_spot").select(F.col("node").alias("spot"), "component")
    joined = spots.join(comps, "spot")
    middle = joined.groupBy("component").agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
    to = joined.join(middle, "component").select("x", "y", "nx", "ny")
    return _moved(lines, key, line, ends.join(to, ["x", "y"]).select("id", "last", "nx", "ny"))


def close_gaps(lines: DataFrame, key: str, tolerance: float, line: str = "line") -> DataFrame:
    """Dead ends within ``tolerance`` of each other are joined at their mean."""
    return consolidate(lines, key, tolerance, line, F.col("degree") == 1)


def extend(lines: DataFrame, key: str, distance: float, line: str = "line") -> DataFrame:
    """Dead ends go on straight to the nearest other line that lies within ``distance`` ahead."""
    ends = materialize(ends_of(lines, key, line), "ends")
    dead = ends.join(ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("x", "y"), ["x", "y"], "left_semi")
    before = lines.select(F.col(key).alias("id"), F.array(F.struct(F.lit(False).alias("last"), F.col(line)[1].alias("q")), F.struct(F.lit(True).alias("last"), F.element_at(line, -2).alias("q"))).alias("e")).select("id", F.explode("e").alias("e")).select("id", "e.last", "e.q")
    c = F.col
    ray = dead.join(before, ["id", "last"]).withColumn("_l", F.hypot(c("x") - c("q.x"), c("y") - c("q.y"))).where("_l > 0")
    ray = ray.select("id", "last", "x", "y", ((c("x") - c("q.x")) / c("_l")).alias("dx"), ((c("y") - c("q.y")) / c("_l")).alias("dy"))
    ray = ray.withColumns({"minx": F.least("x", c("x") + distance * c("dx")), "maxx": F.greatest("x", c("x") + distance * c("dx")), "miny": F.least("y", c("y") + distance * c("dy")), "maxy": F.greatest("y", c("y") + distance * c("dy"))})
    s = lines.select(F.col(key).alias("id"), F.explode(G.segments(F.col(line))).alias("s")).select("id", c("s.a.x").alias("ax"), c("s.a.y").alias("ay"), c("s.b.x").alias("bx"), c("s.b.y").alias("by"))
    s = s.withColumns({"minx": F.least("ax", "bx"), "maxx": F.greatest("ax", "bx"), "miny": F.least("ay", "by"), "maxy": F.greatest("ay", "by")})
    ex, ey, wx, wy = c("r_bx") - c("r_ax"), c("r_by") - c("r_ay"), c("r_ax") - c("x"), c("r_ay") - c("y")
    cross = c("dx") * ey - c("dy") * ex
    hit = P.box_join(ray, s, distance).where("id <> r_id").withColumns({"_t": F.try_divide(wx * ey - wy * ex, cross), "_u": F.try_divide(wx * c("dy") - wy * c("dx"), cross)})
    hit = hit.where(c("_t").between(0.0, distance) & c("_u").between(0.0, 1.0)).groupBy("id", "last").agg(F.min(F.struct("_t", (c("x") + c("_t") * c("dx")).alias("nx"), (c("y") + c("_t") * c("dy")).alias("ny"))).alias("m"))
    return _moved(lines, key, line, hit.select("id", "last", "m.nx", "m.ny"))


def split_at_junctions(lines: DataFrame, key: str, line: str = "line", size: float = 100.0) -> DataFrame:
    """Lines cut wherever another line ends on them: (key, line), keys numbered anew."""
    s = lines.select(F.col(key).alias("id"), F.posexplode(G.segments(F.col(line))).alias("k", "s")).select("id", "k", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    boxed = s.withColumns({"minx": F.least("a.x", "b.x"), "maxx": F.greatest("a.x", "b.x"), "miny": F.least("a.y", "b.y"), "maxy": F.greatest("a.y", "b.y")})
    spots = ends_of(lines, key, line).select("x", "y").distinct().withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})
    on = P.box_join(boxed, spots, size).withColumn("d", G.point_segment_distance(F.col("r_x"), F.col("r_y"), F.col("a"), F.col("b"))).where("d < 1e-6")
    cuts = on.select("id", "k", F.hypot(F.col("r_x") - F.col("a.x"), F.col("r_y") - F.col("a.y")).alias("t"), F.struct(F.col("r_x").alias("x"), F.col("r_y").alias("y")).alias("p"), F.lit(True).alias("cut"))
    every = s.select("id", "k", F.lit(0.0).alias("t"), F.col("a").alias("p"), F.lit(False).alias("cut")).unionByName(cuts)
    last = s.groupBy("id").agg(F.max_by(F.struct((F.col("k") + 1).alias("k"), F.col("b").alias("p")), "k").alias("e")).select("id", "e.k", F.lit(0.0).alias("t"), "e.p", F.lit(False).alias("cut"))
    points = every.unionByName(last).groupBy("id", "k", "t", "p").agg(F.max("cut").alias("cut")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "t", "cut", "p"))).alias("ps"))

    def run(table: pa.Table) -> pa.Table:
        out = []
        for ps in table.column("ps").to_pylist():
            piece = []
            for i, q in enumerate(ps):
                if piece and q["p"] == piece[-1]:
                    if q["cut"] and len(piece) > 1:
                        out.append(piece)
                        piece = [q["p"]]
                    continue
                piece.append(q["p"])
                if q["cut"] and i and len(piece) > 1:
                    out.append(piece)
                    piece = [q["p"]]
            if len(piece) > 1:
                out.append(piece)
        return pa.table([pa.array(out, _LINES)], names=["line"])

    def batches(given):
        for b in given:
            yield from run(pa.Table.from_batches([b])).to_batches()

    cut = points.select("ps").mapInArrow(batches, f"line {LINE}")
    return materialize(cut.select(F.monotonically_increasing_id().alias(key), F.col("line").alias(line)), "pieces")


def chained(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined end to end at shared ends, as far as exactly two of them meet; a ring closes on itself."""
    left = [list(map(tuple, p)) for p in parts]
    done = []
    while left:
        now = left.pop()
        grown = True
        while grown and now[0] != now[-1]:
            grown = False
            for tail in (True, False):
                end = now[-1] if tail else now[0]
                meet = [i for i, p in enumerate(left) if end in (p[0], p[-1])]
                if len(meet) == 1:
                    p = left.pop(meet[0])
                    p = p if (p[0] == end) == tail else p[::-1]
                    now = now + p[1:] if tail else p[:-1] + now
                    grown = True
                    break
        done.append(np.array(now))
    return done


def remove_false_nodes(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, line): lines that meet at a place no third line ends at become one, under their smallest key."""
    _, edges = network.network(lines, key, line)
    street = network.merge_degree_two(edges, key)

    def run(group: tuple, t: pa.Table) -> pa.Table:
        merged = chained([np.array([(p["x"], p["y"]) for p in v]) for v in t.column(line).to_pylist()])
        rows = [[{"x": float(x), "y": float(y)} for x, y in m] for m in merged]
        return pa.table([pa.array([group[0].as_py()] * len(rows), pa.int64()), pa.array(rows, _LINES)], names=[key, line])

    joined = lines.select(F.col(key).cast("bigint").alias(key), line).join(street, key)
    return joined.select("street", line).groupBy("street").applyInArrow(run, f"{key} bigint, {line} {LINE}")


def simplify_streets(lines: DataFrame, key: str = "id", tolerance: float = 7.0, line: str = "line") -> DataFrame:
    """(key, line): tunnels go, gaps close, clustered junctions become one, false junctions vanish."""
    if "road_flags" in lines.columns:
        lines = lines.where(~is_long_tunnel(F.col("road_flags"), G.length(F.col(line))))
    closed = close_gaps(lines.select(F.col(key).cast("bigint").alias(key), line), key, tolerance, line)
    return remove_false_nodes(consolidate(closed, key, tolerance, line), key, line)
