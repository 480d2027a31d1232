"""Catalogue: spatial joins, geometry and clustering. Points are the first two embedding components;
rectangles and L-shapes come from the parts' sizes and prices, so that truth has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions import scalar as S
from morphloom.functions.shapes import shape_chars
from morphloom.operators import cluster as C
from morphloom.operators import spatial as P
from morphloom.storage import table as T

QUERIES, SQL = {}, {}

POINTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
#: Every part as a rectangle, spread over the points by its key.
BOXES = "b AS (SELECT p_partkey AS id, ((p_partkey * 37) % 1009) / 252.0 - 2 AS minx, ((p_partkey * 101) % 997) / 249.0 - 2 AS miny, p_size / 500.0 AS w, p_retailprice / 20000.0 AS h FROM part)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark, d):
    e = T(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def boxes(spark, d):
    k = F.col("p_partkey")
    b = T(spark, d, "part").select(k.alias("id"), ((k * 37) % 1009 / 252.0 - 2).alias("minx"), ((k * 101) % 997 / 249.0 - 2).alias("miny"), (F.col("p_size") / 500.0).alias("w"), (F.col("p_retailprice") / 20000.0).alias("h"))
    return b.select("id", "w", "h", G.rectangle(F.col("minx"), F.col("miny"), F.col("w"), F.col("h")).alias("ring"))


@query(f"WITH {POINTS} SELECT a.id, b.id AS r_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.04 * 0.04")
def dwithin_pairs(spark, d):
    p = points(spark, d).select("id", "x", "y")
    return P.within_distance(p, p, 0.04).where("id < r_id").select("id", "r_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {POINTS}, j AS (SELECT a.id, b.id AS core, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM p a JOIN p b ON a.label <> 0 AND b.label = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, core) AS r FROM j) SELECT id, core, round(dist, 6) AS distance FROM r WHERE r = 1""")
def nearest_core(spark, d):
    p = points(spark, d)
    out = P.nearest(p.where("label <> 0"), p.where("label = 0").withColumnRenamed("id", "core"), "id", "core", 0.1)
    return out.select("id", "core", F.round("distance", 6).alias("distance"))


@query(f"WITH {POINTS}, {BOXES} SELECT p.id, b.id AS r_id FROM p JOIN b ON x >= minx AND x < minx + w AND y >= miny AND y < miny + h")
def pip_rect_join(spark, d):
    return P.points_in_polygons(points(spark, d), boxes(spark, d), 0.5).select("id", "r_id")


@query(f"""WITH {POINTS}, {BOXES}, j AS (SELECT p.id, b.id AS r_id, w * h AS area FROM p JOIN b ON x >= minx AND x < minx + w AND y >= miny AND y < miny + h)
    SELECT id, r_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(area, 9), r_id) AS r FROM j) t WHERE r = 1""")
def smallest_area_match(spark, d):
    b = boxes(spark, d).withColumn("area", F.round(F.col("w") * F.col("h"), 9))
    return P.smallest_match(P.points_in_polygons(points(spark, d), b, 0.5), "id", "r_area", "r_id").select("id", "r_id")


@query(f"""WITH {BOXES}, j AS (SELECT a.id, b.id AS r_id, (least(a.minx + a.w, b.minx + b.w) - greatest(a.minx, b.minx)) * (least(a.miny + a.h, b.miny + b.h) - greatest(a.miny, b.miny)) AS overlap
    FROM b a JOIN b ON a.id <> b.id AND least(a.minx + a.w, b.minx + b.w) > greatest(a.minx, b.minx) AND least(a.miny + a.h, b.miny + b.h) > greatest(a.miny, b.miny))
    SELECT id, r_id, round(overlap, 9) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(overlap, 9) DESC, r_id) AS r FROM j WHERE round(overlap, 9) > 0) t WHERE r = 1""")
def overlap_largest(spark, d):
    return P.largest_overlaps(boxes(spark, d), "id", 0.5, 9)


@query(f"WITH {POINTS}, r AS (SELECT DISTINCT CAST(floor(x / 0.25) AS BIGINT) AS cx, CAST(floor(y / 0.25) AS BIGINT) AS cy FROM p) SELECT label AS zone, sum(cx * 10 + cy) AS sum, round(avg(cx * 10 + cy), 6) AS mean, count(*) AS n FROM p JOIN r ON CAST(floor(x / 0.25) AS BIGINT) = cx AND CAST(floor(y / 0.25) AS BIGINT) = cy GROUP BY 1")
def raster_zonal(spark, d):
    p = points(spark, d)
    raster = p.select(P.cell(F.col("x"), 0.25).alias("cx"), P.cell(F.col("y"), 0.25).alias("cy")).distinct().withColumn("value", F.col("cx") * 10 + F.col("cy"))
    out = P.zonal(raster, p.withColumnRenamed("label", "zone"), 0.25)
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""WITH {POINTS}, h AS (SELECT id, (sqrt(3.0) / 3 * x - y / 3) / 0.2 AS q, 2.0 / 3 * y / 0.2 AS r FROM p), c AS (SELECT *, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h),
    o AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM c)
    SELECT id, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS INTEGER) AS hq, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS INTEGER) AS hr FROM o""")
def hexagon_cells(spark, d):
    q, r = S.hex_cell(F.col("x"), F.col("y"), 0.2)
    return points(spark, d).select("id", q.alias("hq"), r.alias("hr"))


def _proximity_sql(blocked: str) -> str:
    return f"""WITH {POINTS}, g AS (SELECT a.id, b.id AS r_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM p a JOIN p b ON a.id <> b.id)
        SELECT id AS focal, r_id AS neighbor FROM g WHERE id < r_id AND NOT EXISTS (SELECT 1 FROM g k JOIN g l ON k.r_id = l.r_id WHERE k.id = g.id AND l.id = g.r_id AND {blocked})"""


@query(_proximity_sql("k.d + l.d < g.d"))
def gabriel_edges(spark, d):
    return P.proximity_graph(points(spark, d), "id", "gabriel", 0.08).select("focal", "neighbor")


@query(_proximity_sql("greatest(k.d, l.d) < g.d"))
def rng_edges(spark, d):
    return P.proximity_graph(points(spark, d), "id", "rng", 0.08).select("focal", "neighbor")


KNN = """n AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(v.embedding[i] AS DOUBLE)) ** 2))) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM n)"""


def neighbours(spark, d, k):
    e = T(spark, d, "embeddings")
    return P.knn(e, e, "vec_id", "embedding", k)


@query(f"WITH {KNN} SELECT query_id, rank, id, round(distance, 5) AS distance FROM r WHERE rank <= 10")
def knn_embeddings(spark, d):
    return neighbours(spark, d, 10).select("query_id", "rank", "id", F.round("distance", 5).alias("distance"))


@query(f"WITH {KNN}, v AS (SELECT query_id, CAST(label AS VARCHAR) AS label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM v) t WHERE k = 1")
def knn_vote(spark, d):
    return C.knn_vote(neighbours(spark, d, 5), T(spark, d, "embeddings"), "vec_id", "label")


@query(f"""WITH RECURSIVE {POINTS}, g AS (SELECT a.id, b.id AS r_id FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.05 * 0.05), cores AS (SELECT id FROM g GROUP BY 1 HAVING count(*) >= 4),
    ce AS (SELECT g.* FROM g WHERE id IN (SELECT * FROM cores) AND r_id IN (SELECT * FROM cores)), w AS (SELECT id AS node, id AS c FROM cores UNION SELECT ce.r_id, w.c FROM w JOIN ce ON ce.id = w.node),
    cl AS (SELECT node AS id, min(c) AS cluster FROM w GROUP BY 1), bo AS (SELECT g.id, min(r_id) AS r_id FROM g WHERE r_id IN (SELECT * FROM cores) AND id NOT IN (SELECT * FROM cores) GROUP BY 1),
    f AS (SELECT * FROM cl UNION ALL SELECT bo.id, cl.cluster FROM bo JOIN cl ON bo.r_id = cl.id) SELECT p.id, coalesce(f.cluster, -1) AS cluster FROM p LEFT JOIN f ON p.id = f.id""")
def dbscan_points(spark, d):
    return C.dbscan(points(spark, d), "id", 0.05, 4)


@query("SELECT p_partkey, round(p_size * p_retailprice, 4) AS area, round(2 * (p_size + p_retailprice), 4) AS perimeter, round(p_size / 2.0, 6) AS cx, round(p_retailprice / 2, 6) AS cy, 4 AS corners, 0.0 AS squareness, round(p_size * p_retailprice / (pi() * (p_size ** 2 + p_retailprice ** 2) / 4), 6) AS compactness, round(least(p_size, p_retailprice) / greatest(p_size, p_retailprice), 6) AS elongation FROM part")
def polygon_shape_chars(spark, d):
    ring = G.rectangle(F.lit(0.0), F.lit(0.0), F.col("p_size"), F.col("p_retailprice"))
    p = T(spark, d, "part").select("p_partkey", ring.alias("ring")).withColumn("s", shape_chars("ring"))
    c = G.centroid(F.col("ring"))
    return p.select(
        "p_partkey", F.round(G.area(F.col("ring")), 4).alias("area"), F.round(G.length(F.col("ring")), 4).alias("perimeter"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"),
        G.corners(F.col("ring")).alias("corners"), F.round(G.squareness(F.col("ring")), 6).alias("squareness"), F.round(G.circular_compactness(G.area(F.col("ring")), F.col("s.radius")), 6).alias("compactness"), F.round("s.elongation", 6).alias("elongation"),
    )


@query("SELECT p_partkey, round(p_size * 2.0 + p_size * p_retailprice, 4) AS area, round(2 * (2 * p_size + p_retailprice + 1), 4) AS perimeter, 6 AS corners, round(p_size * p_retailprice, 4) AS courtyard FROM part")
def l_shapes_and_courtyards(spark, d):
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice")
    l_ring = F.array(G.point(F.lit(0), F.lit(0)), G.point(2 * w, F.lit(0)), G.point(2 * w, F.lit(1)), G.point(w, F.lit(1)), G.point(w, h + 1), G.point(F.lit(0), h + 1), G.point(F.lit(0), F.lit(0)))
    outer, hole = G.rectangle(F.lit(-1.0), F.lit(-1.0), w + 2, h + 2), G.rectangle(F.lit(0.0), F.lit(0.0), w, h)
    p = T(spark, d, "part").select("p_partkey", l_ring.alias("l"), F.array(outer, hole).alias("rings"))
    return p.select("p_partkey", F.round(G.area(F.col("l")), 4).alias("area"), F.round(G.length(F.col("l")), 4).alias("perimeter"), G.corners(F.col("l")).alias("corners"), F.round(G.courtyard_area(F.col("rings")), 4).alias("courtyard"))


@query(None)
def hdbscan_leaves(spark, d):
    """Contiguity-constrained Ward in each component of the 5-nearest-neighbour graph."""
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(64)))
    near = P.knn(T(spark, d, "embeddings"), T(spark, d, "embeddings"), "vec_id", "embedding", 5)
    edges = near.select(F.least("query_id", "id").alias("focal"), F.greatest("query_id", "id").alias("neighbor")).distinct()
    both = edges.unionByName(edges.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor")))
    return C.cluster_components(e, both, "id", [f"c{i}" for i in range(64)], 10)


@query("""WITH t AS (SELECT label AS a, CAST(floor(embedding[1] * 4) AS BIGINT) AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a) x) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b) x) AS b, (SELECT sum(n) FROM t) AS n)
    SELECT round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM s""")
def ari(spark, d):
    e = T(spark, d, "embeddings").select(F.col("label").alias("a"), F.floor(F.col("embedding")[0] * 4).alias("b"))
    return C.adjusted_rand(e, "a", "b").select(F.round("ari", 9).alias("ari"))


@query("""WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), m AS (SELECT label, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p GROUP BY 1), s AS (SELECT label, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s, sum((x - mx) ** 2 + (y - my) ** 2) AS w FROM p JOIN m USING (label) GROUP BY 1), a AS (SELECT * FROM m JOIN s USING (label)),
    r AS (SELECT a.label, max((a.s + b.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS r FROM a JOIN a b ON a.label <> b.label GROUP BY 1), o AS (SELECT avg(x) AS ox, avg(y) AS oy FROM p)
    SELECT round((SELECT avg(r) FROM r), 5) AS davies_bouldin, round((SELECT sum(n * ((mx - ox) ** 2 + (my - oy) ** 2)) FROM a, o) / (SELECT sum(w) FROM a) * ((SELECT count(*) FROM p) - (SELECT count(*) FROM a)) / ((SELECT count(*) FROM a) - 1), 5) AS calinski_harabasz""")
def davies_bouldin_calinski(spark, d):
    s = C.internal_scores(points(spark, d), "label", ["x", "y"])
    return spark.createDataFrame([(round(s["davies_bouldin"], 5), round(s["calinski_harabasz"], 5))], "davies_bouldin double, calinski_harabasz double")


@query("""WITH t AS (SELECT label AS a, CAST(floor(embedding[1] * 4) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS s FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS s FROM t GROUP BY 1), tot AS (SELECT sum(n) AS n FROM t),
    mi AS (SELECT sum(t.n / tot.n * ln(t.n * tot.n / (ra.s * rb.s))) AS v FROM t JOIN ra USING (a) JOIN rb USING (b), tot), h AS (SELECT (SELECT -sum(s / n * ln(s / n)) FROM ra, tot) AS ha, (SELECT -sum(s / n * ln(s / n)) FROM rb, tot) AS hb),
    k AS (SELECT x, y, n, unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1)) AS k FROM (SELECT ra.s AS x, rb.s AS y FROM ra, rb) c, tot),
    e AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1.0) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS v FROM k)
    SELECT round((mi.v - e.v) / ((ha + hb) / 2 - e.v), 6) AS ami FROM mi, h, e""")
def ami(spark, d):
    t = C.contingency(T(spark, d, "embeddings").select(F.col("label").alias("a"), F.floor(F.col("embedding")[0] * 4).alias("b")), "a", "b")
    return C.adjusted_mutual_information_of(t, "a", "b").select(F.round("ami", 6).alias("ami"))
