"""Catalogue: contexts, structures, noise, outlines, projection, sources and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from morphloom.functions import projection
from morphloom.functions import scalar as S
from morphloom.operators import context, graph, learn, outline, tessellation
from morphloom.operators import spatial as P
from morphloom.plans import taxonomy
from morphloom.plans.pack_graph import K3, LINES, SPARSE, lines, sparse
from morphloom.plans.pack_spatial import BOXES, POINTS, boxes, points
from morphloom.sources import readers, sinks
from morphloom.storage import fresh_path
from morphloom.storage import table as T
from morphloom.streaming import landing

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(K3 + " SELECT s_suppkey AS focal, round(quantile_cont(v, 0.05), 5) AS p5, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.95), 5) AS p95 FROM supplier LEFT JOIN (SELECT focal, x.s_acctbal AS v FROM r JOIN supplier x ON neighbor = x.s_suppkey) y ON focal = s_suppkey GROUP BY 1")
def context_khop_percentiles(spark, d):
    out = context.percentile_context(lines(spark, d), 3, T(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    return out.select("focal", *(F.round(f"s_acctbal__{p}", 5).alias(f"p{p}") for p in (5, 50, 95)))


def _at(spark, d):
    s = T(spark, d, "supplier")
    return s.select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 17).cast("double").alias("x"), (F.col("s_suppkey") % 23).cast("double").alias("y"))


def _weighted_sql(pairs: str, weight: str) -> str:
    """Weighted median and quartile range over distances, for the SQL twins."""
    at = ", ".join(f"coalesce(max(CASE WHEN mid <= {p} AND nx > {p} THEN v + ({p} - mid) / (nx - mid) * (up - v) END), max(CASE WHEN fa > {p} THEN fv END), max(v)) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"""a AS (SELECT s_suppkey AS k, s_suppkey % 17 AS x, s_suppkey % 23 AS y, s_acctbal AS v FROM supplier),
    p AS (SELECT focal, b.v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM {pairs} JOIN a ON focal = a.k JOIN a b ON neighbor = b.k), wide AS (SELECT focal, max(dist) AS far FROM p WHERE dist > 0 GROUP BY 1),
    q AS (SELECT p.focal, v, dist, {weight} AS w FROM p JOIN wide ON p.focal = wide.focal WHERE dist > 0),
    o AS (SELECT *, (sum(w) OVER (PARTITION BY focal ORDER BY v, w ROWS UNBOUNDED PRECEDING) - 0.5 * w) / sum(w) OVER (PARTITION BY focal) AS mid FROM q),
    n AS (SELECT *, lead(mid) OVER x AS nx, lead(v) OVER x AS up, first_value(mid) OVER x AS fa, first_value(v) OVER x AS fv FROM o WINDOW x AS (PARTITION BY focal ORDER BY mid, v)),
    z AS (SELECT focal, {at} FROM n GROUP BY 1) SELECT focal, round(p50, 4) AS median, round(p75 - p25, 4) AS iqr FROM z"""


@query(f"WITH {LINES}, {_weighted_sql('e', '1 / dist')}")
def context_kernel_weighted(spark, d):
    out = context.weighted_context(lines(spark, d), 1, _at(spark, d), "s_suppkey", ["s_acctbal"], "inverse")
    return out.select("focal", F.round("median", 4).alias("median"), F.round("iqr", 4).alias("iqr"))


@query(f"{K3}, {_weighted_sql('r', 'exp(-pow(dist / far / 2, 2)) / (sqrt(2) * pi())')}")
def context_kernel_gaussian(spark, d):
    out = context.weighted_context(lines(spark, d), 3, _at(spark, d), "s_suppkey", ["s_acctbal"], "gaussian")
    return out.select("focal", F.round("median", 4).alias("median"), F.round("iqr", 4).alias("iqr"))


@query(f"""WITH {LINES}, f2 AS (SELECT * FROM e UNION SELECT a.focal, b.neighbor FROM e a JOIN e b ON a.neighbor = b.focal), g AS (SELECT focal AS a, neighbor AS b, CAST(abs(focal - neighbor) AS DOUBLE) AS dist FROM e WHERE focal < neighbor)
    SELECT x.focal, round(avg(dist), 6) AS mean FROM f2 x JOIN g ON x.neighbor = a JOIN f2 y ON y.focal = x.focal AND y.neighbor = b GROUP BY 1""")
def mean_pair_distance(spark, d):
    e = lines(spark, d)
    gaps = e.where("focal < neighbor").select("focal", "neighbor", F.abs(F.col("focal") - F.col("neighbor")).cast("double").alias("distance"))
    return context.mean_pair_distance(e, gaps, 2).select("focal", F.round("mean", 6).alias("mean"))


@query(f"WITH {LINES} SELECT focal, round(avg(abs(a.s_acctbal - b.s_acctbal)), 5) AS diff FROM e JOIN supplier a ON focal = a.s_suppkey JOIN supplier b ON neighbor = b.s_suppkey GROUP BY 1")
def neighbour_difference(spark, d):
    out = context.neighbour_difference(lines(spark, d), T(spark, d, "supplier"), "s_suppkey", "s_acctbal", "diff")
    return out.select("focal", F.round("diff", 5).alias("diff"))


@query("WITH " + SPARSE + " SELECT a AS focal, b AS neighbor FROM e")
def adjacency_lists(spark, d):
    lists = sparse(spark, d).groupBy("focal").agg(F.collect_set("neighbor").alias("neighbors"))
    return graph.from_adjacency(lists, "focal", "neighbors").select("focal", "neighbor")


@query("""WITH l AS (SELECT o_custkey AS component, o_orderkey AS id, o_orderstatus || CASE WHEN o_totalprice < 100000 THEN '_-1' ELSE '_1' END AS label FROM orders),
    c AS (SELECT component, label, count(*) AS n FROM l GROUP BY 1, 2), m AS (SELECT component, label FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY label LIKE '%-1', n DESC, label) AS r FROM c) t WHERE r = 1) SELECT id, m.label FROM l JOIN m USING (component)""")
def settle_structures(spark, d):
    label = S.morph_label(F.col("o_orderstatus"), F.when(F.col("o_totalprice") < 100000, F.lit("-1")).otherwise(F.lit("1")))
    own = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("component"), label.alias("label"))
    return taxonomy.settle_structures(own.select("id", "label"), own.select("id", "component"), "id")


@query("WITH RECURSIVE " + SPARSE + """, r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b), m AS (SELECT node, least(min(c), node) AS c FROM r GROUP BY node),
    o AS (SELECT p_partkey, p_size % 3 AS region, coalesce(c, p_partkey) AS c FROM part LEFT JOIN m ON node = p_partkey), k AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY c) AS k FROM o) SELECT p_partkey, region || '_' || k || '_-1' AS label FROM k""")
def unique_noise_labels(spark, d):
    cells = T(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("region"))
    return taxonomy.unique_noise_labels(cells, sparse(spark, d), "p_partkey", "region")


CLASSES = "k AS (SELECT p_brand AS label, median(p_size) AS a, median(p_retailprice) AS b FROM part GROUP BY 1)"


@query(f"""WITH {CLASSES}, g AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), u AS (SELECT a, b FROM k UNION ALL SELECT a, b FROM g), s AS (SELECT avg(a) ma, avg(b) mb, stddev_pop(a) sa, stddev_pop(b) sb FROM u),
    n AS (SELECT g.i, k.label, sqrt(((g.a - k.a) / sa) ** 2 + ((g.b - k.b) / sb) ** 2) AS dist FROM g, k, s), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, label DESC) AS r FROM n) SELECT i AS p_partkey, label FROM r WHERE r = 1""")
def noise_to_nearest_class(spark, d):
    part = T(spark, d, "part")
    classes = part.groupBy(F.col("p_brand").alias("label")).agg(F.median("p_size").alias("a"), F.median("p_retailprice").alias("b"))
    noise = part.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return taxonomy.assign_noise(noise, classes, "p_partkey", "label", ["a", "b"], 1)


@query(f"WITH {POINTS} SELECT label, round(min(x), 9) AS minx, round(min(y), 9) AS miny, round(max(x), 9) AS maxx, round(max(y), 9) AS maxy FROM p GROUP BY 1")
def hull_bounds(spark, d):
    from morphloom.functions import geometry as G

    b = outline.hulls(points(spark, d), "label").select("label", G.bounds(F.col("ring")).alias("b"))
    return b.select("label", *(F.round(f"b.{c}", 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def _equal_area_sql() -> str:
    f = 1 / projection.INVERSE_FLATTENING
    e = math.sqrt(2 * f - f * f)
    q = lambda s: f"({1 - e * e} * ({s} / (1 - {e * e} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / {2 * e}))"
    lat0 = math.radians(projection.ORIGIN_LAT)
    return f"""WITH p AS (SELECT vec_id, 10 + CAST(embedding[1] AS DOUBLE) * 5 AS lon, 52 + CAST(embedding[2] AS DOUBLE) * 5 AS lat FROM embeddings), s AS (SELECT *, sin(radians(lat)) AS s, {q("1.0")} AS qp, {q(f"sin({lat0})")} AS q0 FROM p),
        b AS (SELECT *, asin({q("s")} / qp) AS beta, asin(q0 / qp) AS beta0, {projection.SEMI_MAJOR} * sqrt(qp / 2) AS rq, radians(lon - {projection.ORIGIN_LON}) AS turn FROM s),
        d AS (SELECT *, {projection.SEMI_MAJOR} * cos({lat0}) / sqrt(1 - ({e} * sin({lat0})) ** 2) / (rq * cos(beta0)) AS d, rq * sqrt(2 / (1 + sin(beta0) * sin(beta) + cos(beta0) * cos(beta) * cos(turn))) AS b FROM b)
        SELECT vec_id, round({projection.FALSE_EAST} + b * d * cos(beta) * sin(turn), 3) AS x, round({projection.FALSE_NORTH} + b / d * (cos(beta0) * sin(beta) - sin(beta0) * cos(beta) * cos(turn)), 3) AS y FROM d"""


@query(_equal_area_sql())
def equal_area_projection(spark, d):
    e = T(spark, d, "embeddings")
    x, y = projection.to_equal_area(10 + F.col("embedding")[0].cast("double") * 5, 52 + F.col("embedding")[1].cast("double") * 5)
    return e.select("vec_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {BOXES} SELECT id FROM b WHERE minx <= 1 AND minx + w >= 0 AND miny <= 1 AND miny + h >= 0")
def release_box_scan(spark, d):
    """A release is written along a Z-order, then read back through its covering boxes."""
    path = fresh_path(spark, "release")
    sinks.write_release(boxes(spark, d).select("id", F.array("ring").alias("rings")), path, files=4)
    return readers.read_box(spark, path, (0.0, 0.0, 1.0, 1.0), ["id"])


@query("SELECT s_suppkey AS id, s_nationkey AS region, CAST(s_acctbal AS FLOAT) AS value FROM supplier")
def regions_written_once(spark, d):
    """Regions are written in two goes; what is there already is not written again."""
    path = fresh_path(spark, "regions")
    own = T(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("region"), F.col("s_acctbal").cast("float").alias("value"))
    sinks.write_missing_regions(own.where("region < 10"), path, "region")
    sinks.write_missing_regions(own, path, "region")
    return spark.read.parquet(path).select("id", F.col("region").cast("int").alias("region"), "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def landing_stream(spark, d):
    """Events taken up as a stream of files, then totalled over all batches."""
    out, schema = fresh_path(spark, "landed"), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    stream = landing.read_landing(spark, f"{d}/events.parquet*", schema)
    landing.run_stage(stream, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")), out, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id * 1000 END AS hits FROM pages")
def service_hit_count(spark, d):
    document = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<x numberMatched="'), F.col("page_id") * 1000, F.lit('">'))).otherwise(F.lit("<x>"))
    return T(spark, d, "pages").select("page_id", S.hit_count(document).alias("hits"))


@query(f"""WITH {POINTS}, g AS (SELECT a.id, b.id AS r_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM p a JOIN p b ON a.id <> b.id),
    ed AS (SELECT id, r_id, sqrt(d) AS w FROM g WHERE id < r_id AND NOT EXISTS (SELECT 1 FROM g k JOIN g l ON k.r_id = l.r_id WHERE k.id = g.id AND l.id = g.r_id AND k.d + l.d < g.d)) SELECT id, round(least(0.03, 0.6 * max(w)), 8) AS radius FROM (SELECT id, w FROM ed UNION ALL SELECT r_id, w FROM ed) t GROUP BY 1""")
def adaptive_radius(spark, d):
    edges = P.proximity_graph(points(spark, d), "id", "gabriel", 0.08)
    return tessellation.adaptive_radius(edges, 0.6, 0.03).select("id", F.round("radius", 8).alias("radius"))


@query(f"""WITH {BOXES}, c AS (SELECT id, minx AS x0, miny AS y0, minx + w AS x1, miny + h AS y1, w, h FROM b),
    s AS (SELECT id, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM c UNION ALL SELECT id, x1, y0, x1, y1 FROM c UNION ALL SELECT id, x1, y1, x0, y1 FROM c UNION ALL SELECT id, x0, y1, x0, y0 FROM c),
    n AS (SELECT *, greatest(1, ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 0.4)) AS n FROM s), o AS (SELECT DISTINCT id, ax + (bx - ax) * i / n AS x, ay + (by_ - ay) * i / n AS y FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i FROM n) z),
    g AS (SELECT cx, cy, (cx + 0.5) * 0.4 AS x, (cy + 0.5) * 0.4 AS y FROM (SELECT unnest(range(-7, 7)) AS cx) a, (SELECT unnest(range(-7, 7)) AS cy) d),
    r AS (SELECT g.cx, g.cy, o.id, row_number() OVER (PARTITION BY g.cx, g.cy ORDER BY sqrt((g.x - o.x) * (g.x - o.x) + (g.y - o.y) * (g.y - o.y)), o.id, o.x, o.y) AS r FROM g, o)
    SELECT 0 AS "eID", id AS building, round(count(*) * 0.4 * 0.4, 6) AS area FROM r WHERE r = 1 GROUP BY id""")
def enclosed_tessellation(spark, d):
    """Grid cells of one enclosure by nearest building outline, with their areas."""
    from morphloom.functions import geometry as G

    b = boxes(spark, d).select("id", "ring")
    around = spark.range(1).select(F.col("id").alias("eID"), G.rectangle(F.lit(-2.8), F.lit(-2.8), F.lit(5.6), F.lit(5.6)).alias("ring"))
    out = tessellation.cell_areas(tessellation.tessellate(b, around, 0.4, 20.0), 0.4)
    return out.select("eID", "building", F.round("area", 6).alias("area"))


_LLOYD = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c0 AS (SELECT * FROM (VALUES (0, -0.1, -0.1), (1, -0.1, 0.1), (2, 0.1, -0.1), (3, 0.1, 0.1)) v(k, cx, cy))" + "".join(
    f", a{i} AS (SELECT id, x, y, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, k) AS r FROM p, c{i}) z WHERE r = 1), c{i + 1} AS (SELECT k, avg(x) AS cx, avg(y) AS cy FROM a{i} GROUP BY k)" for i in range(5)
)


@query(f"WITH {_LLOYD} SELECT id, cluster FROM (SELECT id, k AS cluster, row_number() OVER (PARTITION BY id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, k) AS r FROM p, c5) z WHERE r = 1")
def kmeans_clusters(spark, d):
    """Five rounds of k-means from four stated centres."""
    centres = [(a, b) for a in (-0.1, 0.1) for b in (-0.1, 0.1)]
    return learn.lloyd(points(spark, d).select("id", "x", "y"), ["x", "y"], centres, 5).select("id", "cluster")


@query("SELECT round(avg(CASE WHEN o_orderstatus = upper(substr(o_orderpriority, 3, 1)) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM orders")
def label_agreement(spark, d):
    o = T(spark, d, "orders").select("o_orderstatus", F.upper(F.substring("o_orderpriority", 3, 1)).alias("guess"))
    return learn.agreement(o, "o_orderstatus", "guess").select(F.round("accuracy", 9).alias("accuracy"))
