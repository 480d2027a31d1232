"""Catalogue: evaluation of groupings, patches of graphs, and scans of partitioned releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions.scalar import rounded
from morphloom.operators import aggregates as A
from morphloom.operators import evaluate as E
from morphloom.operators import graph, learn
from morphloom.operators import polygons as P
from morphloom.operators import spatial as S
from morphloom.plans.pack_context import _LLOYD
from morphloom.plans.pack_graph import LINES, PARTS, lines, parts
from morphloom.plans.pack_spatial import BOXES, KNN, POINTS, boxes, neighbours, points
from morphloom.plans.pack_town import TOWN, buildings, cells, enclosures
from morphloom.sources import readers
from morphloom.storage import fresh_path, materialize
from morphloom.storage import table as T

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH f AS (SELECT l_returnflag, l_quantity, l_extendedprice / 1000 AS price, l_discount * 100 AS discount, l_tax * 100 AS tax FROM lineitem),
    g AS (SELECT median(l_quantity) AS quantity, median(price) AS price, median(discount) AS discount, median(tax) AS tax FROM f),
    m AS (SELECT l_returnflag, pow(median(l_quantity) - any_value(g.quantity), 2) AS quantity, pow(median(f.price) - any_value(g.price), 2) AS price, pow(median(f.discount) - any_value(g.discount), 2) AS discount, pow(median(f.tax) - any_value(g.tax), 2) AS tax FROM f, g GROUP BY 1),
    l AS (UNPIVOT m ON quantity, price, discount, tax INTO NAME char VALUE deviation)
    SELECT l_returnflag, char, round(deviation, 6) AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY deviation DESC, char) AS r FROM l) z WHERE r <= 2""")
def deviating_features(spark, d):
    f = T(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"))
    return E.deviating_features(f, "l_returnflag", ["quantity", "price", "discount", "tax"], 2).withColumn("deviation", F.round("deviation", 6))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def hashed_sample(spark, d):
    return E.hashed_sample(T(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query(f"""WITH {LINES}, l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'own_' || s_suppkey ELSE 'nation_' || s_nationkey % 5 END AS label FROM supplier), one AS (SELECT label FROM l GROUP BY 1 HAVING count(*) = 1),
    c AS (SELECT e.focal, x.label, count(*) AS n FROM e JOIN l ON e.focal = l.s_suppkey AND l.label IN (SELECT label FROM one) JOIN l x ON e.neighbor = x.s_suppkey GROUP BY 1, 2), m AS (SELECT focal, label FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY n DESC, label) AS r FROM c) z WHERE r = 1)
    SELECT l.s_suppkey, coalesce(m.label, l.label) AS label FROM l LEFT JOIN m ON m.focal = l.s_suppkey""")
def settle_singletons(spark, d):
    s = T(spark, d, "supplier")
    label = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("own_"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("nation_"), (F.col("s_nationkey") % 5).cast("string")))
    return E.settle_singletons(s.select("s_suppkey", label.alias("label")), lines(spark, d), "s_suppkey", "label").select("s_suppkey", "label")


@query(f"""WITH {LINES}, n AS (SELECT focal, neighbor FROM e UNION SELECT s_suppkey, s_suppkey FROM supplier), k AS (SELECT focal, count(DISTINCT s_nationkey) > 1 AS a, count(DISTINCT s_nationkey // 8) > 1 AS b FROM n JOIN supplier ON neighbor = s_suppkey GROUP BY 1)
    SELECT 'fine' AS level, round(avg(CASE WHEN a THEN 1.0 ELSE 0 END), 9) AS share FROM k UNION ALL SELECT 'coarse', round(avg(CASE WHEN b THEN 1.0 ELSE 0 END), 9) FROM k""")
def split_share(spark, d):
    labels = T(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("fine"), F.floor(F.col("s_nationkey") / 8).alias("coarse"))
    return E.split_share(labels, lines(spark, d), "s_suppkey", ["fine", "coarse"]).select("level", F.round("share", 9).alias("share"))


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_size, [0.1, 0.9]) AS s, quantile_cont(p_retailprice, [0.1, 0.9]) AS r FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN q USING (p_brand) WHERE p_size BETWEEN s[1] AND s[2] AND p_retailprice BETWEEN r[1] AND r[2]""")
def percentile_band(spark, d):
    return E.percentile_band(T(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"]).select("p_partkey")


@query("""SELECT 'p_size' AS char, round((max(p_size) - min(p_size)) / stddev_samp(p_size), 6) AS range_in_std, min(p_size) = quantile_cont(p_size, 0.25) AS flat_start FROM part UNION ALL SELECT 'p_retailprice', round((max(p_retailprice) - min(p_retailprice)) / stddev_samp(p_retailprice), 6), min(p_retailprice) = quantile_cont(p_retailprice, 0.25) FROM part""")
def column_diagnostics(spark, d):
    return E.diagnostics(T(spark, d, "part"), ["p_size", "p_retailprice"]).withColumn("range_in_std", F.round("range_in_std", 6))


@query("""WITH g AS (SELECT label, vec_id, embedding AS e FROM embeddings) SELECT a.label, round(median(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.e[i] AS DOUBLE) - CAST(b.e[i] AS DOUBLE)) ** 2)))), 6) AS median FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def median_pair_distance(spark, d):
    return E.median_pair_distance(T(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("median", 6).alias("median"))


@query("""WITH c AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings GROUP BY 1) SELECT a.label AS a, b.label AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance FROM c a JOIN c b ON a.label < b.label""")
def class_distances(spark, d):
    profiles = points(spark, d).groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return E.class_distances(profiles, "label", ["x", "y"]).withColumn("distance", F.round("distance", 9))


@query(f"""WITH RECURSIVE {KNN}, k AS (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, distance FROM r WHERE rank <= 10), e AS (SELECT DISTINCT a, b FROM k WHERE distance <= 1.05), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    w AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.node), m AS (SELECT node, min(c) AS component FROM w GROUP BY 1), s AS (SELECT component, count(*) AS n FROM m GROUP BY 1), t AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) - 1 AS patch FROM s)
    SELECT node AS vec_id, CAST(CASE WHEN patch < 5 THEN patch ELSE -1 END AS INTEGER) AS patch FROM m JOIN t USING (component)""")
def pruned_patches(spark, d):
    near = neighbours(spark, d, 10).select(F.least("query_id", "id").alias("focal"), F.greatest("query_id", "id").alias("neighbor")).distinct()
    return E.pruned_patches(near, T(spark, d, "embeddings"), "vec_id", "embedding", 1.05, 5)


@query(f"""WITH RECURSIVE {KNN}, e AS (SELECT query_id AS a, id AS b FROM r WHERE rank <= 3), w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a), m AS (SELECT w.a AS node, min(w.b) AS c FROM w JOIN w x ON x.a = w.b AND x.b = w.a GROUP BY 1)
    SELECT vec_id AS node, least(vec_id, coalesce(c, vec_id)) AS component FROM embeddings LEFT JOIN m ON node = vec_id""")
def strong_components(spark, d):
    return E.strong_components(neighbours(spark, d, 3), "query_id", "id")


@query(f"""WITH {POINTS} SELECT name, id FROM p JOIN (VALUES ('middle', 0.0, 0.0), ('east', 0.2, 0.0), ('south', 0.0, -0.2)) s(name, sx, sy) ON (x - sx) ** 2 + (y - sy) ** 2 <= 0.01""")
def validation_groups(spark, d):
    spots = spark.createDataFrame([("middle", 0.0, 0.0), ("east", 0.2, 0.0), ("south", 0.0, -0.2)], "name string, x double, y double")
    return E.validation_groups(points(spark, d), spots, 0.1)


@query(f"""WITH RECURSIVE {POINTS}, u AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.06 * 0.06), w AS (SELECT id, id AS c FROM p UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.id),
    m AS (SELECT id, min(c) AS c FROM w GROUP BY 1), s AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT m.id, CAST(label AS VARCHAR) || '_' || CASE WHEN n > 3 THEN CAST(c AS VARCHAR) ELSE '-1' END AS label FROM m JOIN s USING (c) JOIN p ON p.id = m.id""")
def relabel_by_distance(spark, d):
    return E.relabel_by_distance(points(spark, d), "id", "label", 0.06, 3)


@query("""WITH g AS (SELECT p_brand, min(p_size) AS coarse FROM part GROUP BY 1), m AS (SELECT p_brand AS grp, split_part(p_brand, '#', 2) AS fine, coarse FROM g), b AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'noise' ELSE p_brand END AS grp, split_part(p_brand, '#', 2) AS fine FROM part), f AS (SELECT fine, min(coarse) AS coarse FROM m GROUP BY 1)
    SELECT p_partkey, coalesce(m.coarse, f.coarse) AS coarse FROM b LEFT JOIN m USING (grp) LEFT JOIN f ON f.fine = b.fine""")
def crosswalk(spark, d):
    p = T(spark, d, "part")
    fine = F.split("p_brand", "#")[1]
    mapping = p.groupBy("p_brand").agg(F.min("p_size").alias("coarse")).select(F.col("p_brand").alias("grp"), fine.alias("fine"), "coarse")
    own = p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.lit("noise")).otherwise(F.col("p_brand")).alias("grp"), fine.alias("fine"))
    return E.crosswalk(own, mapping, "p_partkey", "grp", "fine", "coarse")


@query(f"""WITH {_LLOYD}, a AS (SELECT id, k FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, k) AS r FROM p, c5) z WHERE r = 1), s AS (SELECT k, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s FROM a JOIN p USING (id) JOIN (SELECT k, avg(x) AS cx, avg(y) AS cy FROM a JOIN p USING (id) GROUP BY 1) m USING (k) GROUP BY 1),
    m AS (SELECT k, avg(x) AS cx, avg(y) AS cy, sum(1) AS n, var_pop(x) * count(*) + var_pop(y) * count(*) AS sse FROM a JOIN p USING (id) GROUP BY 1)
    SELECT k AS cluster, CAST(n AS BIGINT) AS n, round(sse, 6) AS inertia FROM m""")
def inertia_of_kmeans(spark, d):
    centres = [(a, b) for a in (-0.1, 0.1) for b in (-0.1, 0.1)]
    got = learn.lloyd(points(spark, d), ["x", "y"], centres, 5)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(A.inertia(got, "cluster", ["x", "y"]), "cluster").select("cluster", "n", F.round("inertia", 6).alias("inertia"))


@query(f"""WITH {PARTS} SELECT focal, round(sum(2.0 * i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 6) AS gini, round(avg(v / m * ln(v / m)), 6) AS theil, round(max(v) - min(v), 4) AS spread
    FROM (SELECT focal, p_retailprice AS v, row_number() OVER (PARTITION BY focal ORDER BY p_retailprice) AS i, avg(p_retailprice) OVER (PARTITION BY focal) AS m FROM e JOIN part ON neighbor = p_partkey) x GROUP BY 1""")
def inequality_in_neighbourhoods(spark, d):
    near = parts(spark, d).join(T(spark, d, "part").select(F.col("p_partkey").alias("neighbor"), F.col("p_retailprice").alias("v")), "neighbor")
    out = A.gini(near, ["focal"], "v").join(near.groupBy("focal").agg((F.max("v") - F.min("v")).alias("spread")), "focal")
    return out.select("focal", *(F.round(c, n).alias(c) for c, n in (("gini", 6), ("theil", 6), ("spread", 4))))


@query(f"""WITH {TOWN}, s AS (SELECT b, count(*) AS n, sum(a) AS built, sum(CASE WHEN a > 30 THEN a ELSE 0 END) AS large FROM g GROUP BY 1)
    SELECT b AS "eID", n, round(built / 2200, 6) AS built_share, round(large / built, 6) AS large_share, round(2200 - built, 4) AS open FROM s""")
def enclosure_built_up(spark, d):
    """Built-up ratios of enclosures: what stands in each, by joining buildings to the enclosure that holds them."""
    b = buildings(spark, d)
    area = G.polygon_area(F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    at = b.select("id", area.alias("a"), G.centroid(F.col("ring")).alias("c")).select("id", "a", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    zones = enclosures(spark, d).withColumn("area", G.area(F.col("ring")))
    inside = S.points_in_polygons(at, zones, 110.0)
    out = inside.groupBy(F.col("r_eID").alias("eID")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("built"), F.sum(F.when(F.col("a") > 30, F.col("a")).otherwise(0.0)).alias("large"), F.first("r_area").alias("area"))
    return out.select("eID", "n", F.round(F.col("built") / F.col("area"), 6).alias("built_share"), F.round(F.col("large") / F.col("built"), 6).alias("large_share"), F.round(F.col("area") - F.col("built"), 4).alias("open"))


@query(f"""WITH {TOWN} SELECT n AS id, CASE WHEN bx + 10 * i + 5 BETWEEN 0 AND 300 AND by_ + 10 BETWEEN 0 AND 25 THEN 'west' WHEN bx + 10 * i + 5 BETWEEN 300 AND 700 AND by_ + 10 BETWEEN 0 AND 25 THEN 'east' ELSE 'country' END AS district FROM g""")
def district_names(spark, d):
    """Cells by the district that holds their centre, with a default name."""
    zones = spark.createDataFrame([("west", 0.0, 300.0), ("east", 300.0, 700.0)], "district string, x0 double, x1 double")
    zones = zones.select("district", G.rectangle(F.col("x0"), F.lit(0.0), F.col("x1") - F.col("x0"), F.lit(25.0)).alias("ring"))
    at = cells(spark, d).select("id", G.centroid(F.col("ring")).alias("c")).select("id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    hit = S.points_in_polygons(at, zones, 100.0).select("id", F.col("r_district").alias("district"))
    return at.select("id").join(hit, "id", "left").select("id", F.coalesce("district", F.lit("country")).alias("district"))


@query(f"""WITH {BOXES} SELECT id FROM b WHERE minx <= 0.9 AND minx + w >= -0.5 AND miny <= 0.7 AND miny + h >= -0.5 AND least(minx + w, 0.9) > greatest(minx, -0.5) AND least(miny + h, 0.7) > greatest(miny, -0.5)""")
def partitioned_region_scan(spark, d):
    """Features of one theme and type of a partitioned release, by box first and then by the exact region."""
    path = fresh_path(spark, "release")
    own = boxes(spark, d).select("id", F.array("ring").alias("rings"))
    both = own.withColumns({"theme": F.lit("transport"), "type": F.lit("segment")}).unionByName(own.withColumns({"theme": F.lit("buildings"), "type": F.lit("building")}))
    P.boxed(both).write.partitionBy("theme", "type").parquet(path)
    hull = spark.range(1).select(F.array(G.rectangle(F.lit(-0.5), F.lit(-0.5), F.lit(1.4), F.lit(1.2))).alias("rings"))
    return readers.read_region_features(spark, path, "transport", "segment", hull).select("id")


@query(f"""WITH {BOXES}, r AS (SELECT id % 2 AS region, id, minx, miny, w, h FROM b) SELECT region || '_' || id AS name, round(w * h, 9) AS area FROM r WHERE least(minx + w, 0.5) > greatest(minx, -0.5) AND least(miny + h, 0.5) > greatest(miny, -0.5)""")
def extract_inside_boundary(spark, d):
    """Features of several regions inside a boundary, named by region and id."""
    own = boxes(spark, d).select((F.col("id") % 2).alias("region"), "id", "w", "h", F.array("ring").alias("rings"))
    hull = spark.range(1).select(F.array(G.rectangle(F.lit(-0.5), F.lit(-0.5), F.lit(1.0), F.lit(1.0))).alias("rings"))
    hit = P.intersecting(own, hull, 0.5)
    return hit.select(F.concat_ws("_", F.col("region").cast("string"), F.col("id").cast("string")).alias("name"), F.round(F.col("w") * F.col("h"), 9).alias("area"))


@query(f"""WITH {BOXES}, j AS (SELECT a.id, b.id AS r_id, (least(a.minx + a.w, b.minx + b.w) - greatest(a.minx, b.minx)) * (least(a.miny + a.h, b.miny + b.h) - greatest(a.miny, b.miny)) AS o FROM b a JOIN b ON a.id < b.id AND least(a.minx + a.w, b.minx + b.w) > greatest(a.minx, b.minx) AND least(a.miny + a.h, b.miny + b.h) > greatest(a.miny, b.miny))
    SELECT id AS a, r_id AS b, round(o, 5) AS overlap FROM j WHERE o > 0.0001""")
def overlay_areas(spark, d):
    """Areas shared by pairs of polygons, by the general overlay."""
    own = boxes(spark, d).select("id", F.array("ring").alias("rings"))
    return P.overlapping(own, "id", 0.5).where("overlap > 0.0001").select("a", "b", rounded(F.col("overlap"), 5).alias("overlap"))


@query(f"""WITH {TOWN}, m AS (SELECT n, b, avg(a) OVER (PARTITION BY b) AS ma, stddev_samp(a) OVER (PARTITION BY b) AS sa FROM g)
    SELECT n AS id, round((SELECT avg(y.sa) FROM m x JOIN m y ON y.b = x.b AND abs(y.n - x.n) <= 3 WHERE x.n = m.n), 6) AS spread FROM m""")
def enclosure_spread_lag(spark, d):
    """Spread of building areas by enclosure, averaged over the cells within three steps."""
    from morphloom.plans.pack_town import cell_edges

    b = buildings(spark, d)
    area = G.polygon_area(F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    own = b.select("id", "eID", area.alias("a"))
    spread = materialize(own.join(own.groupBy("eID").agg(F.stddev_samp("a").alias("sa")), "eID").select("id", "sa"), "spread")
    loops = graph.with_self(cell_edges(spark, d), spread, "id")
    return graph.partial_apply(loops, 3, spread, "id", [F.round(F.avg("sa"), 6).alias("spread")]).select(F.col("focal").alias("id"), "spread")
