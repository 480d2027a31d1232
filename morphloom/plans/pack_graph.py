"""Catalogue: neighbour graphs, k-step neighbourhoods and what is aggregated over them.

Dense graph: parts that share an order. Sparse graphs: parts with equal quantity in one order;
suppliers of lines with the same part, quantity, discount and tax.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from morphloom.operators import aggregates as A
from morphloom.operators import graph as G
from morphloom.operators.components import connected_components
from morphloom.storage import table as T

QUERIES, SQL = {}, {}

#: Edges of the two graphs, for the SQL twins.
PARTS = """e AS (SELECT DISTINCT a.l_partkey AS focal, b.l_partkey AS neighbor FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey)"""
LINES = """e AS (SELECT DISTINCT a.l_suppkey AS focal, b.l_suppkey AS neighbor FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax WHERE a.l_suppkey <> b.l_suppkey)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def parts(spark, d):
    return G.shared_value_edges(T(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def lines(spark, d):
    via = F.struct("l_partkey", "l_quantity", "l_discount", "l_tax")
    return G.shared_value_edges(T(spark, d, "lineitem").select("l_suppkey", via.alias("via")), "l_suppkey", "via")


@query(f"WITH {PARTS} SELECT focal, neighbor, 1.0 AS weight FROM e")
def contiguity_edges(spark, d):
    return parts(spark, d)


@query(f"WITH {PARTS} SELECT focal, neighbor FROM e UNION ALL SELECT p_partkey, p_partkey FROM part")
def self_weight(spark, d):
    return G.with_self(parts(spark, d), T(spark, d, "part"), "p_partkey").select("focal", "neighbor")


@query(f"WITH {PARTS} SELECT focal, round(sum(p_retailprice), 4) AS area, count(*) AS n, round(avg(p_size), 6) AS mean FROM e JOIN part ON neighbor = p_partkey GROUP BY 1")
def graph_describe_1hop(spark, d):
    aggs = [F.round(F.sum("p_retailprice"), 4).alias("area"), F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size"), 6).alias("mean")]
    return G.neighbourhood(parts(spark, d), T(spark, d, "part"), "p_partkey", aggs)


K3 = f"""WITH {LINES}, f2 AS (SELECT DISTINCT a.focal, b.neighbor FROM e a JOIN e b ON a.neighbor = b.focal), f3 AS (SELECT DISTINCT a.focal, b.neighbor FROM f2 a JOIN e b ON a.neighbor = b.focal),
    r AS (SELECT * FROM e UNION SELECT * FROM f2 UNION SELECT * FROM f3)"""


@query(K3 + " SELECT s_suppkey AS focal, round(sum(v), 4) AS total, count(DISTINCT nation) AS nations, round(coalesce(stddev_samp(v), 0), 6) AS sd FROM supplier LEFT JOIN (SELECT focal, s2.s_acctbal AS v, s2.s_nationkey AS nation FROM r JOIN supplier s2 ON r.neighbor = s2.s_suppkey) x ON x.focal = s_suppkey GROUP BY 1")
def khop3_sum_nunique_std(spark, d):
    aggs = [F.round(F.sum("s_acctbal"), 4).alias("total"), F.countDistinct("s_nationkey").alias("nations"), F.round(F.coalesce(F.stddev_samp("s_acctbal"), F.lit(0.0)), 6).alias("sd")]
    out = G.partial_apply(lines(spark, d), 3, T(spark, d, "supplier"), "s_suppkey", aggs)
    return out.select("focal", "total", F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("sd", F.lit(0.0)).alias("sd"))


@query(K3 + " SELECT s_suppkey AS focal, CAST(sum(n) AS BIGINT) AS items, round(sum(s), 2) AS total FROM supplier LEFT JOIN (SELECT focal, n, s FROM r JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1) i ON r.neighbor = i.l_suppkey) x ON x.focal = s_suppkey GROUP BY 1")
def reached_agg(spark, d):
    aggs = [F.sum("_n").alias("items"), F.round(F.sum("_s"), 2).alias("total")]
    return G.reached(lines(spark, d), 3, T(spark, d, "lineitem"), "l_suppkey", "l_quantity", aggs, T(spark, d, "supplier"), "s_suppkey")


@query(f"WITH {LINES}, w AS (SELECT focal, neighbor, 1.0 / count(*) OVER (PARTITION BY focal) AS weight FROM e) SELECT focal, neighbor, round(weight, 9) AS weight FROM w")
def row_standardise(spark, d):
    return G.row_standardise(lines(spark, d)).select("focal", "neighbor", F.round("weight", 9).alias("weight"))


@query(f"WITH {LINES} SELECT s_suppkey AS focal, round(sum(v), 4) AS lag FROM supplier LEFT JOIN (SELECT focal, x.s_acctbal AS v FROM e JOIN supplier x ON neighbor = x.s_suppkey) y ON focal = s_suppkey GROUP BY 1")
def graph_lag(spark, d):
    return G.lag(lines(spark, d), T(spark, d, "supplier"), "s_suppkey", "s_acctbal").select("focal", F.round("lag", 4).alias("lag"))


@query(f"""WITH {LINES}, z AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS z FROM supplier),
    l AS (SELECT focal, avg(z) AS lz FROM e JOIN z ON neighbor = s_suppkey GROUP BY 1) SELECT s_suppkey AS focal, round(z * coalesce(lz, 0), 6) AS moran FROM z LEFT JOIN l ON focal = s_suppkey""")
def moran_local(spark, d):
    return G.local_moran(lines(spark, d), T(spark, d, "supplier"), "s_suppkey", "s_acctbal").select("focal", F.round("moran", 6).alias("moran"))


SPARSE = """e AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_quantity WHERE a.l_partkey <> b.l_partkey)"""


def sparse(spark, d):
    via = F.struct("l_orderkey", "l_quantity")
    return G.shared_value_edges(T(spark, d, "lineitem").select("l_partkey", via.alias("via")), "l_partkey", "via")


@query(f"WITH RECURSIVE {SPARSE}, r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b) SELECT node, least(min(c), node) AS component FROM r GROUP BY node")
def components(spark, d):
    return connected_components(sparse(spark, d), "focal", "neighbor")


@query(f"""WITH RECURSIVE {SPARSE}, r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b), c AS (SELECT node, least(min(c), node) AS component FROM r GROUP BY node),
    s AS (SELECT component, count(*) AS size, sum(p_size) AS total FROM c JOIN part ON node = p_partkey GROUP BY 1) SELECT node, size, CAST(total AS BIGINT) AS total FROM c JOIN s USING (component)""")
def component_stats_broadcast(spark, d):
    comps = connected_components(sparse(spark, d), "focal", "neighbor")
    part = T(spark, d, "part")
    stats = comps.join(part, comps["node"] == part["p_partkey"]).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("p_size").alias("total"))
    return comps.join(stats, "component").select("node", "size", "total")


@query(f"WITH {PARTS}, k AS (SELECT p_partkey FROM part WHERE p_size > 25) SELECT focal, neighbor FROM e WHERE focal IN (SELECT * FROM k) AND neighbor IN (SELECT * FROM k)")
def subgraph_filter(spark, d):
    return G.subgraph(parts(spark, d), T(spark, d, "part").where("p_size > 25"), "p_partkey").select("focal", "neighbor")


@query("WITH " + SPARSE + " SELECT p_partkey AS focal FROM part WHERE p_partkey NOT IN (SELECT a FROM e)")
def isolates(spark, d):
    return G.isolates(sparse(spark, d), T(spark, d, "part"), "p_partkey")


@query("WITH " + SPARSE + " SELECT p_partkey AS focal, count(b) AS n FROM part LEFT JOIN e ON a = p_partkey GROUP BY 1")
def cardinalities(spark, d):
    return G.cardinalities(sparse(spark, d), T(spark, d, "part"), "p_partkey")


@query("SELECT node, count(*) AS degree FROM (SELECT o_custkey % 50 AS node FROM orders UNION ALL SELECT (o_orderkey // 10) % 50 FROM orders) t GROUP BY 1")
def node_degree(spark, d):
    orders = T(spark, d, "orders")
    return G.degree(orders.select((F.col("o_custkey") % 50).alias("a"), (F.expr("o_orderkey div 10") % 50).alias("b")), "a", "b")


@query("""WITH s AS (SELECT o_custkey % 50 AS a, (o_orderkey // 10) % 50 AS b, o_totalprice AS len FROM orders)
    SELECT node, round(avg(len), 4) AS mean_length FROM (SELECT a AS node, len FROM s UNION ALL SELECT b, len FROM s WHERE a <> b) t GROUP BY 1""")
def mean_node_dist(spark, d):
    orders = T(spark, d, "orders")
    s = orders.select((F.col("o_custkey") % 50).alias("a"), (F.expr("o_orderkey div 10") % 50).alias("b"), F.col("o_totalprice").alias("len"))
    return G.mean_incident_length(s, "a", "b", "len").select("node", F.round("mean_length", 4).alias("mean_length"))


@query("WITH " + SPARSE + """, d AS (SELECT a AS v, count(*) AS d FROM e GROUP BY 1), p AS (SELECT x.a AS v, x.b AS u, y.b AS w FROM e x JOIN e y ON x.a = y.a WHERE x.b < y.b), c AS (SELECT u, w, count(*) AS c FROM p GROUP BY 1, 2),
    f AS (SELECT p.v, c - 1 AS q, CASE WHEN e.a IS NULL THEN 0 ELSE 1 END AS t, du.d AS du, dw.d AS dw FROM p JOIN c USING (u, w) LEFT JOIN e ON e.a = p.u AND e.b = p.w JOIN d du ON du.v = p.u JOIN d dw ON dw.v = p.w)
    SELECT d.v AS node, round(coalesce(sum(q) / nullif(sum((du - 1 - q - t) + (dw - 1 - q - t) + q), 0), 0), 9) AS clustering FROM d LEFT JOIN f ON d.v = f.v GROUP BY 1""")
def square_clustering(spark, d):
    return G.square_clustering(sparse(spark, d)).select("node", F.round("clustering", 9).alias("clustering"))


@query(f"""WITH {LINES}, {", ".join(f"f{i} AS (SELECT DISTINCT a.focal, b.neighbor FROM {'e' if i == 2 else f'f{i - 1}'} a JOIN e b ON a.neighbor = b.focal)" for i in range(2, 6))},
    r AS (SELECT * FROM e UNION SELECT * FROM f2 UNION SELECT * FROM f3 UNION SELECT * FROM f4 UNION SELECT * FROM f5 UNION SELECT focal, focal FROM e),
    v AS (SELECT focal, count(*) AS v FROM r GROUP BY 1), x AS (SELECT r.focal, count(*) AS m FROM r JOIN e ON r.neighbor = e.focal AND e.focal < e.neighbor JOIN r r2 ON r2.focal = r.focal AND r2.neighbor = e.neighbor GROUP BY 1)
    SELECT v.focal, round((coalesce(m, 0) - v + 1) / (2.0 * v - 5), 9) AS meshedness FROM v LEFT JOIN x ON v.focal = x.focal""")
def meshedness(spark, d):
    return G.meshedness(lines(spark, d), 5).select("focal", F.round("meshedness", 9).alias("meshedness"))


@query(f"""WITH {PARTS}, v AS (SELECT focal, p_retailprice AS value, CAST(p_size AS DOUBLE) AS w FROM e JOIN part ON neighbor = p_partkey),
    o AS (SELECT *, (sum(w) OVER (PARTITION BY focal ORDER BY value, w ROWS UNBOUNDED PRECEDING) - 0.5 * w) / sum(w) OVER (PARTITION BY focal) AS mid FROM v),
    n AS (SELECT *, lead(mid) OVER x AS nx, lead(value) OVER x AS up, first_value(mid) OVER x AS fa, first_value(value) OVER x AS fv FROM o WINDOW x AS (PARTITION BY focal ORDER BY mid, value))
    SELECT focal, """ + ", ".join(f"round(coalesce(max(CASE WHEN mid <= {p} AND nx > {p} THEN value + ({p} - mid) / (nx - mid) * (up - value) END), max(CASE WHEN fa > {p} THEN fv END), max(value)), 8) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))) + " FROM n GROUP BY 1")
def weighted_percentile(spark, d):
    e = parts(spark, d)
    part = T(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("w"))
    values = e.join(part, e["neighbor"] == part["p_partkey"]).select("focal", "value", "w")
    out = A.weighted_percentiles(values, ["focal"], "value", "w")
    return out.select("focal", *(F.round(c, 8).alias(c) for c in ("p25", "p50", "p75")))


@query(f"WITH {PARTS} SELECT focal, round(quantile_cont(p_retailprice, 0.05), 6) AS p5, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM e JOIN part ON neighbor = p_partkey GROUP BY 1")
def context_5_50_95(spark, d):
    q = F.percentile("p_retailprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = G.neighbourhood(parts(spark, d), T(spark, d, "part"), "p_partkey", [q.alias("q")])
    return out.select("focal", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


@query(f"WITH {PARTS} SELECT focal, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS iqr FROM e JOIN part ON neighbor = p_partkey GROUP BY 1")
def lag_median_iqr(spark, d):
    q = F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = G.neighbourhood(parts(spark, d), T(spark, d, "part"), "p_partkey", [q.alias("q")])
    return out.select("focal", F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"))


@query(f"""WITH {PARTS}, p AS (SELECT focal, min(p_size) AS near FROM e JOIN part ON neighbor = p_partkey GROUP BY 1) SELECT focal, round(1.0 / near, 9) AS strongest FROM p""")
def decay_strongest(spark, d):
    e = parts(spark, d)
    part = T(spark, d, "part")
    weighted = e.join(part, e["neighbor"] == part["p_partkey"]).select("focal", "neighbor", F.col("p_size").cast("double").alias("weight"))
    return G.strongest(G.decay(weighted)).select("focal", F.round("weight", 9).alias("strongest"))
