"""Catalogue: projections, joins, reshaping and grouped statistics over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphloom.functions import scalar as S
from morphloom.operators import aggregates as A
from morphloom.operators import relational as R
from morphloom.storage import table as T

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority, c_mktsegment, p_brand, p_size, s_nationkey
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def star_merge_primary(spark, d):
    dims = [(T(spark, d, "orders"), "l_orderkey", "o_orderkey"), (T(spark, d, "customer"), "o_custkey", "c_custkey"), (T(spark, d, "part"), "l_partkey", "p_partkey"), (T(spark, d, "supplier"), "l_suppkey", "s_suppkey")]
    return R.star_join(T(spark, d, "lineitem"), dims, ["l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority", "c_mktsegment", "p_brand", "p_size", "s_nationkey"])


@query("""SELECT round_even(p_retailprice, -2) AS x_100, CAST(floor(p_size / 10) AS BIGINT) AS y_100, count(*) AS weight FROM part GROUP BY 1, 2""")
def grid_count(spark, d):
    from morphloom.operators.spatial import cell
    from morphloom.operators.spatial import grid_count as count

    return count(T(spark, d, "part"), {"x_100": S.around(F.col("p_retailprice"), -2), "y_100": cell(F.col("p_size"), 10)})


@query("""WITH g AS (SELECT round_even(p_retailprice, -2) AS x, p_size, count(*) AS weight FROM part GROUP BY 1, 2)
    SELECT p_partkey, weight, weight > 2 AS core FROM part JOIN g ON round_even(p_retailprice, -2) = g.x AND part.p_size = g.p_size""")
def grid_join_back_core(spark, d):
    part = T(spark, d, "part").withColumn("x", S.around(F.col("p_retailprice"), -2))
    g = part.groupBy("x", "p_size").agg(F.count(F.lit(1)).alias("weight"))
    return part.join(g, ["x", "p_size"], "left").select("p_partkey", "weight", (F.col("weight") > 2).alias("core"))


@query("""SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def union_standardise(spark, d):
    columns = {"name": "string", "nation": "int", "balance": "double", "segment": "string"}
    a = R.standardise(T(spark, d, "customer"), {"c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}, columns)
    b = R.standardise(T(spark, d, "supplier"), {"s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}, columns)
    return R.union_all(a, b)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) t WHERE n = 1""")
def dedup_first(spark, d):
    return R.first_per_key(T(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase') AND props IS NOT NULL""")
def class_filter_not_null(spark, d):
    return T(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase") & F.col("props").isNotNull()).select("event_id", "event_type")


@query("""WITH f AS (SELECT l_orderkey, l_returnflag = 'R' AS tunnel, l_linestatus = 'O' AS open, l_discount FROM lineitem),
    g AS (SELECT l_orderkey, CASE WHEN bool_or(tunnel) THEN sum(CASE WHEN tunnel AND NOT open THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) ELSE -1 END AS share FROM f GROUP BY 1)
    SELECT l_orderkey, share AS percent, (share = 0 OR share > 6) AS dropped FROM g""")
def nested_flag_rule(spark, d):
    line = T(spark, d, "lineitem")
    flag = F.struct(F.when(F.col("l_returnflag") == "R", F.array(F.lit("is_tunnel"))).otherwise(F.array().cast("array<string>")).alias("values"), F.when(F.col("l_linestatus") != "O", F.array(F.lit(0.0), F.col("l_discount"))).alias("between"))
    flags = line.groupBy("l_orderkey").agg(F.collect_list(flag).alias("flags"))
    share = flags.select("l_orderkey", S.tunnel_share(F.col("flags")).alias("share"))
    out = share.select("l_orderkey", F.round(F.when(F.col("share") < 0, F.col("share")).otherwise(F.col("share") * 100)).cast("bigint").alias("percent"))
    return out.select("l_orderkey", "percent", ((F.col("percent") == 0) | (F.col("percent") > 6)).alias("dropped"))


@query("""SELECT o_custkey, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd FROM orders GROUP BY 1""")
def group_std_fill0(spark, d):
    return A.std_or_zero(T(spark, d, "orders"), ["o_custkey"], "o_totalprice", "sd").select("o_custkey", F.round("sd", 4).alias("sd"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, p_size AS mode FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM c) t WHERE r = 1)
    SELECT p_brand, count(*) AS count, CAST(sum(p_size) AS BIGINT) AS sum, round(avg(p_size), 6) AS mean, median(p_size) AS median, round(stddev_samp(p_size), 6) AS std, min(p_size) AS min, max(p_size) AS max, count(DISTINCT p_size) AS nunique, any_value(mode) AS mode
    FROM part JOIN m USING (p_brand) GROUP BY 1""")
def describe_agg(spark, d):
    out = A.describe(T(spark, d, "part"), ["p_brand"], "p_size")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""SELECT n_nationkey, round(count(c_custkey) / sum(abs(c_acctbal)), 9) AS density FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1""")
def density_ratio(spark, d):
    joined = T(spark, d, "nation").join(T(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_nationkey").agg(F.round(S.ratio(F.count("c_custkey"), F.sum(F.abs("c_acctbal"))), 9).alias("density"))


@query("""SELECT p_brand, count(*) AS size, quantile_cont(p_retailprice, 0.25) AS price__25, median(p_retailprice) AS price__median, quantile_cont(p_retailprice, 0.75) AS price__75, round(stddev_samp(p_retailprice), 6) AS price__std, round(avg(p_retailprice), 6) AS price__mean FROM part GROUP BY 1""")
def multi_stat_morphotope(spark, d):
    out = A.multi_stat(T(spark, d, "part").withColumnRenamed("p_retailprice", "price"), ["p_brand"], ["price"])
    return out.withColumns({"price__std": F.round("price__std", 6), "price__mean": F.round("price__mean", 6)})


@query("""WITH l AS (SELECT l_suppkey, l_returnflag || '_' || l_linestatus || CASE WHEN l_quantity < 25 THEN '_-1' ELSE '_1' END AS label FROM lineitem),
    c AS (SELECT l_suppkey, label, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT l_suppkey, label FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY label LIKE '%-1', n DESC, label) AS r FROM c) t WHERE r = 1""")
def non_noise_mode(spark, d):
    label = S.morph_label(F.col("l_returnflag"), F.col("l_linestatus"), F.when(F.col("l_quantity") < 25, F.lit("-1")).otherwise(F.lit("1")))
    return A.non_noise_mode(T(spark, d, "lineitem").select("l_suppkey", label.alias("label")), ["l_suppkey"], "label")


@query("""SELECT l_partkey, l_quantity FROM (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) t WHERE r = 1""")
def mode_smallest(spark, d):
    return A.mode_smallest(T(spark, d, "lineitem"), ["l_partkey"], "l_quantity")


@query("""SELECT l_suppkey, round(sum(l_extendedprice), 2) AS top10 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) t WHERE r <= 10 GROUP BY 1""")
def topn_sum(spark, d):
    return A.top_n_sum(T(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 10, "top10").select("l_suppkey", F.round("top10", 2).alias("top10"))


@query("""WITH l AS (UNPIVOT (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) * 30 AS a, p_retailprice AS b, CAST((p_partkey * 7) % 1500 AS DOUBLE) AS c FROM part) ON a, b, c INTO NAME char VALUE value)
    SELECT char, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, char) AS r FROM l) t WHERE r <= 2 GROUP BY 1""")
def topn_features(spark, d):
    part = T(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") * 30).alias("a"), F.col("p_retailprice").alias("b"), ((F.col("p_partkey") * 7) % 1500).cast("double").alias("c"))
    return A.top_features(part, "id", ["a", "b", "c"], 2)


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(sum(CASE WHEN l_discount < 0.03 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 8) AS thin_area, round(avg(CASE WHEN l_discount < 0.03 THEN 1.0 ELSE 0.0 END), 8) AS thin_count,
        round(sum(CASE WHEN l_discount < 0.03 AND l_extendedprice > m THEN l_extendedprice ELSE 0 END) / sum(CASE WHEN l_extendedprice > m THEN l_extendedprice END), 8) AS thin_large
    FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def cond_area_ratio(spark, d):
    out = A.share_above_median(T(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", F.col("l_discount") < 0.03, "thin")
    return out.select("l_suppkey", *(F.round(c, 8).alias(c) for c in ("thin_area", "thin_count", "thin_large")))


@query("""SELECT p_brand, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 9) AS share_A, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS share_R FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def crosstab_norm(spark, d):
    joined = T(spark, d, "lineitem").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = A.crosstab_shares(joined, "p_brand", "l_returnflag", ["A", "R"])
    return out.select("p_brand", F.round("share_A", 9).alias("share_A"), F.round("share_R", 9).alias("share_R"))


@query("""SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "n_F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "n_O", CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS "n_P" FROM orders GROUP BY 1""")
def crosstab_counts(spark, d):
    return A.crosstab_counts(T(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT c_custkey, CAST(coalesce(n_regionkey, -1) AS INTEGER) AS n_regionkey FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 0) n ON c_nationkey = n_nationkey""")
def dim_map_default(spark, d):
    lookup = T(spark, d, "nation").where("n_regionkey <> 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.map_with_default(T(spark, d, "customer").select("c_custkey", "c_nationkey"), lookup, "c_nationkey", "n_regionkey", -1).select("c_custkey", "n_regionkey")


@query("""SELECT p_partkey, p_brand AS level_3, split_part(p_type, ' ', 1) AS level_2, p_brand <> 'Brand#1' AND p_size < 10 AS initially_noise FROM part""")
def level_labels_initially_noise(spark, d):
    part = T(spark, d, "part")
    return part.select("p_partkey", F.col("p_brand").alias("level_3"), F.split("p_type", " ")[0].alias("level_2"), ((F.col("p_brand") != "Brand#1") & (F.col("p_size") < 10)).alias("initially_noise"))


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM part) SELECT p_partkey, CAST(len(list_filter(e, lambda x: x < p_retailprice)) AS INTEGER) AS class FROM part, e""")
def quantile_classify(spark, d):
    part = T(spark, d, "part")
    edges = A.quantile_edges(part, "p_retailprice", 5)
    return part.select("p_partkey", S.width_class(F.col("p_retailprice"), F.array(*map(F.lit, edges))).alias("class"))


@query("""SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size FROM part""")
def zscore_pop(spark, d):
    return A.zscore(T(spark, d, "part").select("p_partkey", "p_size"), ["p_size"]).select("p_partkey", F.round("p_size", 6).alias("p_size"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer) SELECT c_custkey, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS c_acctbal FROM customer, q""")
def robust_scaled(spark, d):
    return A.robust_scale(T(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal) - 1 AS lo, count(*) OVER () - row_number() OVER (ORDER BY s_acctbal DESC) AS hi, count(*) OVER () AS n FROM supplier)
    SELECT s_suppkey, round((lo + hi) / 2.0 / (n - 1), 6) AS rank01 FROM r""")
def quantile_rank(spark, d):
    supplier = T(spark, d, "supplier")
    return A.quantile_uniform(supplier, "s_acctbal", "rank01").select("s_suppkey", F.round("rank01", 6).alias("rank01"))


@query("""SELECT p_partkey, p_size FROM part""")
def drop_zero_variance(spark, d):
    part = T(spark, d, "part").select("p_partkey", "p_size", F.lit(3.0).alias("flat"))
    return R.drop_constant(part, ["p_size", "flat"])


@query("""SELECT c_custkey, greatest(-100.0, least(5000.0, c_acctbal)) AS balance FROM customer""")
def clip_values(spark, d):
    return T(spark, d, "customer").select("c_custkey", S.clip(F.col("c_acctbal"), -100.0, 5000.0).alias("balance"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def semi_existing(spark, d):
    return R.existing(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def anti_pending(spark, d):
    return R.pending(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def set_union(spark, d):
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(T(spark, d, "supplier").select("s_nationkey")).distinct()


@query("""SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer""")
def set_intersect(spark, d):
    return T(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(T(spark, d, "customer").select("c_custkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set_except(spark, d):
    return T(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(T(spark, d, "orders").select("o_custkey"))


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS "n_o_orderstatus", count(DISTINCT o_orderpriority) AS "n_o_orderpriority" FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def qa_consistency(spark, d):
    out = R.inconsistent(T(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return out.select("o_custkey", F.col("n_o_orderstatus").cast("bigint").alias("n_o_orderstatus"), F.col("n_o_orderpriority").cast("bigint").alias("n_o_orderpriority"))


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def missing_outputs(spark, d):
    done = T(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    return R.pending(T(spark, d, "part").select("p_partkey"), done, ["p_partkey"])


@query("""SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part""")
def factorize_codes(spark, d):
    return R.factorize(T(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "code")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS id FROM supplier""")
def dense_ids(spark, d):
    return R.dense_ids(T(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "id").select("s_suppkey", "id")


@query("""SELECT n_regionkey, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS "BUILDING", CAST(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS "MACHINERY" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def pivot_counts(spark, d):
    joined = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = R.to_wide(joined, ["n_regionkey"], "c_mktsegment", ["BUILDING", "MACHINERY"], F.count(F.lit(1)))
    return out.na.fill(0, ["BUILDING", "MACHINERY"])


@query("""SELECT s_suppkey AS id, 'balance' AS char, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def unpivot_long(spark, d):
    s = T(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return R.to_long(s, ["id"], ["balance", "nation"])


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN n_nationkey || 'th' WHEN n_nationkey % 10 = 1 THEN n_nationkey || 'st' WHEN n_nationkey % 10 = 2 THEN n_nationkey || 'nd' WHEN n_nationkey % 10 = 3 THEN n_nationkey || 'rd' ELSE n_nationkey || 'th' END AS name FROM nation""")
def ordinal_names(spark, d):
    return T(spark, d, "nation").select("n_nationkey", S.ordinal(F.col("n_nationkey")).alias("name"))


@query("""SELECT p_brand, round(var_pop(p_size) * count(*) + var_pop(p_retailprice) * count(*), 3) AS inertia FROM part GROUP BY 1""")
def inertia(spark, d):
    return A.inertia(T(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"]).select("p_brand", F.round("inertia", 3).alias("inertia"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 9) AS corr, round(skewness(l_extendedprice), 6) AS skew FROM lineitem""")
def correlation_and_skew(spark, d):
    from pyspark.sql import functions as f

    n = f.count("l_extendedprice").cast("double")
    adjusted = f.skewness("l_extendedprice") * f.sqrt(n * (n - 1)) / (n - 2)
    return T(spark, d, "lineitem").agg(f.round(f.corr("l_quantity", "l_extendedprice"), 9).alias("corr"), f.round(adjusted, 6).alias("skew"))


@query("""SELECT s_nationkey, round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT s_nationkey, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS i FROM supplier WHERE s_acctbal >= 0) t GROUP BY 1""")
def gini_by_nation(spark, d):
    return A.gini(T(spark, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_nationkey", F.round("gini", 6).alias("gini"))


@query("""SELECT round(avg(CASE WHEN CAST(p_size AS VARCHAR) || '_-1' LIKE '%-1' AND p_size > 40 THEN 1.0 ELSE 0.0 END), 9) AS noise FROM part""")
def noise_share(spark, d):
    label = S.morph_label(F.col("p_size"), F.when(F.col("p_size") > 40, F.lit("-1")).otherwise(F.lit("0")))
    return T(spark, d, "part").agg(F.round(F.avg(S.is_noise(label).cast("double")), 9).alias("noise"))
