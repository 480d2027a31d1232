"""Catalogue: the tree over all rows of a feature table, its cuts, its splits and its text form.

Every embedding is an observation; the tree merges over the graph of ten nearest neighbours, by
rounds of mutual nearest neighbours. The SQL runs the same rounds as a recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.operators import cluster as C
from morphloom.operators import spatial as P
from morphloom.operators import ward as W
from morphloom.plans.pack_spatial import KNN
from morphloom.storage import materialize
from morphloom.storage import table as T

QUERIES, SQL = {}, {}
#: Heights of the seven cuts, from the coarsest level to the finest.
CUTS = (2.7, 2.4, 2.1, 1.9, 1.7, 1.5, 1.3)
_BUILT: dict[tuple[str, str], DataFrame] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def observations(spark, d) -> DataFrame:
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("size"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def tree(spark, d) -> DataFrame:
    """The merges; written once a session and table folder, as several queries start from them."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _BUILT:
        e = T(spark, d, "embeddings")
        near = P.knn(e, e, "vec_id", "embedding", 10).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
        _BUILT[at] = materialize(W.ward_merges(observations(spark, d), near), "tree")
    return _BUILT[at]


ROUNDS = KNN + """, l0 AS (SELECT DISTINCT least(query_id, id) AS a, greatest(query_id, id) AS b FROM r WHERE rank <= 10),
    w(kind, a, b, d, h, n, v, t) AS (
        (SELECT 'c', vec_id, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 0.0::DOUBLE, 1.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 0 FROM embeddings
        UNION ALL SELECT 'l', a, b, NULL, NULL, NULL, NULL, 0 FROM l0)
        UNION ALL
        SELECT z.* FROM (
            WITH c AS (SELECT * FROM w WHERE kind = 'c'), l AS (SELECT a, b FROM w WHERE kind = 'l'),
            ll AS (SELECT a, b FROM l UNION ALL SELECT a, b FROM (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM c WHERE NOT EXISTS (SELECT 1 FROM l)) q WHERE b IS NOT NULL),
            cost AS (SELECT ll.a, ll.b, sqrt(2.0 * x.n * y.n / (x.n + y.n) * list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d, x.n AS na, y.n AS nb, x.v AS va, y.v AS vb, x.h AS ha, y.h AS hb, x.t FROM ll JOIN c x ON ll.a = x.a JOIN c y ON ll.b = y.a),
            best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, a, b) AS k FROM (SELECT unnest([a, b]) AS id, a, b, d FROM cost) e) f WHERE k = 1),
            pair AS (SELECT a, b FROM best GROUP BY a, b HAVING count(*) = 2),
            made AS (SELECT cost.a, cost.b, d, greatest(d, ha, hb) AS h, na + nb AS n, list_transform(list_zip(va, vb), lambda p: (p[1] * na + p[2] * nb) / (na + nb)) AS v, t FROM cost JOIN pair ON cost.a = pair.a AND cost.b = pair.b),
            gone AS (SELECT b AS id, a AS goal FROM made)
            SELECT 'm', a, b, d, h, n, NULL, t FROM made
            UNION ALL SELECT 'c', a, NULL, NULL, h, n, v, t + 1 FROM made
            UNION ALL SELECT 'c', c.a, NULL, NULL, c.h, c.n, c.v, c.t + 1 FROM c WHERE EXISTS (SELECT 1 FROM made) AND c.a NOT IN (SELECT a FROM made UNION ALL SELECT b FROM made)
            UNION ALL SELECT 'l', a, b, NULL, NULL, NULL, NULL, 0 FROM (SELECT DISTINCT least(coalesce(g.goal, ll.a), coalesce(k.goal, ll.b)) AS a, greatest(coalesce(g.goal, ll.a), coalesce(k.goal, ll.b)) AS b FROM ll LEFT JOIN gone g ON ll.a = g.id LEFT JOIN gone k ON ll.b = k.id) m WHERE a < b) z),
    tree AS (SELECT a AS left_, b AS right_, d, h, CAST(n AS BIGINT) AS size, t AS round FROM w WHERE kind = 'm')"""


@query(f'WITH RECURSIVE {ROUNDS} SELECT left_ AS "left", right_ AS "right", round(d, 6) AS distance, round(h, 6) AS height, size, round FROM tree')
def ward_tree(spark, d):
    return tree(spark, d).select("left", "right", F.round("distance", 6).alias("distance"), F.round("height", 6).alias("height"), "size", "round")


def _levels_sql() -> str:
    ups = ", ".join(f"u{i}(id, at_) AS (SELECT vec_id, vec_id FROM embeddings UNION ALL SELECT u.id, tree.left_ FROM u{i} u JOIN tree ON tree.right_ = u.at_ AND tree.h <= {t}), c{i} AS (SELECT id, dense_rank() OVER (ORDER BY min(at_)) - 1 AS level_{i + 1} FROM u{i} GROUP BY id)" for i, t in enumerate(CUTS))
    joins = " ".join(f"JOIN c{i} USING (id)" for i in range(1, len(CUTS)))
    return f"WITH RECURSIVE {ROUNDS}, {ups} SELECT id, {', '.join(f'level_{i + 1}' for i in range(len(CUTS)))} FROM c0 {joins}"


@query(_levels_sql())
def fcluster_cuts(spark, d):
    """Seven flat levels for every row."""
    return W.cut_levels(observations(spark, d), tree(spark, d), CUTS)


def numbered(merges: DataFrame) -> DataFrame:
    """Merges as a tree table (node, left, right, distance, size): leaves keep their ids, a node's number
    is its round and name, negative; children are the clusters as they were before the merge."""
    node = -(F.col("round").cast("bigint") * F.lit(1 << 40) + F.col("left") + 1)
    own = merges.select("round", F.col("left").alias("a"), F.col("right").alias("b"), "distance", "size", node.alias("node"))
    w = Window.partitionBy("name").orderBy("round")
    states = own.select(F.col("a").alias("name"), "round", "node").unionByName(own.select(F.col("b").alias("name"), "round", F.lit(None).cast("bigint").alias("node")))
    before = states.withColumn("was", F.coalesce(F.lag("node").over(w), F.col("name"))).select("name", "round", "was")
    side = lambda c, name: before.select(F.col("name").alias(c), "round", F.col("was").alias(name))
    return own.join(side("a", "left"), ["a", "round"]).join(side("b", "right"), ["b", "round"]).select("node", "left", "right", "distance", "size")


@query(f"""WITH RECURSIVE {ROUNDS}, u(id, at_, since) AS (SELECT vec_id, vec_id, -1 FROM embeddings UNION ALL SELECT u.id, tree.left_, tree.round FROM u JOIN tree ON tree.right_ = u.at_ AND tree.round > u.since),
    f AS (SELECT tree.left_, tree.round, u.id, u.at_ = tree.left_ AS is_left FROM tree JOIN u ON u.at_ IN (tree.left_, tree.right_) AND u.since < tree.round),
    m AS (SELECT f.left_, f.round, {", ".join(f"avg(CASE WHEN is_left THEN CAST(embedding[{i + 1}] AS DOUBLE) END) - avg(CASE WHEN NOT is_left THEN CAST(embedding[{i + 1}] AS DOUBLE) END) AS c{i}" for i in range(4))} FROM f JOIN embeddings ON vec_id = f.id GROUP BY 1, 2)
    SELECT -(CAST(round AS BIGINT) * {1 << 40} + left_ + 1) AS node, char, round(difference, 6) AS difference FROM (UNPIVOT m ON c0, c1, c2, c3 INTO NAME char VALUE difference) z""")
def split_analysis(spark, d):
    """Mean under the left branch less mean under the right, of four characters, at every split."""
    features = T(spark, d, "embeddings").select(F.col("vec_id").alias("obs"), *(F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(4)))
    out = C.split_analysis(numbered(tree(spark, d)), features, "obs", [f"c{i}" for i in range(4)])
    return out.select("node", "char", F.round("difference", 6).alias("difference"))


@query(f"""WITH RECURSIVE {ROUNDS}, u(id, at_, since) AS (SELECT vec_id, vec_id, -1 FROM embeddings UNION ALL SELECT u.id, tree.left_, tree.round FROM u JOIN tree ON tree.right_ = u.at_ AND tree.round > u.since),
    f AS (SELECT tree.left_, tree.round, u.id, u.at_ = tree.left_ AS is_left FROM tree JOIN u ON u.at_ IN (tree.left_, tree.right_) AND u.since < tree.round),
    top AS (SELECT * FROM tree ORDER BY h DESC, round DESC, left_ LIMIT 1), m AS (SELECT x.i AS feature, avg(CASE WHEN is_left THEN CAST(embedding[x.i + 1] AS DOUBLE) END) - avg(CASE WHEN NOT is_left THEN CAST(embedding[x.i + 1] AS DOUBLE) END) AS diff FROM f JOIN top ON f.left_ = top.left_ AND f.round = top.round JOIN embeddings ON vec_id = f.id, (SELECT unnest(range(0, 64)) AS i) x GROUP BY 1)
    SELECT feature, round(diff, 6) AS difference FROM m ORDER BY diff * diff DESC, feature LIMIT 20""")
def top_branch_differences(spark, d):
    """The twenty features whose means differ most between the two branches of the highest merge."""
    merges = tree(spark, d)
    top = merges.orderBy(F.desc("height"), F.desc("round"), "left").limit(1)
    under = C.leaves_under(numbered(merges)).join(numbered(merges).join(top.select(F.col("distance").alias("_d")), F.col("distance") == F.col("_d"), "left_semi").select("node"), "node", "left_semi")
    long = T(spark, d, "embeddings").select(F.col("vec_id").alias("leaf"), F.posexplode("embedding").alias("feature", "x"))
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("x").cast("double")))
    diff = under.join(long, "leaf").groupBy("feature").agg((side("left") - side("right")).alias("difference"))
    # two times the same merge has no difference of sign: the sides are told by name
    return diff.orderBy(F.desc(F.col("difference") * F.col("difference")), "feature").limit(20).select(F.col("feature").cast("bigint").alias("feature"), F.round("difference", 6).alias("difference"))


def newick_text(merges: DataFrame, splits: int = 50) -> str:
    """The part of the tree above its ``splits`` highest merges, in Newick form: what lies below is a leaf, named by its smallest member."""
    top = merges.orderBy(F.desc("height"), F.desc("round"), "left").limit(splits).orderBy("round", "left").collect()
    text: dict[int, str] = {}
    low: dict[int, float] = {}
    for m in top:
        parts = [f"{text.get(c, str(c))}:{m.height - low.get(c, 0.0):.6g}" for c in (m.left, m.right)]
        text[m.left], low[m.left] = "(" + ",".join(parts) + ")", m.height
        text.pop(m.right, None)
    return ",".join(text.values()) + ";"


@query(None)
def newick_tree(spark, d):
    return spark.createDataFrame([(newick_text(tree(spark, d)),)], "newick string")
