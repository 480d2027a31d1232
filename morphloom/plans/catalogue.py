"""All catalogue queries and their SQL twins; the flagship profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.operators import aggregates as A
from morphloom.operators import relational as R
from morphloom.plans import pack_context, pack_evaluate, pack_graph, pack_relational, pack_spatial, pack_town, pack_trees
from morphloom.storage import table as T

PACKS = (pack_relational, pack_graph, pack_spatial, pack_context, pack_town, pack_trees, pack_evaluate)


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of each class: the wide star table, its label mapped up the hierarchy, then
    quartiles, mean and deviation of the characters and row-normalised shares by class."""
    dims = [(T(spark, sf_dir, "part"), "l_partkey", "p_partkey"), (T(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey"), (T(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey")]
    wide = R.star_join(T(spark, sf_dir, "lineitem"), dims, ["p_brand", "l_quantity", "l_extendedprice", "l_returnflag", "n_regionkey"])
    stats = A.multi_stat(wide, ["p_brand"], ["l_quantity", "l_extendedprice"])
    shares = A.crosstab_shares(wide, "p_brand", "l_returnflag", ["A", "N", "R"])
    joined = stats.join(shares, "p_brand")
    return joined.select("p_brand", "size", *(F.round(c, 4).alias(c) for c in joined.columns if c not in ("p_brand", "size")))


def _profile_sql() -> str:
    stats = ", ".join(
        f'round(quantile_cont({c}, 0.25), 4) AS "{c}__25", round(median({c}), 4) AS "{c}__median", round(quantile_cont({c}, 0.75), 4) AS "{c}__75", round(stddev_samp({c}), 4) AS "{c}__std", round(avg({c}), 4) AS "{c}__mean"'
        for c in ("l_quantity", "l_extendedprice")
    )
    shares = ", ".join(f"round(avg(CASE WHEN l_returnflag = '{f}' THEN 1.0 ELSE 0.0 END), 4) AS \"share_{f}\"" for f in "ANR")
    return f"SELECT p_brand, count(*) AS size, {stats}, {shares} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"class_profile": class_profile} | {k: v for p in PACKS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"class_profile": _profile_sql()} | {k: v for p in PACKS for k, v in p.SQL.items()}
