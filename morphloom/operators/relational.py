"""Projections, reshaping, deduplication and equi-joins, all by key and never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.storage import materialize


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], columns: Sequence[str]) -> DataFrame:
    """Left-join dimensions (table, key in what is joined so far, key in the table), then a whitelist.

    No side is forced: the planner broadcasts what statistics show to be small.
    """
    out = fact
    for dim, left, right in dims:
        out = out.join(dim, out[left] == dim[right], "left")
    return out.select(*columns)


def standardise(df: DataFrame, names: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Rename source fields to canonical ones, add missing ones as null, keep only these."""
    have = {names.get(c, c): c for c in df.columns}
    return df.select(*(F.col(have[c]).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def drop_matching(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Without the columns whose name holds any of ``parts`` (so also their derived ones)."""
    return df.select(*(c for c in df.columns if not any(p in c for p in parts)))


def keep_stat(df: DataFrame, stat: str, keys: Sequence[str] = ()) -> DataFrame:
    """Of flattened ``character__stat`` columns, one stat, renamed to the character."""
    return df.select(*keys, *(F.col(c).alias(c.rsplit("__", 1)[0]) for c in df.columns if c.endswith(f"__{stat}")))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the columns that have no spread; one aggregation looks at all of them."""
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not spread[c]))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def map_with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left join a lookup table; a missing key gives the default."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def factorize(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense codes from 0 in the order of the distinct values; null has none.

    Distinct values (one row each) are numbered without pulling them into one task, then joined back.
    """
    codes = dense_ids(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
    return df.join(codes, column, "left")


def dense_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0..n-1 in an order, without pulling the rows into one task.

    Rows are range-partitioned and sorted; only one count for each partition is gathered.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parted = materialize(parted, "ranged")
    sizes = parted.groupBy("_part").count().withColumn("_base", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    w = Window.partitionBy("_part").orderBy(*order)
    return parted.join(sizes.select("_part", "_base"), "_part").withColumn(name, (F.row_number().over(w) - 1 + F.col("_base")).cast("bigint")).drop("_part", "_base")


def explode_parts(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One row for each part of a multi-part value, numbered from 0."""
    return df.select(*keys, F.posexplode(column).alias("part", column))


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "char", value: str = "value") -> DataFrame:
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keys), list(columns), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Pivot with the values stated, so that no pass is spent to find them."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(agg)


def existing(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def pending(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def inconsistent(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows do not agree on every column, with the number of values of each."""
    n = {c: F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("\0")))) for c in columns}
    out = df.groupBy(key).agg(*(v.alias(f"n_{c}") for c, v in n.items()))
    return out.where(" OR ".join(f"n_{c} > 1" for c in columns))
