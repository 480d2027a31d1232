"""Grouped statistics: all combine before the shuffle unless they must see a whole group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.functions.scalar import is_noise, ratio
from morphloom.operators.quantiles import exact_percentiles, known


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, sum, mean, median, std, min, max, nunique, mode (smallest of the most frequent)."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.countDistinct(v).alias("nunique"), F.expr(f"mode() WITHIN GROUP (ORDER BY `{value}`)").alias("mode"),
    )


def std_or_zero(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sample deviation by group; 0 for a single row."""
    return df.groupBy(*keys).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(name))


def multi_stat(df: DataFrame, keys: Sequence[str], columns: Sequence[str], strict_nan: bool = False) -> DataFrame:
    """``c__25``, ``c__median``, ``c__75``, ``c__std``, ``c__mean`` of each column, and ``size``.

    ``strict_nan`` makes the quartiles of a group with a null NaN.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("size")]
    for c in columns:
        v = F.col(c).cast("double")
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        lost = F.count(v) < F.count(F.lit(1))
        side = lambda i, q=q, lost=lost: F.when(lost, F.lit(float("nan"))).otherwise(q[i]) if strict_nan else q[i]
        aggs += [side(0).alias(f"{c}__25"), q[1].alias(f"{c}__median"), side(2).alias(f"{c}__75"), F.stddev_samp(v).alias(f"{c}__std"), F.avg(v).alias(f"{c}__mean")]
    return df.groupBy(*keys).agg(*aggs)


def mode_smallest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie; ranks counts, not rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def non_noise_mode(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The most frequent label that is not noise; noise only where a group has nothing else."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(is_noise(F.col(label)).cast("int"), F.desc("_n"), label)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def top_n_sum(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Sum of the n largest values of each group; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return ranked.groupBy(*keys).agg(F.sum(value).alias(name))


def top_features(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """How often each column is among a row's k largest; ties to the first name."""
    from morphloom.operators.relational import to_long

    long = to_long(df, [key], columns).where("value IS NOT NULL")
    w = Window.partitionBy(key).orderBy(F.desc("value"), "char")
    return long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def share_above_median(df: DataFrame, key: str, size: str, cond: Column, name: str) -> DataFrame:
    """Of each group: share of size, share of rows, and share of size among above-median rows."""
    # the median is joined back by group: the planner can split a large group, a window could not
    med = df.groupBy(key).agg(F.median(size).alias("_m"))
    big = F.col(size) > F.col("_m")
    s = F.col(size).cast("double")
    return (
        df.join(med, key)
        .groupBy(key)
        .agg(
            ratio(F.sum(F.when(cond, s).otherwise(0.0)), F.sum(s)).alias(f"{name}_area"),
            F.avg(cond.cast("double")).alias(f"{name}_count"),
            ratio(F.sum(F.when(cond & big, s).otherwise(0.0)), F.sum(F.when(big, s))).alias(f"{name}_large"),
        )
    )


def crosstab_shares(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised crosstab; classes that are not shown stay in the denominator."""
    total = F.count(F.lit(1)).cast("double")
    return df.groupBy(row).agg(*(F.try_divide(F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("double"), total).alias(f"share_{v}") for v in values))


def crosstab_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).agg(*(F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"n_{v}") for v in values))


def quantile_edges(df: DataFrame, value: str, k: int) -> list[float]:
    """Upper edges of the k quantile classes: k numbers, none for a column without values."""
    return exact_percentiles(df, value, [i / k for i in range(1, k + 1)]) or []


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Percentiles under weights: a value stands at the middle of its weight, linear in between.

    Below the first and beyond the last middle the extreme values hold.
    """
    w = Window.partitionBy(*keys).orderBy(value, weight)
    run = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    # null and NaN are left out alike: NaN would sort last and pass for the largest value
    ranked = df.where(known(value) & known(weight)).withColumn("_at", (run - 0.5 * F.col(weight)) / total)
    ahead = Window.partitionBy(*keys).orderBy("_at", value)
    ranked = ranked.withColumn("_next", F.lead("_at").over(ahead)).withColumn("_up", F.lead(value).over(ahead)).withColumn("_first", F.first("_at").over(ahead)).withColumn("_low", F.first(value).over(ahead))
    aggs = []
    for p in at:
        inside = (F.col("_at") <= p) & (F.col("_next") > p)
        between = F.col(value) + (F.lit(p) - F.col("_at")) / (F.col("_next") - F.col("_at")) * (F.col("_up") - F.col(value))
        name = f"p{round(100 * p)}"
        aggs.append(F.coalesce(F.max(F.when(inside, between)), F.max(F.when(F.col("_first") > p, F.col("_low"))), F.max(value)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Population z-scores; a column without spread becomes 0, null becomes 0."""
    stats = df.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    if keys:
        joined = df.join(stats, list(keys))
        value = lambda c, n: F.col(f"_{n}_{c}")
    else:
        row = stats.first()
        joined = df
        value = lambda c, n: F.lit(row[f"_{n}_{c}"]).cast("double")
    scaled = [F.coalesce((F.col(c) - value(c, "m")) / F.when(value(c, "s") > 0, value(c, "s")).otherwise(1.0), F.lit(0.0)).alias(c) for c in columns]
    return joined.select(*(c for c in df.columns if c not in columns), *scaled)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, over the whole table; null and NaN stay as they are."""
    q = {c: exact_percentiles(df, c, [0.25, 0.5, 0.75]) or [0.0, 0.0, 1.0] for c in columns}
    return df.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0)).alias(c) for c in columns))


def power_scale(df: DataFrame, columns: Sequence[str], around: Sequence[float] = tuple(i / 10 for i in range(-20, 41))) -> DataFrame:
    """Yeo-Johnson transform of each column, at the exponent of ``around`` with the largest likelihood, then z-scores."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")

        def bent(power: float, x: Column = x) -> Column:
            up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
            down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
            return F.when(x >= 0, up).otherwise(down)

        known_rows = df.where(known(c))
        slope = F.sum(F.signum(x) * F.log1p(F.abs(x)))
        row = known_rows.agg(F.count(F.lit(1)).alias("n"), slope.alias("s"), *(F.var_pop(bent(p)).alias(f"v{i}") for i, p in enumerate(around))).first()
        scores = [(-row.n / 2 * math.log(row[f"v{i}"]) + (p - 1) * row.s, -i) for i, p in enumerate(around) if row[f"v{i}"]]
        best = around[-max(scores)[1]] if scores else 1.0
        out = out.withColumn(c, F.when(known(c), bent(best)))
    return zscore(out, columns)


def quantile_uniform(df: DataFrame, column: str, name: str, quantiles: int = 1000) -> DataFrame:
    """Map values to [0, 1] by their place among evenly spaced quantiles, ties to the middle."""
    n = min(quantiles, df.where(known(column)).count())
    if n < 2:
        return df.withColumn(name, F.when(known(column), F.lit(0.0)))
    edges = exact_percentiles(df, column, [i / (n - 1) for i in range(n)])
    up, down, at = np.array(edges), -np.array(edges)[::-1], np.linspace(0, 1, n)

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float, na_value=np.nan)
        return pd.Series(np.where(np.isnan(v), np.nan, 0.5 * (np.interp(v, up, at) - np.interp(-v, down, -at[::-1]))))

    return df.withColumn(name, place(F.col(column).cast("double")))


def inertia(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Sum of squared distances to the group's mean, by group: n * population variance."""
    return df.groupBy(label).agg(sum((F.var_pop(c) * F.count(c) for c in columns[1:]), F.var_pop(columns[0]) * F.count(columns[0])).alias("inertia"))


def penalised_inertia(n: int, k: int, d: int) -> float:
    """n ln(1/n) + k ln(n) d: the score as it is defined, which leaves the inertia itself out."""
    return n * math.log(1.0 / n) + k * math.log(n) * d


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini and Theil indices of non-negative values."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value) >= 0).withColumn("_i", F.row_number().over(w)).withColumn("_mean", F.avg(value).over(Window.partitionBy(*keys)))
    x, n = F.col(value).cast("double"), F.count(F.lit(1)).cast("double")
    share = x / F.col("_mean")
    return ranked.groupBy(*keys).agg(
        (F.try_divide(2.0 * F.sum(F.col("_i") * x), n * F.sum(x)) - (n + 1) / n).alias("gini"),
        F.avg(F.when(share > 0, share * F.log(share)).otherwise(0.0)).alias("theil"),
    )
