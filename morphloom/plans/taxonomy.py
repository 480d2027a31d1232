"""From the wide table to classes: groups, their characters, the tree, and what noise becomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.functions.scalar import is_noise, morph_label
from morphloom.operators import aggregates as A
from morphloom.operators import cluster as C
from morphloom.operators import relational as R
from morphloom.operators import spatial as P
from morphloom.operators import ward as W
from morphloom.operators.components import connected_components
from morphloom.storage import materialize


def delineate(cells: DataFrame, edges: DataFrame, key: str, columns: Sequence[str], region: str, min_size: int = 75) -> DataFrame:
    """(key, label): contiguous groups as region_component_cluster; -1 ends a noise label.

    Cells without a building (negative key) take no part; columns are scaled over the region.
    """
    own = cells.where(F.col(key) >= 0).select(key, region, *columns)
    scaled = A.zscore(own, list(columns), [region])
    found = C.cluster_components(scaled, edges, key, list(columns), min_size)
    return found.join(own.select(key, region), key).select(key, morph_label(F.col(region), F.col("component"), F.col("cluster")).alias("label"))


def settle_structures(labels: DataFrame, structures: DataFrame, key: str) -> DataFrame:
    """One label for all buildings of a structure: its most frequent one that is not noise."""
    joined = labels.join(structures.select(key, "component"), key)
    settled = A.non_noise_mode(joined, ["component"], "label").withColumnRenamed("label", "_l")
    return joined.join(settled, "component").select(key, F.col("_l").alias("label"))


def group_stats(cells: DataFrame, labels: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles, median, deviation, mean and size of each group that is not noise."""
    return A.multi_stat(cells.join(labels.where(~is_noise(F.col("label"))), key), ["label"], columns)


def group_chars(buildings: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Thin-building shares, plot structure, and the size of the ten largest of each group."""
    # six steps read these: characters are made once
    b = materialize(buildings.join(labels.hint("merge"), key).select("label", "mibFR", "ssbElo", "libNCo", "sdbAre", "sdbPer", "sdbLAL"), "grouped")
    thin = (F.col("mibFR") < 8) & (F.col("ssbElo") < 0.9)
    shares = A.share_above_median(b, "label", "sdbAre", thin, "thin")
    court = b.groupBy("label").agg(F.median("libNCo").alias("_c"))
    out = shares.join(court, "label").select("label", F.col("thin_area").alias("limMFR"), F.col("thin_count").alias("limMTC"), F.col("thin_large").alias("limLMFR"), ((F.col("thin_area") > 0.4) | (F.col("_c") > 0)).alias("limLPS"))
    for value, name in (("sdbAre", "limAre"), ("sdbPer", "limPer"), ("sdbLAL", "limLAL")):
        out = out.join(A.top_n_sum(b, ["label"], value, 10, name), "label", "left")
    return out


def spacing(buildings: DataFrame, labels: DataFrame, reach: float, key: str = "id") -> DataFrame:
    """limSDi: spread of the relative-neighbourhood edges inside a group over its median perimeter;
    0.35 for groups of fewer than three."""
    b = buildings.join(labels, key)
    edges = P.proximity_graph(b, key, "rng", reach)
    side = lambda c: b.select(F.col(key).alias(c), F.col("label").alias(f"_{c}"))
    inner = edges.join(side("focal"), "focal").join(side("neighbor"), "neighbor").where("_focal = _neighbor")
    spread = inner.groupBy(F.col("_focal").alias("label")).agg(F.stddev_samp("weight").alias("_s"))
    own = b.groupBy("label").agg(F.median("sdbPer").alias("_p"), F.count(F.lit(1)).alias("_n"))
    return own.join(spread, "label", "left").select("label", F.when(F.col("_n") < 3, 0.35).otherwise(F.try_divide(F.coalesce("_s", F.lit(0.0)), F.col("_p"))).alias("limSDi"))


def taxonomy(groups: DataFrame, key: str, columns: Sequence[str], cuts: Sequence[float], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Merges of the groups over their k-nearest-neighbour graph, and (key, level_1 ...).

    Groups are numbered in the order of their key. Nothing is gathered: neighbours come from blocks
    of rows, merges from rounds of mutual nearest neighbours.
    """
    scaled = A.zscore(groups.select(key, *columns), list(columns))
    rows = materialize(R.dense_ids(scaled, [key], "id").select(key, "id", F.array(*(F.col(c).cast("double") for c in columns)).alias("v")), "groups")
    near = P.knn(rows, rows, "id", "v", k).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    merges = W.ward_merges(rows.select("id", F.lit(1).alias("size"), "v"), near)
    levels = W.cut_levels(rows, merges, cuts)
    return merges, rows.select(key, "id").join(levels, "id").drop("id")


def assign_noise(noise: DataFrame, classes: DataFrame, key: str, label: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(key, label): noise groups take the vote of their k nearest classes, scaled together."""
    numbered = R.dense_ids(classes.withColumn(label, F.col(label).cast("string")), [label], "_i")
    named = numbered.select((-1 - F.col("_i")).alias("i"), F.col(label).alias("label"), *columns)
    both = noise.select(F.col(key).cast("bigint").alias("i"), F.lit(None).cast("string").alias("label"), *columns).unionByName(named)
    over = both.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    rows = both.withColumn("v", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(over[f"m_{c}"]).cast("double"), F.lit(0.0)) for c in columns)))
    near = P.knn(rows.where("label IS NULL"), rows.where("label IS NOT NULL"), "i", "v", k, scale=[over[f"s_{c}"] or 1.0 for c in columns])
    return C.knn_vote(near, rows.where("label IS NOT NULL"), "i", "label").select(F.col("query_id").alias(key), "label")


def unique_noise_labels(cells: DataFrame, edges: DataFrame, key: str, region: str) -> DataFrame:
    """Names for patches of noise: region, and the patch's number from 1."""
    comps = connected_components(edges, "focal", "neighbor").withColumnRenamed("node", key)
    own = cells.join(comps, key, "left").withColumn("component", F.coalesce("component", key))
    patches = own.select(region, "component").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(region).orderBy("component")))
    return own.join(patches, [region, "component"]).select(key, F.concat_ws("_", F.col(region).cast("string"), F.col("_k").cast("string"), F.lit("-1")).alias("label"))
