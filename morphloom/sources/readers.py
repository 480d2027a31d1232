"""Scans: Parquet with bounding-box pruning, region globs, GeoJSON, CSV, linkage arrays, feeds."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions.shapes import RING


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose bounding-box columns meet a box; the comparisons reach the Parquet reader.

    Works with flat columns (minx ...) and with a ``bbox`` struct (xmin ...), whose nested fields
    are pushed down and pruned as well.
    """
    df = spark.read.parquet(path)
    names = ("minx", "miny", "maxx", "maxy") if "minx" in df.columns else ("bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")
    minx, miny, maxx, maxy = map(F.col, names)
    df = df.where((minx <= box[2]) & (maxx >= box[0]) & (miny <= box[3]) & (maxy >= box[1]))
    return df.select(*columns) if columns else df


def dataset_path(root: str, theme: str, kind: str) -> str:
    """Where a release partitioned by theme and type keeps one type's files."""
    return f"{root.rstrip('/')}/theme={theme}/type={kind}"


def read_region_features(spark: SparkSession, root: str, theme: str, kind: str, region: DataFrame, size: float | None = None, rings: str = "rings") -> DataFrame:
    """Features of one type that share area with a region: only that type's partition is listed, box
    comparisons reach the reader, and the exact test sees what is left."""
    from morphloom.operators import polygons

    b = region.select(F.explode(rings).alias("r")).select(G.bounds(F.col("r")).alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    boxed = read_box(spark, dataset_path(root, theme, kind), tuple(b))
    return polygons.intersecting(boxed, region, size or max(b[2] - b[0], b[3] - b[1]), rings)


def read_regions(spark: SparkSession, pattern: str, name: str = r"_(\w+)\.(?:parquet|pq)") -> DataFrame:
    """All files of a glob, with the region each came from as ``region_id``."""
    return spark.read.parquet(pattern).withColumn("region_id", F.regexp_extract(F.input_file_name(), name, 1))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV under a stated schema: no pass is spent on inference."""
    return spark.read.schema(schema).csv(path, header=header, mode="FAILFAST")


def read_wkt_csv(spark: SparkSession, path: str, schema: str, wkt: str = "wkt") -> DataFrame:
    """CSV with POLYGON or LINESTRING text; adds ``rings``, an array of point arrays."""
    df = read_csv(spark, path, schema)
    groups = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.struct(F.split(F.trim(t), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(t), r"\s+")[1].cast("double").alias("y"))
    return df.withColumn("rings", F.transform(groups, lambda g: F.transform(F.split(g, ","), point)))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Polygon features, one for each multipart member: properties and ``rings``."""
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    ring = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    return raw.select("f.properties.*", F.posexplode(parts).alias("part", "_p")).withColumn("rings", ring(F.col("_p"))).drop("_p")


def read_linkage(spark: SparkSession, path: str) -> DataFrame:
    """A saved (n-1) x 4 linkage array as rows (step, left, right, distance, size)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content))
                yield pd.DataFrame({"step": np.arange(len(z)), "left": z[:, 0].astype(int), "right": z[:, 1].astype(int), "distance": z[:, 2], "size": z[:, 3].astype(int)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "step bigint, left bigint, right bigint, distance double, size bigint")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link) of the entries of an ATOM feed."""
    feed = spark.read.text(path, wholetext=True)
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry[ >](.*?)</entry>"), F.lit(1)))
    e = feed.select(entry.alias("e"))
    return e.select(F.regexp_extract("e", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1).alias("link"))


def points_as_ring(column: str) -> str:
    """The type every ring column has, for schemas written as text."""
    return f"{column} {RING}"
