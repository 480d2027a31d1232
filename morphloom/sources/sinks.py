"""Sinks: region partitions, spatially sorted releases, small artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.functions import geometry as G
from morphloom.functions.scalar import morton
from morphloom.operators.relational import pending


def write_regions(df: DataFrame, path: str, region: str = "region_id", **parameters: object) -> None:
    """One folder a region; run parameters become partition columns above it."""
    for name, value in parameters.items():
        df = df.withColumn(name, F.lit(str(value)))
    df.write.partitionBy(*parameters, region).mode("append").parquet(path)


def write_missing_regions(df: DataFrame, path: str, region: str = "region_id") -> None:
    """Only regions that are not there yet are written."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(region).cast(df.schema[region].dataType).alias(region)).distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return write_regions(df, path, region)
    return write_regions(pending(df, done, [region]), path, region)


def write_release(df: DataFrame, path: str, rings: str = "rings", files: int = 8, level: int = 19) -> None:
    """zstd Parquet with covering box columns, sorted along a Z-order of the boxes' corners.

    The range partitioning and the sort keep neighbours in one row group, so that box filters
    skip most of a file.
    """
    boxed = df.withColumn("_b", G.bounds(F.col(rings)[0])).select("*", "_b.minx", "_b.miny", "_b.maxx", "_b.maxy").drop("_b")
    low = boxed.agg(F.min("minx").alias("x0"), F.max("minx").alias("x1"), F.min("miny").alias("y0"), F.max("miny").alias("y1")).first()
    if low.x0 is not None:
        scaled = lambda c, a, b: F.floor((F.col(c) - a) / ((b - a) or 1.0) * 65535)
        boxed = boxed.withColumn("_z", morton(scaled("minx", low.x0, low.x1), scaled("miny", low.y0, low.y1)))
        boxed = boxed.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
    boxed.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)


def write_float32(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Attribute file: doubles as 32-bit floats, geometry left out."""
    keep = [f.name for f in df.schema if f.name in keys or f.dataType.typeName() in ("double", "float", "integer", "long")]
    kinds = dict(df.dtypes)
    df.select(*(F.col(c).cast("float").alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in keep)).write.parquet(path)


def write_json_map(df: DataFrame, path: str, key: str, value: str) -> None:
    """A small lookup as one JSON object a line."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value).cast("string"))).alias("value")).write.text(path)
