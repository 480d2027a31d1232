"""Vector and table formats read from their bytes: WKB, GeoPackage layers, shapefiles, spreadsheets.

Files come through the ``binaryFile`` source, so they may lie on any file system; one file is one
row of one task, files are read in parallel. Geometry becomes ``rings``: the rings of a polygon, or
one point array for a line or point; a multipart feature gives a row for each part.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.functions.polygons import ARROW_PARTS, PARTS_TYPE, RINGS

FEATURES = f"path string, feature bigint, part int, kind string, attributes string, rings {RINGS}"
_POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_ARROW = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), _POINTS]
_NAMES = ["path", "feature", "part", "kind", "attributes", "rings"]
KINDS = {1: "Point", 2: "LineString", 3: "Polygon"}


def wkb_parts(data: bytes) -> list[tuple[str, list[list[dict]]]]:
    """(kind, rings) of each part of a WKB geometry; z and m are left out, an SRID is skipped."""
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def points(n: int, size: int) -> list[dict]:
        flat = take(f"{n * size}d")
        return [{"x": flat[i], "y": flat[i + 1]} for i in range(0, n * size, size)]

    def geometry() -> list[tuple[str, list[list[dict]]]]:
        nonlocal at, order
        order = "<" if data[at] else ">"
        at += 1
        code = take("I")[0]
        if code & 0x20000000:
            take("I")
        thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
        size = 2 + (bool(code & 0x80000000) or thousands in (1, 3)) + (bool(code & 0x40000000) or thousands in (2, 3))
        if kind == 1:
            return [("Point", [points(1, size)])]
        if kind == 2:
            return [("LineString", [points(take("I")[0], size)])]
        if kind == 3:
            return [("Polygon", [points(take("I")[0], size) for _ in range(take("I")[0])])]
        if kind in (4, 5, 6, 7):
            return [part for _ in range(take("I")[0]) for part in geometry()]
        raise ValueError(f"geometry type {kind}")

    order = "<"
    return geometry()


@F.arrow_udf(PARTS_TYPE)
def wkb_polygons(data: pa.Array) -> pa.Array:
    """The polygons of a WKB column, each with its rings; null stays null, other kinds give none."""
    return pa.array([None if v is None else [rings for kind, rings in wkb_parts(v) if kind == "Polygon" and rings] for v in data.to_pylist()], ARROW_PARTS)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Rows of a GeoParquet file by polygon part: its columns, ``part`` and ``rings`` in place of the WKB column."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c != geometry]
    return df.select(*rest, F.posexplode(wkb_polygons(geometry)).alias("part", "rings"))


def _gpkg(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_layers(spark: SparkSession, path: str) -> DataFrame:
    """(path, layer, n) of the feature layers of GeoPackages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                con = _gpkg(content.as_py())
                layers = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
                counts = [con.execute(f"SELECT count(*) FROM {_quoted(x)}").fetchone()[0] for x in layers]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(layers), pa.string()), pa.array(layers, pa.string()), pa.array(counts, pa.int64())], names=["path", "layer", "n"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, layer string, n bigint")


def _features(path: str, rows: Iterator[tuple[int, dict, bytes | list | None]]) -> pa.RecordBatch:
    cols: tuple[list, ...] = ([], [], [], [], [], [])
    for number, attributes, geometry in rows:
        parts = wkb_parts(geometry) if isinstance(geometry, bytes) else geometry or []
        for k, (kind, rings) in enumerate(parts or [(None, None)]):
            for col, v in zip(cols, (path, number, k, kind, json.dumps(attributes, default=str), rings)):
                col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], names=_NAMES)


def read_geopackage(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Features of one layer: attributes as JSON, one row a part; a feature without geometry has null rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                con = _gpkg(content.as_py())
                column = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                if column is None:
                    raise ValueError(f"{name} has no feature layer {layer}")
                cursor = con.execute(f"SELECT * FROM {_quoted(layer)}")
                names = [c[0] for c in cursor.description]
                at = names.index(column[0])

                def rows(cursor=cursor, names=names, at=at):
                    for i, r in enumerate(cursor):
                        blob = r[at]
                        # magic, version, flags, srs id, then an envelope whose size the flags tell
                        body = None if blob is None or blob[3] & 0x10 else blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]
                        yield i, {n: v for k, (n, v) in enumerate(zip(names, r)) if k != at}, body

                yield _features(name, rows())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FEATURES)


def shape_parts(content: bytes) -> Iterator[list[tuple[str, list[list[dict]]]]]:
    """Parts of each record of a .shp file: outer rings (clockwise) with the holes that follow them."""
    at = 100
    while at + 8 <= len(content):
        size = 2 * struct.unpack_from(">i", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", body)[0] % 10
        if kind == 1:
            x, y = struct.unpack_from("<2d", body, 4)
            yield [("Point", [[{"x": x, "y": y}]])]
        elif kind in (3, 5):
            n, m = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n}i", body, 44), m]
            flat = struct.unpack_from(f"<{2 * m}d", body, 44 + 4 * n)
            lines = [[{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
            if kind == 3:
                yield [("LineString", [line]) for line in lines]
                continue
            parts: list[tuple[str, list]] = []
            for ring in lines:
                turn = sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:]))
                if turn <= 0 or not parts:
                    parts.append(("Polygon", [ring]))
                else:
                    parts[-1][1].append(ring)
            yield parts
        else:
            yield []


def table_rows(content: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    """Rows of a .dbf file as text and numbers; deleted rows are left out."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("ascii")
        fields.append((name, chr(content[at + 11]), content[at + 16]))
        at += 32
    for i in range(n):
        row, at = {}, head + i * size + 1
        if content[at - 1 : at] == b"*":
            continue
        for name, kind, width in fields:
            text = content[at : at + width].decode(encoding, "replace").strip(" \0")
            at += width
            row[name] = (float(text) if "." in text or "e" in text.lower() else int(text)) if kind in "NF" and text and not set(text) <= set("*") else text or None
        yield row


def read_shapefile(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the shapefiles in a folder: .shp and .dbf files are brought together by their name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder).select("path", "content")
    named = files.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("name"), F.col("path").endswith("shp").alias("shape"), "content")
    both = named.groupBy("name").agg(F.max(F.when(F.col("shape"), F.col("content"))).alias("shp"), F.max(F.when(~F.col("shape"), F.col("content"))).alias("dbf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, shp, dbf in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                shapes = shape_parts(shp.as_py())
                rows = table_rows(dbf.as_py()) if dbf.as_py() is not None else iter(())
                yield _features(f"{name}.shp", ((i, next(rows, {}), parts) for i, parts in enumerate(shapes)))

    return both.where("shp IS NOT NULL").mapInArrow(run, FEATURES)


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cells of a worksheet as text, row by row; gaps are null."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        tree = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for r in tree.iterfind(".//m:row", ns):
        row: list[str | None] = []
        for c in r.findall("m:c", ns):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = 0
            for x in letters[0] if letters else "":
                at = 26 * at + ord(x) - 64
            at = at - 1 if letters else len(row)
            row += [None] * (at + 1 - len(row))
            value, text = c.find("m:v", ns), c.find("m:is", ns)
            if c.get("t") == "s" and value is not None:
                row[at] = shared[int(value.text)]
            elif text is not None:
                row[at] = "".join(t.text or "" for t in text.iter(f"{{{ns['m']}}}t"))
            elif value is not None:
                row[at] = value.text
        out.append(row)
    return out


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells as JSON by header) of the rows under a worksheet's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                head, *rows = sheet_rows(content.as_py(), sheet) or [[]]
                cells = [json.dumps({str(h): v for h, v in zip(head, r)}) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(cells, pa.string())], names=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row bigint, cells string")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link) of the entries of ATOM feeds, by their namespace."""
    atom = "{http://www.w3.org/2005/Atom}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(0):
                for e in ElementTree.fromstring(content.as_py()).iter(f"{atom}entry"):
                    link = e.find(f"{atom}link")
                    rows.append((e.findtext(f"{atom}title"), None if link is None else link.get("href")))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.string())], names=["title", "link"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "title string, link string")


def download(url: str, path: str, tries: int = 4, wait: float = 1.0) -> int:
    """Fetch a file in pieces, again after an error; the file appears whole or not at all. Returns its bytes."""
    import os
    import time
    from urllib.request import urlopen

    for turn in range(tries):
        try:
            with urlopen(url) as answer, open(f"{path}.part", "wb") as out:  # noqa: S310
                size = 0
                while piece := answer.read(1 << 20):
                    size += out.write(piece)
            os.replace(f"{path}.part", path)
            return size
        except OSError:
            if turn + 1 == tries:
                raise
            time.sleep(wait * 2**turn)
    return 0
