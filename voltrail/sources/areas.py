"""Outlines of areas from files: GeoJSON, and GeoPackages of one country each.

Both give country and rings (arrays of {lon, lat}, one row a feature), the table that
places.index takes; several rows are a union. Coordinates are degrees.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<lon:double,lat:double>>>"
_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
#: Bytes of a geometry's envelope by its kind.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _rings(points: Column) -> Column:
    return F.transform(points, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))


def geojson(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Polygons and multipolygons of collections of features; name: the property that tells the country. Other geometries are passed over."""
    f = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    kind, told = F.col("geometry.type"), F.col("geometry.coordinates")
    one = F.from_json(told, "array<array<array<double>>>")
    several = F.flatten(F.from_json(told, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", several)
    return f.select(F.col("properties")[name].alias("country"), _rings(rings).alias("rings")).where("rings is not null")


def _well_known(b: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """Rings of a polygon or multipolygon in well-known binary, and where it ends; points of more than two values are cut."""
    order = "<" if b[at] else ">"
    (kind,) = struct.unpack_from(f"{order}I", b, at + 1)
    at, size = at + 5, 2 + {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
    (n,) = struct.unpack_from(f"{order}I", b, at)
    at, out = at + 4, []
    if kind % 1000 == 6:
        for _ in range(n):
            rings, at = _well_known(b, at)
            out += rings
    elif kind % 1000 == 3:
        for _ in range(n):
            (points,) = struct.unpack_from(f"{order}I", b, at)
            out.append(np.frombuffer(b, f"{order}f8", points * size, at + 4).reshape(points, size)[:, :2])
            at += 4 + 8 * points * size
    else:
        raise ValueError(f"no area: geometry of type {kind}")
    return out, at


def _read_package(content: bytes) -> Iterator[list[np.ndarray]]:
    """Rings of each feature of a package's layer of countries, whose name ends in _0."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    layers = [x for x in con.execute("select table_name, column_name from gpkg_geometry_columns") if x[0].endswith("_0")]
    if not layers:
        raise ValueError("no layer of countries")
    table, column = (x.replace('"', '""') for x in layers[0])
    for (g,) in con.execute(f'select "{column}" from "{table}" where "{column}" is not null'):
        yield _well_known(g, 8 + _ENVELOPE[g[3] >> 1 & 7])[0]
    con.close()


def _packages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, content in zip(f["path"], f["content"]):
            country = re.sub(r"^gadm\d*_", "", path.rpartition("/")[2].rpartition(".")[0])
            rings = [[[{"lon": float(x), "lat": float(y)} for x, y in r] for r in feature] for feature in _read_package(content)]
            yield pd.DataFrame({"country": [country] * len(rings), "rings": rings})


def countries(spark: SparkSession, directory: str, codes: Sequence[str]) -> DataFrame:
    """The outlines of countries from packages named gadm41_<code>.gpkg, a file a task; codes without a file are passed over."""
    wanted = F.regexp_extract("path", r"gadm41_([^/]*)\.gpkg$", 1).isin(list(codes))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "gadm41_*.gpkg").load(directory).where(wanted).select("path", "content")
    return files.repartition(max(1, len(codes))).mapInPandas(_packages, f"country string, rings {RINGS}")
