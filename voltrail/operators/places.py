"""Positions against reference tables: nearest weather station, hourly weather, areas.

Stations and outlines may be tables of any size. Both are joined by cells of a grid, so a
position meets only what lies around it; which side is broadcast is left to Spark, which
knows the sizes of the written tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import scalars
from voltrail.operators import rows as R
from voltrail.sources.stage import staged

#: Stations that one cell may hold from the start: so few are compared with every position.
FEW_STATIONS = 64
#: How much wider the cells of the next ring are.
WIDER = 4.0
#: Degrees of a tile's side, and where the grid begins: off round numbers, so that vertices lie on no line of the grid.
TILE, ORIGIN = 0.1, -0.0123456789
METRES_A_DEGREE = math.pi * scalars.EARTH_KM * 1_000 / 180


def _sphere(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def nearest_station(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds station_id and station_km to each position; of stations equally near the one of the least id. Found once for each different position.

    A search by rings: positions and stations are points of the sphere in cubes. All stations within a cube's side
    of a position lie in its cube or the cubes around it; if one of them is so near, the nearest is among them.
    Positions without such a station look again in wider cubes, at last in one that holds all stations.
    """
    xyz = ("x", "y", "z")
    known = stations.where("latitude is not null and longitude is not null").select(F.col("station_id").cast("string"), *(c.alias(k) for k, c in zip(xyz, _sphere(F.col("latitude"), F.col("longitude")))))
    places = df.select("latitude", "longitude").where("latitude is not null and longitude is not null").distinct()
    left = places.select("*", *(c.alias(k) for k, c in zip(xyz, _sphere(F.col("latitude"), F.col("longitude")))))
    n = known.count()
    known = known if n <= FEW_STATIONS else staged(known)
    side = 2.0 if n <= FEW_STATIONS else 2 * math.sqrt(4 * math.pi / n)
    found = []
    while True:
        last = side >= 2
        cell = lambda c: F.floor(F.col(c) / side).cast("int") if not last else F.lit(0)  # noqa: B023, E731
        around = F.sequence(F.lit(-1), F.lit(1)) if not last else F.array(F.lit(0))
        near = known
        for c in xyz:
            near = near.withColumn(f"_{c}", F.explode(F.transform(around, lambda d: cell(c) + d)))  # noqa: B023
        near = near.groupBy("_x", "_y", "_z").agg(F.collect_list(F.struct("station_id", *xyz)).alias("_near"))
        # squares of chords; the difference of coordinates keeps small distances exact
        off = lambda s: sum(((s[c] - F.col(c)) * (s[c] - F.col(c)) for c in xyz), F.lit(0.0))
        best = F.array_min(F.transform("_near", lambda s: F.struct(off(s).alias("d"), s["station_id"].alias("id"))))
        told = left.withColumns({f"_{c}": cell(c) for c in xyz}).join(near, ["_x", "_y", "_z"], "left").withColumn("_best", best)
        told = told.select("latitude", "longitude", *xyz, "_best")
        if last:
            found.append(told)
            break
        told = staged(told)
        sure = F.coalesce(F.col("_best.d") <= side * side, F.lit(False))
        found.append(told.where(sure))
        left = told.where(~sure).drop("_best")
        if left.isEmpty():
            break
        side *= WIDER
    km = F.when(F.col("_best").isNotNull(), 2 * scalars.EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("_best.d") / 2)))
    every = reduce(DataFrame.unionByName, found).select("latitude", "longitude", F.col("_best.id").alias("station_id"), km.alias("station_km"))
    return df.join(every, ["latitude", "longitude"], "left")


def hourly_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Joins the station's row of the hour (floored)."""
    return df.withColumn("hour", F.date_trunc("hour", R.TIME)).join(weather, ["station_id", "hour"], "left")


def suspect_temperatures(df: DataFrame, most: float = 5.0) -> DataFrame:
    return df.withColumn("temp_suspect", scalars.temperature_suspect(F.col("outside_temp"), F.col("temp"), most))


@dataclass(frozen=True)
class Areas:
    """An index of polygons by tiles: rows of ix, iy, areas (odd: the lower left corner is inside; edges in or near the tile)."""

    tiles: DataFrame
    size: float
    buffer_m: float


def _tile(c: Column, size: float) -> Column:
    return F.floor((c - ORIGIN) / size).cast("int")


def _corner(i: Column, size: float) -> Column:
    return i * size + ORIGIN


def _edges(polygons: DataFrame) -> DataFrame:
    """p, x1, y1, x2, y2: the sides of all rings, of which the last closes the ring."""
    numbered = polygons.withColumn("p", F.monotonically_increasing_id())  # before rings become rows
    rings = numbered.select("p", F.explode("rings").alias("r")).where(F.size("r") > 0)
    following = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", 1, 1))
    sides = rings.select("p", F.explode(F.arrays_zip(F.col("r").alias("a"), following.alias("b"))).alias("s"))
    out = sides.select("p", *(F.col(f"s.{e}.{c}").cast("double").alias(n) for e, c, n in (("a", "lon", "x1"), ("a", "lat", "y1"), ("b", "lon", "x2"), ("b", "lat", "y2"))))
    return out.where("x1 <> x2 or y1 <> y2")


def index(polygons: DataFrame, buffer_m: float = 0.0, size: float = TILE) -> Areas:
    """Polygons (rings of {lon, lat}, even-odd, so that holes are rings within rings) cut into tiles.

    An edge goes to the tiles that it passes or comes near (by the buffer). For each polygon and row of tiles, the
    crossings of its edges with the row's lower line tell which of the tiles' corners are inside. Tiles between two
    tiles with edges are inside as a whole or outside. A polygon may not cross the 180th meridian.
    """
    edges = staged(_edges(polygons))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    high = F.lit(buffer_m / METRES_A_DEGREE)
    wide = high / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(y1), F.abs(y2)) + high))), F.lit(1e-3))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    columns = edges.withColumns({"_w": wide, "ix": F.explode(F.sequence(_tile(left - wide, size), _tile(right + wide, size)))})
    # the part of the edge over a column of tiles
    from_x, to_x = F.greatest(left, _corner(F.col("ix"), size) - F.col("_w")), F.least(right, _corner(F.col("ix") + 1, size) + F.col("_w"))
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (x - x1) * (y2 - y1) / (x2 - x1))
    ends = (at(from_x), at(to_x))
    low, top = (F.when(x1 == x2, f(y1, y2)).otherwise(f(*ends)) for f in (F.least, F.greatest))
    edge = F.struct("x1", "y1", "x2", "y2")
    passed = columns.withColumn("iy", F.explode(F.sequence(_tile(low - high, size), _tile(top + high, size))))
    held = passed.groupBy("p", "ix", "iy").agg(F.collect_list(edge).alias("edges"))
    # crossings of the rows' lower lines
    rows = edges.withColumn("iy", F.explode(F.sequence(_tile(F.least(y1, y2), size), _tile(F.greatest(y1, y2), size) + 1)))
    line = _corner(F.col("iy"), size)
    crossed = rows.where((y1 > line) != (y2 > line)).select("p", "iy", (x1 + (line - y1) * (x2 - x1) / (y2 - y1)).alias("x"), F.lit(1).alias("cross"))
    corners = held.select("p", "iy", "ix", "edges", F.explode(F.array(F.lit(0), F.lit(1))).alias("next"))
    corners = corners.select("p", "iy", "ix", "next", F.when(F.col("next") == 0, F.col("edges")).alias("edges"), _corner(F.col("ix") + F.col("next"), size).alias("x"), F.lit(0).alias("cross"))
    row = Window.partitionBy("p", "iy")
    counted = corners.unionByName(crossed, allowMissingColumns=True).withColumn("odd", F.sum("cross").over(row.orderBy(F.desc("x"), "cross").rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    counted = counted.where("cross = 0")
    border = counted.where("next = 0").select("p", "ix", "iy", "odd", "edges")
    following = F.min(F.when(F.col("next") == 0, F.col("ix"))).over(row.orderBy(F.desc("ix"), F.desc("next")).rowsBetween(Window.unboundedPreceding, -1))
    gaps = counted.withColumn("to", following).where("next = 1 and odd and to > ix + 1")
    inner = gaps.select("p", F.explode(F.sequence(F.col("ix") + 1, F.col("to") - 1)).alias("ix"), "iy", F.lit(True).alias("odd"), F.expr("cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>)").alias("edges"))
    tiles = border.unionByName(inner).groupBy("ix", "iy").agg(F.collect_list(F.struct("odd", "edges")).alias("areas"))
    return Areas(staged(tiles), size, buffer_m)


def _contains(areas: Areas, x: Column, y: Column) -> Column:
    """Whether any area holds the point: edges crossed on the way from the tile's corner, first up, then right, or one within the buffer."""
    x0, y0 = F.col("_x0"), F.col("_y0")

    def crossed(e: Column) -> Column:
        up = e["y1"] + (x0 - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        along = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        on_wall = F.when((e["x1"] > x0) != (e["x2"] > x0), ((up > y0) & (up <= y)).cast("int")).otherwise(0)
        on_line = F.when((e["y1"] > y) != (e["y2"] > y), ((along > x0) & (along <= x)).cast("int")).otherwise(0)
        return on_wall + on_line

    def near(e: Column) -> Column:
        shrink = F.cos(F.radians(y))
        ax, ay, bx, by = (e["x1"] - x) * shrink, e["y1"] - y, (e["x2"] - x) * shrink, e["y2"] - y
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
        px, py = ax + t * dx, ay + t * dy
        return px * px + py * py <= (areas.buffer_m / METRES_A_DEGREE) ** 2

    def holds(a: Column) -> Column:
        n = F.aggregate(a["edges"], a["odd"].cast("int"), lambda s, e: s + crossed(e))
        return (n % 2 == 1) | F.exists(a["edges"], near) if areas.buffer_m > 0 else n % 2 == 1

    return F.exists("_areas", holds)


def with_areas(df: DataFrame, areas: Areas, name: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """`df` with `name`: whether a position lies in an area or within the buffer around one; null positions lie in none."""
    tiles = areas.tiles.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("areas").alias("_areas"))
    x, y = F.col(lon), F.col(lat)
    placed = df.withColumns({"_tx": _tile(x, areas.size), "_ty": _tile(y, areas.size)})
    joined = placed.join(tiles, (F.col("_tx") == F.col("_ix")) & (F.col("_ty") == F.col("_iy")), "left")
    joined = joined.withColumns({"_x0": _corner(F.col("_tx"), areas.size), "_y0": _corner(F.col("_ty"), areas.size)})
    return joined.withColumn(name, F.coalesce(_contains(areas, x, y), F.lit(False))).drop("_tx", "_ty", "_ix", "_iy", "_areas", "_x0", "_y0")


def outside_area(df: DataFrame, areas: Areas) -> DataFrame:
    """trip_id, latitude, longitude of positions in none of the areas, buffers included."""
    placed = df.where("latitude is not null and longitude is not null")
    return with_areas(placed, areas, "_inside").where("not _inside").select(R.TRIP, "latitude", "longitude")


def on_land(df: DataFrame, areas: Areas, name: str = "land") -> DataFrame:
    return with_areas(df, areas, name)
