"""Areas by tiles, stations by rings, cells of the hexagonal grid: against plain versions and published values."""

import json
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.functions import cells, scalars
from voltrail.operators import clean, places
from voltrail.sources import areas


def inside(rings, x, y):
    """Even-odd rule over all rings."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]]):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return odd


def table(spark, shapes):
    return spark.createDataFrame([(str(k), [[{"lon": a, "lat": b} for a, b in r] for r in rings]) for k, rings in enumerate(shapes)], "country string, rings array<array<struct<lon:double,lat:double>>>")


def ragged(r, x, y, n, wide):
    return [(x + wide * (0.4 + r.random()) * math.cos(k * math.tau / n), y + wide * (0.4 + r.random()) * math.sin(k * math.tau / n)) for k in range(n)]


@pytest.mark.parametrize("size", [0.05, 0.3, 7.0])
def test_areas_are_even_odd(spark, size):
    r = random.Random(3)
    shapes = [[ragged(r, 5, 45, 60, 2)], [ragged(r, 9, 44, 25, 1.5), ragged(r, 9, 44, 9, 0.4)], [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]], [ragged(r, -70, -30, 12, 0.02)], [[]]]
    points = [(r.uniform(-1, 12), r.uniform(-1, 48)) for _ in range(1500)] + [(r.gauss(-70, 0.03), r.gauss(-30, 0.03)) for _ in range(300)] + [(5.0, 5.0), (5.0, 1.0), (200.0, 95.0), (-70.0, -30.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "i long, longitude double, latitude double")
    got = {x["i"]: x["in"] for x in places.with_areas(df, places.index(table(spark, shapes), size=size), "in").collect()}
    assert got == {**{k: any(inside(s, *p) for s in shapes) for k, p in enumerate(points)}, -1: False, -2: False}


def test_buffer_in_metres(spark):
    """900 m outside an edge or a corner is within a buffer of 1 km, 1,100 m is not; on all sides, also in the north."""
    rows = []
    for lat in (0.0, 45.0, 68.0):
        square = [(10.0, lat), (10.5, lat), (10.5, lat + 0.5), (10.0, lat + 0.5)]
        for m in (900.0, 1100.0):
            up = m / places.METRES_A_DEGREE
            across = up / math.cos(math.radians(lat + 0.25))
            slant = up / math.sqrt(2)
            for x, y in ((9.99999999 - across, lat + 0.25), (10.5 + across, lat + 0.25), (10.25, lat - up), (10.25, lat + 0.5 + up), (10.5 + slant / math.cos(math.radians(lat + 0.5 + slant)), lat + 0.5 + slant)):
                rows.append((lat, x, y, m < 1000))
        near = places.index(table(spark, [[square]]), buffer_m=1000)
        df = spark.createDataFrame([r for r in rows if r[0] == lat], "at double, longitude double, latitude double, want boolean")
        assert places.with_areas(df, near, "got").where("got <> want").collect() == []
        assert places.outside_area(df.withColumn("trip_id", F.lit("t")), near).count() == 5


def test_areas_do_not_broadcast_outlines(spark):
    tiles = places.index(table(spark, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]])).tiles
    most = tiles.select(F.max(F.aggregate("areas", F.lit(0), lambda s, a: s + F.size(a["edges"]))).alias("n"), F.count("*").alias("tiles")).first()
    assert most["n"] <= 3 and most["tiles"] > 40
    assert places.index(table(spark, [])).tiles.count() == 0


def km(a, b):
    (p, q), (r, s) = (np.radians(x) for x in (a, b))
    u, v = (np.array([math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)]) for y, x in ((p, q), (r, s)))
    return 2 * scalars.EARTH_KM * math.asin(min(1, np.linalg.norm(u - v) / 2))


@pytest.mark.parametrize("n, few", [(0, 64), (3, 64), (60, 64), (60, 1), (700, 64)])
def test_nearest_station_is_brute_force(spark, monkeypatch, n, few):
    """At the poles, across the date line, among clusters and far from all stations."""
    monkeypatch.setattr(places, "FEW_STATIONS", few)
    r = random.Random(n)
    stations = [(f"s{k:03d}", *r.choice([(r.uniform(-90, 90), r.uniform(-180, 180)), (r.gauss(50, 0.1), r.gauss(8, 0.1)), (89.9 - r.random(), r.uniform(-180, 180)), (r.uniform(-20, 20), 179.9), (r.uniform(-20, 20), -179.9)])) for k in range(n)]
    stations += [("s900", *stations[0][1:])] if n else []
    points = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (5.0, 179.999), (50.0, 8.0), *((r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(150))]
    df = spark.createDataFrame([*points, points[5], (None, 1.0)], "latitude double, longitude double")
    out = places.nearest_station(df, spark.createDataFrame(stations, "station_id string, latitude double, longitude double")).collect()
    assert len(out) == len(points) + 2
    for x in out:
        if x["latitude"] is None or not n:
            assert x["station_id"] is None and x["station_km"] is None
            continue
        far = {i: km((x["latitude"], x["longitude"]), p) for i, *p in stations}
        assert x["station_km"] == pytest.approx(min(far.values()), abs=1e-6)
        assert far[x["station_id"]] == pytest.approx(min(far.values()), abs=1e-6) and x["station_id"] != "s900"


#: Published examples of the grid's documentation: index, latitude, longitude.
PUBLISHED = [("85283473fffffff", 37.34579337536848, -121.97637597255124), ("8928308280fffff", 37.77670234943567, -122.41845932318311)]


def test_published_cell_centres(spark):
    df = spark.createDataFrame([(int(h, 16), str(int(h, 16)), a, b) for h, a, b in PUBLISHED], "h long, t string, lat double, lon double")
    for c in ("h", "t"):
        for x in df.withColumn("p", cells.cell_center(F.col(c))).collect():
            assert x["p"]["latitude"] == pytest.approx(x["lat"], abs=1e-6) and x["p"]["longitude"] == pytest.approx(x["lon"], abs=1e-6)


def index_of(base, digits):
    h = 8 << 56 | len(digits) << 52 | base << 45
    for r in range(15):
        h |= (digits[r] if r < len(digits) else 7) << 3 * (14 - r)
    return h


PENTAGONS = [k for k, c in enumerate(cells.BASE_CELLS) if c[3]]


def test_base_cells():
    assert len(cells.BASE_CELLS) == 122 and PENTAGONS == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_cells_tile_the_sphere(spark, res):
    """All cells of a resolution have different centres, evenly spread, and lie near their parents: pentagons and edges of faces too."""
    import itertools

    # whole subtrees of the pentagons and some others at the finest, all cells above
    bases = range(122) if res < 3 else [*PENTAGONS[:4], 0, 1, 11, 39, 120]
    every = [(b, d) for b in bases for d in itertools.product(range(7), repeat=res) if not (b in PENTAGONS and next((x for x in d if x), 0) == 1)]
    assert res == 3 or len(every) == 2 + 120 * 7**res
    df = spark.createDataFrame([(k, index_of(b, d), index_of(b, d[:-1])) for k, (b, d) in enumerate(every)], "k long, h long, parent long")
    out = df.select("k", cells.cell_center(F.col("h")).alias("p"), cells.cell_center(F.col("parent")).alias("q")).orderBy("k").collect()
    xyz = lambda s: np.array([[math.cos(math.radians(x[s]["latitude"])) * f(math.radians(x[s]["longitude"])) for f in (math.cos, math.sin)] + [math.sin(math.radians(x[s]["latitude"]))] for x in out])
    p, q = xyz("p"), xyz("q")
    unit = 2 * cells.UNIT / 7 ** (res / 2) / 2
    if res:
        # a child's centre lies one step of its own lattice from its parent's
        assert np.linalg.norm(p - q, axis=1).max() < 1.5 * unit
    order = np.lexsort(p.T)
    near = min(np.linalg.norm(p[order[i + 1 : i + 200]] - p[i2], axis=1).min() for i, i2 in enumerate(order[:-1]))
    assert near > 0.45 * unit


def test_invalid_cells_have_no_centre(spark):
    good = index_of(20, [1, 2])
    bad = [0, -1, good ^ 1 << 52, good | 1 << 56, good & ~(1 << 59), index_of(122, []), index_of(4, [1]), index_of(4, [0, 1]), index_of(20, [7, 1]), good ^ 1]
    told = [None, "", "x", hex(good), "1.5", str(good) + "0"]
    df = spark.createDataFrame([(h,) for h in bad], "h long").select(cells.cell_center(F.col("h")).alias("p"))
    text = spark.createDataFrame([(t,) for t in told], "t string").select(cells.cell_center(F.col("t")).alias("p"))
    for x in [*df.collect(), *text.collect()]:
        assert tuple(x["p"]) == (None, None)
    assert spark.createDataFrame([(good,)], "h long").select(cells.cell_center(F.col("h")).alias("p")).first()["p"]["latitude"] is not None
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_positions_of_cells(spark):
    good = index_of(20, [1, 2])
    df = spark.createDataFrame([(1, str(good)), (2, "x"), (3, None)], "i int, current_location string")
    got = {x["i"]: (x["latitude"], x["longitude"]) for x in clean.with_positions(df).collect()}
    assert None not in got[1] and got[2] == got[3] == (None, None)
    assert clean.with_positions(df.drop("current_location")).columns == ["i"]
    assert clean.valid_positions(clean.with_positions(df)).count() == 1


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
ISLAND = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 10.0)]


def where(spark, areas):
    points = [(0.5, 0.5), (1.5, 1.5), (10.8, 10.2), (8.0, 8.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, longitude double, latitude double")
    return [x["in"] for x in places.with_areas(df, places.index(areas), "in").orderBy("k").collect()]


def test_areas_of_geojson(spark, tmp_path):
    shape = lambda kind, c, code: {"type": "Feature", "properties": {"GID_0": code, "n": 1}, "geometry": {"type": kind, "coordinates": c}}
    told = {"type": "FeatureCollection", "features": [shape("Polygon", [SQUARE, HOLE], "AAA"), shape("MultiPolygon", [[ISLAND]], "BBB"), shape("Point", [1, 2], "CCC")]}
    (tmp_path / "a.geojson").write_text(json.dumps(told, indent=1))
    found = areas.geojson(spark, f"{tmp_path}/a.geojson", "GID_0")
    assert sorted(x["country"] for x in found.collect()) == ["AAA", "BBB"]
    assert where(spark, found) == [True, False, True, False]


def test_areas_of_packages(spark, tmp_path):
    def polygon(order, rings, z=0):
        out = struct.pack(f"{order}BII", order == "<", 3 + 1000 * z, len(rings))
        return out + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + z}d", *p, *[7.0] * z) for p in r) for r in rings)

    def package(code, *geometries, layer="ADM_ADM_0"):
        con = sqlite3.connect(tmp_path / f"gadm41_{code}.gpkg")
        con.executescript(f"create table gpkg_geometry_columns (table_name text, column_name text); create table {layer} (geom blob); create table ADM_ADM_1 (geom blob)")
        con.executemany("insert into gpkg_geometry_columns values (?, 'geom')", [("ADM_ADM_1",), (layer,)])
        con.executemany(f"insert into {layer} values (?)", [(g,) for g in geometries])
        con.commit()
        con.close()

    head = lambda envelope=0: b"GP" + struct.pack("<BBi", 0, 1 | envelope << 1, 4326) + b"\0" * {0: 0, 1: 32}[envelope]
    package("AAA", head(1) + polygon("<", [SQUARE, HOLE]), None)
    package("BBB", head() + struct.pack(">BII", 0, 1006, 1) + polygon(">", [ISLAND], 1))
    package("CCC", head() + polygon("<", [SQUARE]), layer="ADM_ADM_2")
    found = areas.countries(spark, str(tmp_path), ["AAA", "BBB", "ZZZ"])
    assert sorted(x["country"] for x in found.collect()) == ["AAA", "BBB"]
    assert where(spark, found) == [True, False, True, False]
    with pytest.raises(Exception, match="no layer of countries"):
        areas.countries(spark, str(tmp_path), ["CCC"]).collect()
