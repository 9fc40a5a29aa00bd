"""Centres of hexagonal grid cells (H3 indexes) as column arithmetic.

A cell's index names a base cell and up to 15 digits. Base cells lie on the faces of an
icosahedron; each digit steps to one of seven children on a lattice that is finer by
the square root of 7 and turned. The lattice is kept in two axial coordinates (a, b), in
which steps, turns and refinements are small integer matrices. A point that has left its
face goes on in the coordinates of the face beyond the edge, and the place on the face
is projected onto the sphere (inverse gnomonic projection).

The faces' centres and axes are fixed values of the grid. All else follows from them: the
edges' coordinate changes from the vertices that two faces share, the 122 base cells from
their places on the faces, numbered from north to south.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the grid: latitude and longitude of each face's centre, and the azimuth of its first axis, in radians
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# fixed values of the grid: the gnomonic length of a base cell's unit, and the faces at whose first axis' end a pentagon is at home
UNIT = 0.38196601125010500003
PENTAGON_FACES = (0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 19)

#: Axial steps of the digits 0 to 6 (the last is no digit), and the same turned clockwise by a sixth.
STEPS = ((0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1), (0, 0))
TURNED = tuple((b, b - a) for a, b in STEPS)
_VERTICES = ((2, 0), (0, 2), (-2, -2))


def _placed(face: int, a: float, b: float) -> np.ndarray:
    """The unit vector of a point of a face, in units of base cells."""
    lat, lon, axis = FACES[face]
    x, y = a - b / 2, b * math.sqrt(3) / 2
    d, azimuth = math.atan(math.hypot(x, y) * UNIT), axis - math.atan2(y, x)
    up = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
    north = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)])
    east = np.array([-math.sin(lon), math.cos(lon), 0.0])
    return up * math.cos(d) + (north * math.cos(azimuth) + east * math.sin(azimuth)) * math.sin(d)


def _crossings() -> list[tuple[int, ...]]:
    """For each face and edge (a-b, c-a, b-c): the face beyond and its coordinates, (a, b) times a matrix plus a shift."""
    corners = [[_placed(f, *v) for v in _VERTICES] for f in range(20)]
    out = []
    for f in range(20):
        for p, q in ((0, 1), (2, 0), (1, 2)):
            for g in (g for g in range(20) if g != f):
                found = [next((k for k in range(3) if np.linalg.norm(corners[g][k] - corners[f][e]) < 1e-9), None) for e in (p, q)]
                if None not in found:
                    break
            turn = np.eye(2, dtype=int)
            ends, goals = np.array([_VERTICES[p], _VERTICES[q]]), np.array([_VERTICES[k] for k in found])
            while (shift := goals - ends @ turn.T)[0].tolist() != shift[1].tolist():
                turn = np.array([[1, -1], [1, 0]]) @ turn
            out.append((g, *turn.ravel().tolist(), *shift[0].tolist()))
    return out


def _base_cells() -> list[tuple[int, int, int, bool]]:
    """face, a, b, is a pentagon, from north to south: cells inside the faces, on the edges (each of one face), and on the vertices."""
    inner, edges = [(0, 0), (1, 0), (0, 1), (-1, -1)], (((1, 1), (-1, 0)), ((0, -1),), ((1, 1),), ((-1, 0), (0, -1)))
    cells = [(f, *p, False) for f in range(20) for p in (*inner, *edges[f // 5])] + [(f, 2, 0, True) for f in PENTAGON_FACES]
    return sorted(cells, key=lambda c: -_placed(*c[:3])[2])


CROSSINGS, BASE_CELLS = _crossings(), _base_cells()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _table(rows: list[tuple], i: Column, k: int) -> Column:
    return F.get(F.array(*(F.lit(r[k]) for r in rows)), i)


def _bits(h: Column, at: int, mask: int) -> Column:
    return F.shiftright(h, at).bitwiseAND(F.lit(mask))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def _read(h: Column) -> Column:
    """res, base, digits (15) and pentagon of an index."""
    digits = F.array(*(_bits(h, 3 * (15 - r), 7).cast("int") for r in range(1, 16)))
    base = _bits(h, 45, 127).cast("int")
    return F.struct(_bits(h, 52, 15).cast("int").alias("res"), base.alias("base"), digits.alias("digits"), F.coalesce(_table(BASE_CELLS, base, 3), F.lit(False)).alias("pentagon"), F.shiftright(h, 56).alias("kind"))


def _leading(c: Column) -> Column:
    """The first digit that is not 0; 0 if there is none."""
    return F.aggregate(F.slice(c["digits"], 1, c["res"]), F.lit(0), lambda s, d: F.when(s == 0, d).otherwise(s))


def _valid(c: Column) -> Column:
    """Of cells' kind (mode 1, reserved bits 0), with a base cell, digits 0 to 6 as far as the resolution and 7 beyond; a pentagon has no first child."""
    used, unused = F.slice(c["digits"], 1, c["res"]), F.slice(c["digits"], c["res"] + 1, F.lit(15))
    return (c["kind"] == 8) & (c["base"] < len(BASE_CELLS)) & F.forall(used, lambda d: d < 7) & F.forall(unused, lambda d: d == 7) & ~(c["pentagon"] & (_leading(c) == 1))


def _walked(c: Column) -> Column:
    """The lattice point of the digits, from the base cell's; resolutions of odd number end on the next finer lattice, which is not turned."""
    turned = c["pentagon"] & (_leading(c) == 5)  # of a pentagon's six children one is missing; the fifth's side closes up
    steps = [*STEPS, *TURNED]
    finer = lambda s, r: _pair(F.when(r % 2 == 1, 2 * s["a"] + s["b"]).otherwise(3 * s["a"] - s["b"]), F.when(r % 2 == 1, 3 * s["b"] - s["a"]).otherwise(s["a"] + 2 * s["b"]))

    def step(s: Column, r: Column) -> Column:
        i = F.get(c["digits"], r - 1) + F.when(turned, len(STEPS)).otherwise(0)
        return _let(finer(s, r), lambda t: _pair(t["a"] + _table(steps, i, 0), t["b"] + _table(steps, i, 1)))

    start = _pair(_table(BASE_CELLS, c["base"], 1), _table(BASE_CELLS, c["base"], 2))
    at = F.aggregate(F.when(c["res"] > 0, F.sequence(F.lit(1), c["res"])).otherwise(F.expr("cast(array() as array<int>)")), start, step)
    return _let(at, lambda s: F.when(c["res"] % 2 == 1, finer(s, F.lit(0))).otherwise(s))


def _on_face(c: Column) -> Column:
    """face, a, b and the lattice's unit, on the face that the point lies on."""
    unit = F.pow(F.lit(7.0), F.floor((c["res"] + 1) / 2)).cast("long")
    lead4 = c["pentagon"] & (_leading(c) == 4)
    state = lambda f, a, b, n: F.struct(f.cast("int").alias("f"), a.cast("long").alias("a"), b.cast("long").alias("b"), n.cast("int").alias("n"))

    def cross(s: Column, n: Column) -> Column:
        a, b = s["a"], s["b"]
        low = F.least(a, b, F.lit(0))
        outside = (a + b - 3 * low > 2 * unit) & (c["pentagon"] | (n == 0))
        edge = F.when(low == 0, 0).when(b == low, 1).otherwise(2)
        # beyond the c-a edge of a pentagon lies the missing child: the fourth's points turn about the vertex, clockwise
        bent = lead4 & (n == 0) & (edge == 1)
        p = F.when(bent, _pair(2 * unit + b, b - (a - 2 * unit))).otherwise(_pair(a, b))
        i = s["f"] * 3 + edge
        m = [_table(CROSSINGS, i, k) for k in range(7)]
        return F.when(outside, _let(p, lambda q: state(m[0], m[1] * q["a"] + m[2] * q["b"] + m[5] * unit, m[3] * q["a"] + m[4] * q["b"] + m[6] * unit, n + 1))).otherwise(s)

    at = _let(_walked(c), lambda p: state(_table(BASE_CELLS, c["base"], 0), p["a"], p["b"], F.lit(0)))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(5)), at, cross), lambda s: F.struct(s["f"].alias("f"), s["a"].alias("a"), s["b"].alias("b"), unit.alias("unit")))


def _projected(s: Column) -> Column:
    x, y = (s["a"] - s["b"] / 2) / s["unit"], s["b"] * F.lit(math.sqrt(3) / 2) / s["unit"]
    lat, lon, axis = (_table(list(FACES), s["f"], k) for k in range(3))
    d, azimuth = F.atan(F.sqrt(x * x + y * y) * UNIT), axis - F.atan2(y, x)
    up = F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(azimuth)
    there = lon + F.atan2(F.sin(azimuth) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * up)
    return F.struct(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))).alias("latitude"), (F.pmod(F.degrees(there) + 180, F.lit(360.0)) - 180).alias("longitude"))


def cell_center(index: Column) -> Column:
    """A struct of latitude and longitude, in degrees, of a cell's centre; both null if the index is none.

    index: an integer, or a string of its decimal digits.
    """
    h = index.try_cast("long")
    none = F.struct(F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    return F.when(h.isNull() | (h < 0), none).otherwise(_let(_read(h), lambda c: F.when(_valid(c), _let(_on_face(c), _projected)).otherwise(none)))
