"""Nearest polygon == brute force over all edges; ring faults == all pairs of edges."""
import math
import random

import pytest
from pyspark.sql import functions as F

from geoping.operators import nearest as NR
from geoping.operators import validity as V

from .conftest import POLY_SCHEMA, geom_rows, square
from .test_quadtree import star


def _away(px, py, ring):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = min(max(((px - x1) * dx + (py - y1) * dy) / n if n else 0.0, 0.0), 1.0)
        best = min(best, (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2)
    return best


POLYS = [(7, [[square(0, 0, 1)]]), (3, [[square(1, 0, 1)]]), (5, [[star(5, 5, 50, 2)], [square(-8, -3, 0.01)]]), (9, [[square(30, 20, 4), square(31, 21, 1)]])]


@pytest.mark.parametrize("cell", [0.02, 1.0])
def test_nearest(spark, cell):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-12, 40), rnd.uniform(-10, 30)) for i in range(300)] + [(300, 1.0, 2.0), (301, 1.0, 0.5), (302, -170.0, 80.0), (303, None, 1.0), (304, 0.0, 0.0)]
    points = spark.createDataFrame(pts, "id long, longitude double, latitude double")
    polys = spark.createDataFrame(geom_rows(POLYS), POLY_SCHEMA)
    got = {r.id: (r.nearest_id, r.distance) for r in NR.nearest_polygon(points, polys, "polygon_id", cell_size=cell).collect()}
    want = {}
    for i, x, y in pts:
        if x is not None:
            d, pid = min((min(_away(x, y, ring) for part in parts for ring in part), pid) for pid, parts in POLYS)
            want[i] = (pid, math.sqrt(d))
    assert got == want and got[300][0] == 3        # as near to 7: the lowest id


def test_nearest_of_nothing(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, longitude double, latitude double")
    none = spark.createDataFrame([(1, None)], POLY_SCHEMA)
    assert NR.nearest_polygon(points, none, "polygon_id").collect() == []
    assert NR.nearest_polygon(points.limit(0), spark.createDataFrame(geom_rows(POLYS), POLY_SCHEMA), "polygon_id").collect() == []


BOW_TIE = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]
SPIKE = [(0, 0), (4, 0), (2, 0), (2, 2), (0, 0)]
FIGURES = [(1, [[square(0, 0, 2)]]), (2, [[BOW_TIE]]), (3, [[square(0, 0, 4), square(1, 1, 1)]]), (4, [[square(0, 0, 4), square(6, 6, 1)]]),
           (5, [[square(0, 0, 4), [(0, 2), (1, 1), (1, 3), (0, 2)]]]), (6, [[SPIKE]]), (7, [[square(0, 0, 2)], [square(1, 1, 2)]]),
           (8, [[square(0, 0, 2)], [square(2, 0, 2)]]), (9, [[square(0, 0, 4), square(3, 3, 2)]]), (10, []), (11, [[[(0, 0), (1, 0), (0, 0)]]])]


def test_figures(spark):
    polys = spark.createDataFrame(geom_rows(FIGURES), POLY_SCHEMA)
    got = {r.polygon_id: (r.crossings, r.touches, r.holes_outside) for r in V.polygon_faults(polys, "polygon_id").collect()}
    assert got[1] == (0, 0, 0) and got[2] == (1, 0, 0) and got[3] == (0, 0, 0) and got[4] == (0, 0, 1)
    assert got[5][0] == 0 and got[5][1] > 0 and got[6][1] > 0          # a hole that touches, a spike
    assert got[7] == (2, 0, 0) and got[8][0] == 0 and got[8][1] > 0    # parts that overlap, parts that touch
    assert got[9] == (2, 0, 0) and got[10] == (0, 0, 0)
    good, bad = V.split_faulty(polys, "polygon_id")
    assert {r.polygon_id for r in good.collect()} == {1, 3, 5, 6, 8}
    faults = {r.polygon_id: set(r.faults) for r in bad.collect()}
    assert faults[2] >= {"self_crossing"} and faults[4] == {"hole_outside"} and "empty" in faults[10] and "ring_too_short" in faults[11]


def test_crossings_against_all_pairs(spark):
    rnd = random.Random(7)
    rings = [[(x := [(rnd.uniform(0, 5), rnd.uniform(0, 5)) for _ in range(n)]) + x[:1]] for n in (3, 8, 25, 60)] + [[star(3, 3, 200, 1)]]
    polys = spark.createDataFrame(geom_rows([(i, [r]) for i, r in enumerate(rings)]), POLY_SCHEMA)
    got = {r.polygon_id: r.crossings for r in V.polygon_faults(polys, "polygon_id").collect()}

    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (v > 0) - (v < 0)

    for pid, (ring,) in enumerate(rings):
        e = list(zip(ring, ring[1:], strict=False))
        assert got[pid] == sum(side(*p, q[0]) * side(*p, q[1]) < 0 and side(*q, p[0]) * side(*q, p[1]) < 0 for i, p in enumerate(e) for q in e[i + 1:])


def test_a_long_simple_outline(spark):
    from .test_quadtree import coast
    polys = spark.createDataFrame(geom_rows([(1, [[coast(2, 2, 20_000)]])]), POLY_SCHEMA)
    assert V.edge_meetings(polys, "polygon_id").filter(F.col("crossing")).count() == 0
