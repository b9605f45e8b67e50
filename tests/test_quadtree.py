"""Adaptive cover == nested loop; pyramid answers == statistics over points."""
import math
import random

import pytest
from pyspark.sql import functions as F

from geoping.operators import districts as D
from geoping.operators import quadtree as Q
from geoping.operators import spatial as SP

from .conftest import POLY_SCHEMA, geom_rows, square
from .test_spatial import CONCAVE, HOLE, _points, _polys


def star(x, y, n, seed, low=0.4, high=1.9):
    """A ring of n edges around (x, y) of changing radius."""
    rnd = random.Random(seed)
    ring = [(x + (r := rnd.uniform(low, high)) * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return ring + ring[:1]


def coast(x, y, n, radius=1.0, seed=1):
    """A long jagged outline: n edges, radius disturbed on all scales."""
    rnd = random.Random(seed)
    waves = [(f, rnd.uniform(0, 6.28), 0.2 / f ** 0.8) for f in (3, 7, 19, 53, 151, 401)]
    ring = []
    for k in range(n):
        a = 2 * math.pi * k / n
        r = radius * (1 + sum(h * math.sin(f * a + p) for f, p, h in waves))
        ring.append((x + r * math.cos(a), y + r * math.sin(a)))
    return ring + ring[:1]


def _disagreements(pts, polys, idx):
    nl = SP.assign_nested_loop(pts, polys, "polygon_id", out_col="nl").select("id", "nl")
    return SP.locate(pts, idx).join(nl, "id").filter(~F.col("poly_id").eqNullSafe(F.col("nl"))).count()


@pytest.mark.parametrize("cell,leaf,broadcast", [(0.5, 8, None), (0.01, 2, None), (0.03, 0, False), (8.0, 4, None)])
def test_adaptive_cover_equals_nested_loop(spark, cell, leaf, broadcast):
    polys = _polys(spark, [(1, [[CONCAVE, HOLE], [square(4.5, 4.5, 1)]]), (2, [[square(3, 3, 2)]]), (3, [[[(0, 5), (2.5, 5.9), (0.3, 5.5), (0, 5)]]]),
                           (4, [[star(1.5, 3.5, 60, 3)]]), (5, [[star(4, 1, 301, 4), star(4, 1, 40, 5, 0.1, 0.3)]]),
                           (6, [[[(-0.5, -0.5), (6, -0.4), (-0.5, -0.3), (-0.5, -0.5)]]])])
    cover = Q.build_cover([("poly", polys, "polygon_id")], cell_size=cell, leaf_edges=leaf)
    assert _disagreements(_points(spark), polys, Q.as_index(cover, force_broadcast=broadcast)) == 0


def test_mixed_depth_and_a_polygon_of_1e5_edges(spark):
    polys = _polys(spark, [(1, [[coast(2.0, 2.0, 100_000)]]), (2, [[square(-40, -30, 70)]]), (3, [[square(2.2, 2.2, 0.004)]])])
    cover = Q.build_cover([("poly", polys, "polygon_id")], cell_size=0.0025)
    report = {r.pid: r for r in Q.cover_report(cover).collect()}
    jagged, large, tiny = report[1], report[2], report[3]
    print("cover of 100,000 edges:", jagged)
    # rows follow the edges, not the area: a 1 degree outline has over 500,000 cells of that size
    assert jagged.nodes < 60_000 and jagged.edge_refs < 400_000 and jagged.coarsest > jagged.finest
    assert large.nodes < 2_000 and large.coarsest >= 8          # 70 x 70 degrees: 784 million cells
    assert tiny.nodes <= 40
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(0.5, 3.5), rnd.uniform(0.5, 3.5)) for i in range(80)]
    rows += [(80 + k, x, y) for k, (x, y) in enumerate(coast(2.0, 2.0, 100_000)[::12500])]     # vertices are outside
    pts = spark.createDataFrame(rows, "id long, longitude double, latitude double")
    only = polys.filter("polygon_id <> 2")
    own = Q.QuadCover(cover.cell_size, cover.layers, cover.nodes.filter("pid <> 2"))
    assert _disagreements(pts, only, Q.as_index(own)) == 0


def test_no_polygons_and_no_geometry(spark):
    polys = spark.createDataFrame([(1, None), (2, [])], POLY_SCHEMA)
    cover = Q.build_cover([("poly", polys, "polygon_id")])
    pts = _points(spark, 20)
    assert cover.nodes.count() == 0
    assert SP.locate(pts, Q.as_index(cover)).filter("poly_id is not null").count() == 0


@pytest.fixture(scope="module")
def located(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(6000):
        x, y = round(rnd.uniform(-1, 6), 3), round(rnd.uniform(-1, 6), 3)
        rows.append((i, None if i % 50 == 0 else f"d{rnd.randrange(40)}", float(rnd.randrange(101)), -60.0, None if i % 7 == 0 else rnd.uniform(0, 30), 300.0, x, y))
    points = spark.createDataFrame(rows, "id long, device_id string, battery double, signal double, speed double, altitude double, longitude double, latitude double")
    polys = spark.createDataFrame([(pid, pid + 1, f"P{pid}", geom) for pid, geom in geom_rows(
        [(1, [[CONCAVE, HOLE], [square(4.5, 4.5, 1)]]), (2, [[square(3, 3, 2)]]), (3, [[star(2, 2, 200, 8)]]), (4, [[square(50, 50, 1)]])])],
        "district_id long, district_number long, district_name string, " + POLY_SCHEMA.split(", ", 1)[1])
    return points, polys


@pytest.mark.parametrize("top", [0, 2, 8])
def test_pyramid_equals_statistics_over_points(spark, located, top):
    points, polys = located
    cover = Q.build_cover([("district", polys, "district_id")], cell_size=0.05, leaf_edges=0)
    pyramid = Q.build_pyramid(points, 0.05, top)
    got = Q.polygon_statistics(pyramid, top, points, polys, cover)
    want = D.district_statistics(points, polys, SP.build_index([("district", polys, "district_id")]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_boundary_points_are_tested(spark, located):
    points, polys = located
    cover = Q.build_cover([("district", polys, "district_id")], cell_size=0.01, leaf_edges=0)
    one = Q.of_polygon(cover, "district", 2)
    boundary = Q.as_index(one, boundary_only=True)
    joined = SP._candidates(points, boundary, "longitude", "latitude").filter("cands is not null").count()
    inside = SP.count_in_polygon(points, SP.build_index([("district", polys, "district_id")]), "district", 2).collect()[0].total
    assert inside > 400 and joined < inside / 10
    assert Q.count_in_polygon(Q.build_pyramid(points, 0.01, 8), 8, points, cover, "district", 2).collect()[0].total == inside
    assert Q.count_in_polygon(Q.build_pyramid(points, 0.01, 8), 8, points, cover, "district", 77).collect()[0].total == 0


def test_pyramids_merge(spark, located):
    points, _ = located
    parts = [Q.build_pyramid(points.filter(F.col("id") % 3 == k), 0.05, 4) for k in range(3)]
    rows = lambda p: sorted(map(tuple, p.select(*sorted(p.columns)).collect()), key=repr)
    assert rows(Q.merge_pyramids(*parts)) == rows(Q.build_pyramid(points, 0.05, 4))


def test_lowest_of_many_overlapping_polygons(spark):
    """what a point is compared with does not grow with the number of polygons over it."""
    rnd = random.Random(5)

    def most(n):
        polys = _polys(spark, [(k, [[star(rnd.uniform(1, 4), rnd.uniform(1, 4), 7, k)]]) for k in range(n)])
        pts = _points(spark)
        cover = Q.build_cover([("poly", polys, "polygon_id")], cell_size=0.1, leaf_edges=8, cell_edges=32)
        idx = Q.as_index(cover)
        assert _disagreements(pts, polys, idx) == 0
        with pytest.raises(ValueError):
            Q.polygon_device_rows(pts, 0, pts, cover, "poly")
        return SP._candidates(pts, idx, "longitude", "latitude").agg(F.avg(F.coalesce(F.aggregate("cands", F.lit(0), lambda a, c: a + F.size(c["edges"])), F.lit(0)))).collect()[0][0]

    few, many = most(40), most(400)
    assert many < 2 * few


def test_splits_do_not_repeat_their_expressions(spark):
    """a node is dropped after its columns are made, not by a filter that is pushed below them and makes them again."""
    polys = _polys(spark, [(1, [[star(1.5, 3.5, 60, 3)]])])
    nodes = Q.build_cover([("poly", polys, "polygon_id")], cell_size=0.5).nodes.limit(1)
    nodes = nodes.select("layer", "pid", "level", "cell_y", "cell_x", F.expr("transform(edges, (e, i) -> struct(i, e.x1, e.y1, e.x2, e.y2))").cast(Q.T.ArrayType(Q._INDEXED)).alias("edges"),
                         F.array().cast("array<double>").alias("ys"), F.lit(0).alias("flip"), F.lit(True).alias("open"))
    plan = Q._settled(Q._narrow(Q._split(nodes), 0.5), 0)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "Filter" not in text
