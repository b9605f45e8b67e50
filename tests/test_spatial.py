"""Spatial join: cell cover == nested loop, modes, overlap, caps, assignment rules."""
import random

from pyspark.sql import functions as F

from geoping.operators import spatial as SP

from .conftest import POLY_SCHEMA, geom_rows, square


def _polys(spark, polys, id_col="polygon_id"):
    return spark.createDataFrame(geom_rows(polys), POLY_SCHEMA).withColumnRenamed("polygon_id", id_col)


def _points(spark, n=3000, seed=7, lo=-1.0, hi=6.0):
    rnd = random.Random(seed)
    rows = [(i, round(rnd.uniform(lo, hi), 3), round(rnd.uniform(lo, hi), 3)) for i in range(n)]
    # points exactly on vertices and edges
    rows += [(n + 1, 0.0, 0.0), (n + 2, 2.0, 0.0), (n + 3, 3.0, 3.0), (n + 4, 1.0, 0.75)]
    return spark.createDataFrame(rows, "id long, longitude double, latitude double")


CONCAVE = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]
HOLE = [(1, 0.5), (1, 1), (1.5, 1), (1.5, 0.5), (1, 0.5)]


def test_cell_cover_equals_nested_loop(spark):
    polys = _polys(spark, [(1, [[CONCAVE, HOLE], [square(4.5, 4.5, 1)]]), (2, [[square(3, 3, 2)]]),
                           (3, [[[(0, 5), (2.5, 5.9), (0.3, 5.5), (0, 5)]]])])
    pts = _points(spark)
    nl = SP.assign_nested_loop(pts, polys, "polygon_id", out_col="nl").select("id", "nl")
    for cell, bc in [(0.5, None), (0.01, None), (0.25, False), (3.0, None)]:
        idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=cell, force_broadcast=bc)
        got = SP.locate(pts, idx).join(nl, "id")
        bad = got.filter(~F.col("poly_id").eqNullSafe(F.col("nl"))).count()
        assert bad == 0, (cell, bc)


def test_overlap_lowest_id_and_match_all(spark):
    polys = _polys(spark, [(5, [[square(0, 0, 2)]]), (3, [[square(1, 1, 2)]])])
    pts = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 2.5, 2.5), (4, 9.0, 9.0)],
                                "id long, longitude double, latitude double")
    idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=0.5)
    got = {r["id"]: r["poly_id"] for r in SP.locate(pts, idx).collect()}
    assert got == {1: 3, 2: 5, 3: 3, 4: None}
    pairs = sorted((r["id"], r["polygon_id"]) for r in SP.match_all(pts, idx, "poly").collect())
    assert pairs == [(1, 3), (1, 5), (2, 5), (3, 3)]


def test_cover_size_cap_coarsens_cells(spark):
    polys = _polys(spark, [(1, [[square(0, 0, 10)]])])
    idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=0.01, max_cells=500)
    assert idx.cell_size > 0.01 and idx.n_cells <= 500
    pts = _points(spark, 500, lo=-2, hi=12)
    got = SP.locate(pts, idx).filter(F.col("poly_id").isNotNull()).count()
    want = pts.filter("longitude > 0 and longitude < 10 and latitude > 0 and latitude < 10").count()
    assert got == want


def test_assignment_modes(spark):
    d = _polys(spark, [(1, [[square(0, 0, 2)]])], "district_id").withColumn("district_name", F.lit("D1"))
    p = _polys(spark, [(7, [[square(1, 0, 5)]])], "province_id").withColumn("province_name", F.lit("P7"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 3.0, 0.5)],
                                "id long, longitude double, latitude double")
    both = {r["id"]: (r["district_id"], r["province_id"]) for r in SP.assign_locations(pts, d, p).collect()}
    assert both == {1: (None, None), 2: (1, 7), 3: (None, None)}
    ind = {r["id"]: (r["district_name"], r["province_name"])
           for r in SP.assign_locations(pts, d, p, mode="independent").collect()}
    assert ind == {1: ("D1", None), 2: ("D1", "P7"), 3: (None, "P7")}


def test_empty_polygon_table(spark):
    polys = spark.createDataFrame([], POLY_SCHEMA)
    idx = SP.build_index([("poly", polys, "polygon_id")])
    pts = _points(spark, 10)
    assert SP.locate(pts, idx).filter(F.col("poly_id").isNotNull()).count() == 0


def test_orphan_keys_nulled(spark):
    polys = spark.createDataFrame([(1,), (2,)], "district_id long")
    loc = spark.createDataFrame([(10, 1, "a"), (11, 3, "b"), (12, None, None)],
                                "id long, district_id long, district_name string")
    got = {r["id"]: (r["district_id"], r["district_name"])
           for r in SP.null_orphans(loc, polys, "district_id", "district_name").collect()}
    assert got == {10: (1, "a"), 11: (None, None), 12: (None, None)}


def test_hot_cells_are_salted_in_shuffle_mode(spark):
    polys = _polys(spark, [(1, [[CONCAVE, HOLE]]), (2, [[square(3, 3, 2)]])])
    rnd = random.Random(1)
    # one hot spot: 1500 pings at the same place, plus scattered points
    rows = [(i, 3.5, 3.5) for i in range(1500)] + [(2000 + i, round(rnd.uniform(-1, 6), 3),
                                                    round(rnd.uniform(-1, 6), 3)) for i in range(1500)]
    pts = spark.createDataFrame(rows, "id long, longitude double, latitude double")
    nl = SP.assign_nested_loop(pts, polys, "polygon_id", out_col="nl").select("id", "nl")
    idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=0.5, force_broadcast=False, hot_rows=100)
    assert idx.hot_rows == 100 and not idx.broadcast
    got = SP.locate(pts, idx)
    assert got.count() == 3000
    assert got.join(nl, "id").filter(~F.col("poly_id").eqNullSafe(F.col("nl"))).count() == 0


def test_single_polygon_queries_push_bbox_to_scan(spark):
    import uuid
    from geoping.operators import districts as D
    from geoping.session import scratch_path
    polys = _polys(spark, [(1, [[CONCAVE, HOLE]]), (2, [[square(3, 3, 2)]])], "district_id")
    polys = polys.withColumn("district_number", F.col("district_id").cast("int") + 100).withColumn(
        "district_name", F.concat(F.lit("D"), F.col("district_id").cast("string")))
    path = scratch_path(spark, f"pts-{uuid.uuid4().hex[:8]}")
    pts = _points(spark).withColumn("device_id", F.lit("d")).withColumn("battery", F.lit(50.0)) \
        .withColumn("signal", F.lit(-60.0)).withColumn("speed", F.lit(1.0))
    pts.write.parquet(path)
    stored = spark.read.parquet(path)
    idx = SP.build_index([("district", polys, "district_id")], cell_size=0.5)
    inside = SP.points_in_polygon(stored, idx, "district", 2)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(latitude" in plan
    want = SP.match_all(stored, idx, "district").filter("polygon_id = 2").count()
    assert inside.count() == want
    one = D.district_statistics_for(stored, polys, idx, 102).collect()
    assert len(one) == 1 and one[0]["total_locations"] == want
    assert D.district_statistics_for(stored, polys, idx, 999).count() == 0
    allstats = D.district_statistics(stored, polys, idx).filter("district_number = 102").collect()[0]
    assert allstats.asDict() == one[0].asDict()


def test_property_random_star_polygons(spark):
    import math

    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(st.floats(0.5, 4.5), st.floats(0.5, 4.5),
                              st.lists(st.floats(0.2, 1.5), min_size=3, max_size=9)), min_size=1, max_size=4),
           st.sampled_from([0.05, 0.3, 1.0]), st.integers(0, 10_000))
    def check(shapes, cell, seed):
        polys = []
        for pid, (cx, cy, radii) in enumerate(shapes, start=1):
            ring = [(round(cx + r * math.cos(2 * math.pi * k / len(radii)), 3),
                     round(cy + r * math.sin(2 * math.pi * k / len(radii)), 3)) for k, r in enumerate(radii)]
            polys.append((pid, [[ring + [ring[0]]]]))
        df = _polys(spark, polys)
        rnd = random.Random(seed)
        pts = [(i, round(rnd.uniform(-1, 7), 2), round(rnd.uniform(-1, 7), 2)) for i in range(400)]
        pts += [(1000 + j, x, y) for j, (x, y) in enumerate(polys[0][1][0][0])]      # exact vertices
        p = spark.createDataFrame(pts, "id long, longitude double, latitude double")
        nl = SP.assign_nested_loop(p, df, "polygon_id", out_col="nl").select("id", "nl")
        idx = SP.build_index([("poly", df, "polygon_id")], cell_size=cell)
        bad = SP.locate(p, idx).join(nl, "id").filter(~F.col("poly_id").eqNullSafe(F.col("nl"))).count()
        assert bad == 0

    check()


def test_mixed_polygon_sizes_use_several_levels(spark):
    big = [(-1.0, -1.0), (7.0, -1.0), (7.0, 7.0), (3.0, 2.5), (-1.0, 7.0), (-1.0, -1.0)]   # concave, large
    polys = _polys(spark, [(1, [[big]]), (2, [[square(0.2, 0.2, 0.3)]]), (3, [[CONCAVE, HOLE]]),
                           (4, [[square(5.0, 5.0, 0.1)]])])
    pts = _points(spark, 2500, seed=21)
    nl = SP.assign_nested_loop(pts, polys, "polygon_id", out_col="nl").select("id", "nl")
    pairs_nl = None
    for bc in (None, False):
        idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=0.05, max_cells_per_polygon=400,
                             force_broadcast=bc, hot_rows=200)
        assert len(idx.levels) >= 2 and idx.cell_size == 0.05
        got = SP.locate(pts, idx).join(nl, "id")
        assert got.filter(~F.col("poly_id").eqNullSafe(F.col("nl"))).count() == 0
        pairs = sorted((r["id"], r["polygon_id"]) for r in SP.match_all(pts, idx, "poly").collect())
        pairs_nl = pairs_nl or pairs
        assert pairs == pairs_nl
        n3 = SP.count_in_polygon(pts, idx, "poly", 3).collect()[0]["total"]
        assert n3 == sum(1 for _, pid in pairs if pid == 3)


def test_request_validation(spark):
    import pytest
    from geoping.operators import grid as GR
    pts = _points(spark, 20)
    with pytest.raises(ValueError):
        GR.heatmap_request(pts, grid_size=0.5)
    with pytest.raises(ValueError):
        GR.heatmap_request(pts, grid_size=0.0005)
    polys = _polys(spark, [(1, [[square(0, 0, 5)]])])
    idx = SP.build_index([("poly", polys, "polygon_id")], cell_size=0.5)
    with pytest.raises(ValueError):
        SP.page_in_polygon(pts, idx, "poly", 1, limit=0)
    with pytest.raises(ValueError):
        SP.page_in_polygon(pts, idx, "poly", 1, limit=1001)
    page = [r["id"] for r in SP.page_in_polygon(pts, idx, "poly", 1, limit=3, offset=2).collect()]
    inside = sorted(r["id"] for r in SP.match_all(pts, idx, "poly").collect())
    assert page == inside[2:5]


def test_lookup_point(spark):
    d = _polys(spark, [(1, [[square(0, 0, 2)]]), (2, [[square(3, 3, 1)]])], "district_id") \
        .withColumn("district_name", F.concat(F.lit("D"), F.col("district_id").cast("string")))
    idx = SP.build_index([("district", d, "district_id")], cell_size=0.5)
    r = SP.lookup_point(spark, idx, 1.0, 1.0, {"district": (d, "district_id", "district_name")}).collect()[0]
    assert (r["district_id"], r["district_name"]) == (1, "D1")
    r = SP.lookup_point(spark, idx, 9.0, 9.0, {"district": (d, "district_id", "district_name")}).collect()[0]
    assert r["district_id"] is None and r["district_name"] is None
