"""Tables stored by place and by id: same rows, fewer of them read."""
import random

import pytest
from pyspark.sql import functions as F

from geoping.operators import grid as G
from geoping.operators import layout as LY
from geoping.operators import quadtree as Q
from geoping.operators import spatial as SP
from geoping.sources.pings import page_scan

from .conftest import square
from .test_spatial import CONCAVE, _polys


def rows_scanned(df):
    """Rows that the file scans of a finished plan gave out (after skipping row groups)."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    plan = qe.executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()

    def leaves(node):
        name = node.getClass().getSimpleName()
        if "QueryStageExec" in name:
            return leaves(node.plan())
        if "FileSourceScanExec" in name:
            return [node]
        found, kids = [], node.children()
        for i in range(kids.size()):
            found += leaves(kids.apply(i))
        return found

    return sum(n.metrics().apply("numOutputRows").value() for n in leaves(plan))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows = [(i, f"d{i % 90}", 50.0, -60.0, 1.0, 300.0, "4G", "TIGO", rnd.uniform(-1, 6), rnd.uniform(-1, 6)) for i in range(60_000)]
    rows += [(60_000 + i, "parked", 50.0, -60.0, 1.0, 300.0, "4G", "TIGO", 1.5, 1.5) for i in range(20_000)]   # a quarter of all in one place
    rows += [(80_000, "lost", 50.0, -60.0, 1.0, 300.0, "4G", "TIGO", None, None)]
    points = spark.createDataFrame(rows, "id long, device_id string, battery double, signal double, speed double, altitude double, network_type string, "
                                         "sim_operator string, longitude double, latitude double")
    path = str(tmp_path_factory.mktemp("placed"))
    assert LY.write_by_place(points, path, 0.05, files=8, block_bytes=1 << 16) == 80_001
    return points, spark.read.parquet(path)


def test_key_is_the_interleaved_index(spark):
    def plain(y, x):
        return sum(((y >> k & 1) << (2 * k + 1)) | ((x >> k & 1) << (2 * k)) for k in range(21))

    rnd = random.Random(1)
    cells = [(rnd.randrange(-(1 << 20), 1 << 20), rnd.randrange(-(1 << 20), 1 << 20)) for _ in range(200)]
    got = spark.createDataFrame(cells, "y long, x long").select("y", "x", LY.z_key(F.col("y"), F.col("x")).alias("z")).collect()
    assert all(r.z == plain(r.y + (1 << 20), r.x + (1 << 20)) for r in got)


def test_box_reads_few_rows(stored):
    points, placed = stored
    box = {"min_lat": 3.0, "max_lat": 3.4, "min_lon": 4.0, "max_lon": 4.5, "grid_size": 0.05}
    want, got = (sorted(map(tuple, G.heatmap_request(df, **box).collect())) for df in (points, placed))
    assert got == want and want
    box = placed.filter("latitude between 3.0 and 3.4 and longitude between 4.0 and 4.5").select("id")
    assert rows_scanned(box) < 80_001 / 4


def test_one_hot_place_is_spread(stored):
    sizes = [r.n for r in stored[1].groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("shape,limit", [([[CONCAVE]], 64), ([[square(3, 3, 2)]], 64), ([[square(3, 3, 2)]], 3)])
def test_ranges_hold_all_boundary_points(spark, stored, shape, limit):
    points, placed = stored
    polys = _polys(spark, [(1, shape)])
    cover = Q.build_cover([("poly", polys, "polygon_id")], 0.05, leaf_edges=0)
    ranges = LY.boundary_ranges(cover, limit)
    assert 0 < len(ranges) <= limit and all(a < b for a, b in ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    near = placed.filter(LY.in_ranges(ranges))
    pyramid = Q.build_pyramid(placed, 0.05, 8)
    want = SP.count_in_polygon(points, SP.build_index([("poly", polys, "polygon_id")]), "poly", 1).collect()[0].total
    assert Q.count_in_polygon(pyramid, 8, near, cover, "poly", 1).collect()[0].total == want
    if limit == 64:
        assert rows_scanned(near.select("id")) < 80_001 / 2


@pytest.mark.parametrize("limit,offset", [(10, 0), (1000, 2000), (7, 1249), (5000, 9_990), (3, 10_050), (1, 10_100)])
def test_any_page(spark, tmp_path, limit, offset):
    df = spark.range(10_000).withColumn("v", F.col("id") * 3).unionByName(spark.range(100).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("v")))
    LY.write_by_id(df, str(tmp_path), ranges=8)
    page = LY.read_page(spark, str(tmp_path), limit, offset)
    want = page_scan(df, limit, offset).collect()
    assert [r.id for r in page.collect()] == [r.id for r in want]
    if limit == 10:
        assert rows_scanned(LY.read_page(spark, str(tmp_path), limit, offset)) < 2000
        assert len(LY.page_parts(spark, str(tmp_path), limit, offset)[0]) == 1


def test_pages_of_an_empty_table(spark, tmp_path):
    LY.write_by_id(spark.range(0), str(tmp_path), ranges=4)
    assert LY.page_parts(spark, str(tmp_path), 5, 0) == ([], 0)


def test_tasks_that_write_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """a level of the pyramid and the points of a table are sorted and written by as many tasks as their rows ask for."""
    monkeypatch.setattr(LY, "RANGE_ROWS", 500)
    pyramid = spark.range(6000).select(F.when(F.col("id") < 5000, 0).otherwise(2).alias("level"), (F.col("id") % 70).alias("cell_y"), (F.col("id") % 30).alias("cell_x"),
                                       F.col("id").cast("string").alias("device_id"), F.lit(1).alias("n"))
    assert LY.write_pyramid(pyramid, f"{tmp_path}/pyramid", range_rows=500) == 6000
    stored = spark.read.parquet(f"{tmp_path}/pyramid")
    assert sorted(map(tuple, stored.select(*pyramid.columns).collect())) == sorted(map(tuple, pyramid.collect()))
    points = spark.range(6000).select("id", (F.col("id") % 50 / 100).alias("latitude"), (F.col("id") % 40 / 100).alias("longitude"))
    assert LY.write_by_place(points, f"{tmp_path}/points", 0.01) == 6000
    for path in ("pyramid", "points"):
        per_file = spark.read.parquet(f"{tmp_path}/{path}").groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).collect()[0][0]
        assert per_file < 1500
