"""After a polygon reload only the changed cells' points are looked at; the result is that of a full assignment."""
import glob
import os
import uuid

from pyspark.sql import functions as F

from geoping.operators import quadtree as Q
from geoping.operators import reassign as RA
from geoping.operators import spatial as SP
from geoping.session import scratch_path
from geoping.sinks import writers as W

from .conftest import POLY_SCHEMA, geom_rows, square
from .test_quadtree import star


def _layer(spark, polys, kind):
    return (spark.createDataFrame(geom_rows(polys), POLY_SCHEMA).withColumnRenamed("polygon_id", f"{kind}_id")
            .withColumn(f"{kind}_name", F.concat(F.lit(kind[0]), F.col(f"{kind}_id"))))


def _stored(spark, old):
    path = scratch_path(spark, f"t-reload-{uuid.uuid4().hex[:8]}")
    points = (spark.range(6000).withColumn("longitude", F.pmod(F.col("id") * 7919, F.lit(1000)) / 100.0).withColumn("latitude", F.pmod(F.col("id") * 104729, F.lit(997)) / 100.0)
              .withColumn("date", F.when(F.col("id") % 500 != 0, F.expr("date_add(date'2024-01-01', cast(floor(longitude) as int))"))))
    W.write_table(SP.assign_locations(points, *old).repartition(1), path, "overwrite", ["date"])
    return path


def _rows(df):
    return sorted(map(tuple, df.select("id", "district_id", "district_name", "province_id", "province_name").collect()))


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_equal_to_a_full_assignment_and_other_dates_keep_their_files(spark):
    old_d = _layer(spark, [(1, [[square(0, 0, 5)]]), (2, [[square(5, 0, 4)]]), (3, [[star(7, 7, 30, 1)]])], "district")
    new_d = _layer(spark, [(1, [[square(0, 0, 5)]]), (2, [[square(5, 0.3, 4)]]), (4, [[star(7, 7, 40, 2)]])], "district")
    provinces = _layer(spark, [(9, [[square(-1, -1, 12)]])], "province")
    path = _stored(spark, (old_d, provinces))
    before = _files(path)
    done = RA.reassign_changed(spark, path, (old_d, provinces), (new_d, provinces), cell_size=0.05)
    stored = spark.read.parquet(path)
    plain = stored.drop("district_id", "district_name", "province_id", "province_name")
    assert _rows(stored) == _rows(SP.assign_locations(plain, new_d, provinces))
    assert 0 < done["rows"] < 4000                                     # of 6,000
    kept = {f for f in _files(path) if f in before}
    days = {f.split("date=")[1].split("/")[0] for f in kept}
    assert {"2024-01-01", "2024-01-02", "2024-01-03"} <= days       # west of all changes
    assert not days & {str(d) for d in done["dates"]}


def test_nothing_changed(spark):
    layers = (_layer(spark, [(1, [[square(0, 0, 5)]])], "district"), _layer(spark, [(9, [[square(-1, -1, 12)]])], "province"))
    path = _stored(spark, layers)
    before = _files(path)
    assert RA.reassign_changed(spark, path, layers, layers, cell_size=0.05) == {"rows": 0, "dates": [], "cells": 0}
    assert _files(path) == before


def test_a_new_name_is_a_change(spark):
    old = (_layer(spark, [(1, [[square(0, 0, 5)]]), (2, [[square(5, 0, 3)]])], "district"), _layer(spark, [(9, [[square(-1, -1, 12)]])], "province"))
    new = (old[0].withColumn("district_name", F.when(F.col("district_id") == 2, "renamed").otherwise(F.col("district_name"))), old[1])
    path = _stored(spark, old)
    RA.reassign_changed(spark, path, old, new, cell_size=0.05)
    plain = spark.read.parquet(path).drop("district_id", "district_name", "province_id", "province_name")
    assert _rows(spark.read.parquet(path)) == _rows(SP.assign_locations(plain, *new))


def test_changed_cells_are_near_the_change(spark):
    layers = [("poly", _layer(spark, [(1, [[square(0, 0, 8)]]), (2, [[square(20, 20, 1)]])], "district"), "district_id")]
    moved = [("poly", _layer(spark, [(1, [[square(0, 0, 8)]]), (2, [[square(20.5, 20, 1)]])], "district"), "district_id")]
    covers = [Q.build_cover(x, 0.05) for x in (layers, moved)]
    cells = RA.changed_cells(*covers, layers, moved).collect()
    assert cells and all((c.cell_x + 1) * 0.05 * 2 ** c.level > 15 for c in cells)
