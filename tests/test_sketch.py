"""Mergeable summaries: parts equal the whole, estimates keep their error, ranks are exact."""
import random

import pytest
from pyspark.sql import functions as F

from geoping.operators import grid as G
from geoping.operators import sketch as SK


@pytest.fixture(scope="module")
def visits(spark):
    """Devices per cell from one to 30,000, a device without a name, three dates."""
    cells = [(0.05, 1), (0.15, 40), (0.25, 900), (0.35, 30_000)]
    rows = [(None if i == 0 else f"dev-{i % n}", x, 0.05, i % 3, float(i % 101)) for x, n in cells for i in range(2 * n)]
    df = spark.createDataFrame(rows, "device_id string, longitude double, latitude double, date int, battery double")
    for m in ("signal", "altitude", "speed"):
        df = df.withColumn(m, F.col("battery") * 2)
    return df


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_parts_merge_to_the_whole_byte_for_byte(visits):
    whole = SK.grid_sketch_state(visits, 0.1)
    parts = [SK.grid_sketch_state(visits.filter(F.pmod(F.xxhash64("device_id", "battery"), F.lit(4)) == k), 0.1) for k in range(4)]
    dated = SK.grid_sketch_state(visits.repartition(7), 0.1, by=["date"])
    expect = rows(whole)
    assert rows(SK.merge_grid_sketches(*parts)) == expect == rows(SK.merge_grid_sketches(dated))
    assert rows(SK.merge_grid_sketches(SK.merge_grid_sketches(*parts[:2]), *parts[1:]).select("cell_x", "registers")) == rows(whole.select("cell_x", "registers"))
    assert max(len(r.registers) for r in whole.collect()) <= 1 << SK.PRECISION


def test_estimates_keep_the_stated_error(visits):
    est = {r.cell_x: r for r in SK.grid_from_sketches(SK.grid_sketch_state(visits, 0.1), 0.1).collect()}
    for r in G.grid_heatmap(visits, 0.1).collect():
        got = est[r.cell_x]
        assert abs(got.unique_devices - r.unique_devices) <= 1 + 4 * 1.04 / 64 * r.unique_devices
        assert (got.point_count, got.avg_battery, got.avg_speed) == (r.point_count, r.avg_battery, r.avg_speed)


def test_error_over_many_sets(spark):
    df = spark.range(400 * 2000).select((F.col("id") % 400).alias("set"), F.concat_ws("-", F.lit("x"), F.col("id")).alias("v"))
    est = SK.distinct_registers(df, ["set"], "v").select(SK.distinct_estimate("registers").alias("e")).agg(
        F.avg("e").alias("mean"), F.stddev("e").alias("sd")).collect()[0]
    assert abs(est.mean / 2000 - 1) < 0.003 and est.sd / 2000 < 1.3 * 1.04 / 64


def test_no_devices(spark, visits):
    assert SK.grid_sketch_state(visits.limit(0), 0.1).count() == 0
    nobody = SK.grid_sketch_state(visits.withColumn("device_id", F.lit(None).cast("string")), 0.1)
    assert {r.unique_devices for r in SK.grid_from_sketches(nobody, 0.1).collect()} == {0}
    assert {r.unique_devices for r in SK.grid_from_sketches(SK.merge_grid_sketches(nobody, nobody), 0.1).collect()} == {0}


@pytest.mark.parametrize("kind", ["zeros", "ties", "signs", "tiny", "one"])
def test_ranks_are_exact(spark, kind):
    rnd = random.Random(kind)
    values = {"zeros": [0.0] * 3000 + [rnd.expovariate(0.1) for _ in range(6000)], "ties": [rnd.choice([1.0, 1.5, 1.5000001, 7.25]) for _ in range(4000)],
              "signs": [rnd.gauss(0, 50) for _ in range(5000)] + [-0.0, 0.0], "tiny": [rnd.choice([1e-320, 5e-324, -1e-310, 1e300, -1e300, 2.0 ** -101]) for _ in range(500)],
              "one": [3.5]}[kind]
    df = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)] + [(None, 0)] * 10, "v double, day int").repartition(3)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999]
    state = SK.rank_state(df, "v", ["day"])
    got, looked = SK.percentiles_from_state(state, df, "v", ps)
    assert got == [sorted(values)[int(len(values) * p)] for p in ps]
    if kind == "zeros":
        assert looked < len(values) / 4          # only the buckets that hold a rank
    if kind == "one":
        assert looked == 0
    some = SK.percentiles_from_state(state.filter("day < 2"), df.filter("day < 2"), "v", [0.5])[0]
    part = sorted(v for i, v in enumerate(values) if i % 5 < 2)
    assert some == [part[int(len(part) * 0.5)]]


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1)], "v double, day int")
    assert SK.percentiles_from_state(SK.rank_state(df, "v", ["day"]), df, "v", [0.5]) == ([None], 0)


def test_buckets_rise_with_the_value(spark):
    rnd = random.Random(2)
    values = sorted([rnd.choice([-1, 1]) * 2 ** rnd.uniform(-200, 200) for _ in range(3000)] + [2.0 ** k for k in range(-120, 120)] + [0.0])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(SK._bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)
