"""Dimension loads: keys stay, extents widen, names are versioned; any split of the rows gives the same members."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from geoping.operators import members as M

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def visits(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        device, hour = rnd.randrange(60), rnd.randrange(1000)
        rows.append((f"d{device:02}", f"name {device} v{hour // 400}" if device % 3 else f"name {device}", T0 + dt.timedelta(hours=hour)))
    rows += [(None, "nobody", T0), ("d99", None, T0), ("d98", "only time missing", None)]
    return spark.createDataFrame(rows, "device_id string, device_name string, timestamp timestamp_ntz")


def members(spark, path, *columns):
    return sorted(tuple(r) for r in M.current_members(spark, path, "device_id", "device_name").select(*columns).collect())


@pytest.mark.parametrize("split", ["hash", "early first", "late first", "overlap"])
def test_any_split_gives_the_same_members(spark, tmp_path, visits, split):
    M.load_members(spark, f"{tmp_path}/one", visits, "device_id", "device_name")
    cut = {"hash": F.pmod(F.xxhash64("device_id", "timestamp"), F.lit(2)) == 0, "early first": F.col("timestamp") < F.lit(T0 + dt.timedelta(hours=500)),
           "late first": F.col("timestamp") >= F.lit(T0 + dt.timedelta(hours=500)), "overlap": F.col("device_id") > "d30"}[split]
    first = F.coalesce(cut, F.lit(False))
    M.load_members(spark, f"{tmp_path}/two", visits.filter(first), "device_id", "device_name")
    before = dict(members(spark, f"{tmp_path}/two", "device_id", "id"))
    M.load_members(spark, f"{tmp_path}/two", visits if split == "overlap" else visits.filter(~first), "device_id", "device_name")
    told = ["device_id", "device_name", "first_seen", "last_seen"]
    key = lambda r: tuple(map(str, r))
    one, two = (sorted(map(tuple, M.current_members(spark, f"{tmp_path}/{k}", "device_id", "device_name").select(*told).collect()), key=key) for k in ("one", "two"))
    assert one == two and len(one) == len({r[0] for r in one}) == 62
    after = dict(members(spark, f"{tmp_path}/two", "device_id", "id"))
    assert all(after[d] == k for d, k in before.items())                       # keys stay
    assert sorted(after.values()) == list(range(1, 63))                        # new ones follow
    versions = lambda k: sorted(map(tuple, M.name_versions(spark, f"{tmp_path}/{k}", "device_id", "device_name").collect()), key=key)
    assert versions("one") == versions("two")


def test_a_batch_twice_and_a_load_that_broke_off(spark, tmp_path, visits):
    path = str(tmp_path)
    assert M.current_members(spark, path, "device_id", "device_name") is None
    assert M.load_members(spark, path, visits, "device_id", "device_name") == 62
    before = M.read_members(spark, path).orderBy("id").collect()
    assert M.load_members(spark, path, visits, "device_id", "device_name") == 0
    assert M.read_members(spark, path).orderBy("id").collect() == before
    M.read_names(spark, path).write.parquet(f"{path}/load=3/names")            # no members: not complete
    assert M.read_members(spark, path).orderBy("id").collect() == before


def test_versions_of_a_name(spark, tmp_path):
    rows = [("d", "old", T0), ("d", "new", T0 + dt.timedelta(days=2)), ("d", "old", T0 + dt.timedelta(days=1)), ("e", "same", T0)]
    df = spark.createDataFrame(rows, "device_id string, device_name string, timestamp timestamp_ntz")
    M.load_members(spark, str(tmp_path), df, "device_id", "device_name")
    got = sorted(map(tuple, M.name_versions(spark, str(tmp_path), "device_id", "device_name").collect()))
    assert got == [("d", "new", T0 + dt.timedelta(days=2), None, True), ("d", "old", T0, T0 + dt.timedelta(days=2), False), ("e", "same", T0, None, True)]
    assert members(spark, str(tmp_path), "device_id", "device_name") == [("d", "new"), ("e", "same")]
