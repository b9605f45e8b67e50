"""Stored ids by Bloom filters per date, and rows without an id: replays add nothing, nothing is lost."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from geoping.plans import etl
from geoping.session import scratch_path
from geoping.sources import id_index as ID
from geoping.streaming.ingest import make_batch_writer
from geoping.operators import spatial as SP
from geoping.sinks import writers as W
from geoping.sources.pings import normalise_pings

from .test_etl import _polys, _source, _tables
from .test_layout import rows_scanned


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Ids without order on 20 dates (one of them none), and their index."""
    rnd = random.Random(5)
    rows = [(rnd.getrandbits(62) - (1 << 61), None if i % 20 == 0 else dt.date(2024, 1, 1) + dt.timedelta(days=i % 20)) for i in range(8000)]
    rows += [(None, dt.date(2024, 1, 1))] * 50
    root = str(tmp_path_factory.mktemp("ids"))
    table = spark.createDataFrame(rows, "id long, date date")
    W.write_table(table.repartition(1), f"{root}/rows", "append", ["date"])
    blocks = ID.rebuild(spark, f"{root}/index", f"{root}/rows")
    return root, rows, blocks


def test_no_stored_id_is_taken_for_new(spark, stored):
    root, rows, blocks = stored
    ids = [i for i, _ in rows if i is not None]
    asked = spark.createDataFrame([(i,) for i in ids], "id long")
    maybe = ID.maybe_stored(asked, spark.read.parquet(f"{root}/index"), blocks)
    dates = {}
    for r in maybe.collect():
        dates.setdefault(r.id, set()).add(r.date)
    assert all(d in dates[i] for i, d in rows if i is not None)
    assert {r.id for r in ID.stored_ids(spark, asked, f"{root}/index", f"{root}/rows").collect()} == set(ids)


def test_strange_ids_rarely_pass_and_read_little(spark, stored):
    root, rows, blocks = stored
    rnd = random.Random(6)
    strange = spark.createDataFrame([(rnd.getrandbits(62) - (1 << 61),) for _ in range(20_000)], "id long")
    index = spark.read.parquet(f"{root}/index")
    assert ID.maybe_stored(strange, index, blocks).select("id").distinct().count() < 400      # 2 %; about 0.1 % as built
    one_day = spark.createDataFrame([(i,) for i, d in rows if d == dt.date(2024, 1, 7)][:40], "id long")
    found = ID.stored_ids(spark, one_day, f"{root}/index", f"{root}/rows")
    assert found.count() == 40
    assert rows_scanned(spark.read.schema("id long, date date").parquet(f"{root}/rows").filter("date = '2024-01-07'").select("id")) < 1000
    dates = {r.date for r in ID.maybe_stored(one_day, index, blocks).collect()}
    assert dt.date(2024, 1, 7) in dates and len(dates) <= 3


def test_batches_add_up(spark, stored, tmp_path):
    root, _, blocks = stored
    table = spark.read.schema("id long, date date").parquet(f"{root}/rows")
    for k in (0, 1, 1, 2):     # one of them twice
        ID.add_ids(spark, str(tmp_path), table.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == k), blocks)

    def bits(path):
        return {(str(r.date), r.block): bytes(r.bits) for r in spark.read.parquet(path).groupBy("date", "block").agg(F.bitmap_or_agg("bits").alias("bits")).collect()}

    assert bits(str(tmp_path)) == bits(f"{root}/index")
    assert 0 < ID.fill(spark, str(tmp_path)) < 0.1
    assert ID.index_blocks(spark, f"{root}/nothing") is None and ID.stored_ids(spark, table, f"{root}/nothing", f"{root}/rows") is None


def test_random_ids_through_the_job(spark):
    src = _source(spark).withColumn("id", F.xxhash64("id"))
    d, p = _polys(spark)
    full, inc = (etl.EtlPaths(scratch_path(spark, f"t-rnd-{uuid.uuid4().hex[:8]}")) for _ in range(2))
    etl.run_etl(spark, src, full, d, p, mode="full")
    third = F.pmod(F.xxhash64("device_id", "timestamp"), F.lit(3))
    drops = [src.filter(third != 2), src.filter(third != 0), src]
    added = [etl.run_etl(spark, drop, inc, d, p, rising_ids=False)["rows"] for drop in drops]
    a, b = _tables(spark, full), _tables(spark, inc)
    assert added[2] == 0 and sum(added) == a["locations"].count() == b["locations"].select("id").distinct().count()
    for k in ("grid", "device_days"):
        assert a[k].exceptAll(b[k]).count() == 0 and b[k].exceptAll(a[k]).count() == 0, k


def test_index_is_built_anew_when_full(spark, monkeypatch):
    monkeypatch.setattr(ID, "FULL", 0.0)
    src = _source(spark, 200).withColumn("id", F.xxhash64("id"))
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-full-{uuid.uuid4().hex[:8]}"))
    for _ in range(2):
        etl.run_etl(spark, src, paths, d, p, rising_ids=False)
    assert spark.read.parquet(paths.locations).count() == spark.read.parquet(paths.locations).select("id").distinct().count() > 0


@pytest.fixture(scope="module")
def without_ids(spark):
    src = _source(spark, 120).withColumn("id", F.when(F.col("id") % 3 != 0, F.col("id")))
    return src.unionByName(src.filter("id is null").limit(5)).withColumn("timestamp", F.when(F.coalesce(F.col("id"), F.lit(0)) % 10 != 1, F.col("timestamp")))


def test_replay_without_ids_through_the_job(spark, without_ids):
    d, p = _polys(spark)
    full, inc, broken = (etl.EtlPaths(scratch_path(spark, f"t-null-{uuid.uuid4().hex[:8]}")) for _ in range(3))
    etl.run_etl(spark, without_ids, full, d, p, mode="full")
    assert etl.run_etl(spark, without_ids, inc, d, p)["rows"] == 120      # the five that came twice are one each
    assert etl.run_etl(spark, without_ids, inc, d, p)["rows"] == 0
    # a first run that broke off after the rows were stored
    index = SP.build_index([("district", d, "district_id"), ("province", p, "province_id")])
    located = SP.assign_locations(etl.transform_locations(normalise_pings(without_ids, with_errors=False).dropDuplicates()), d, p, index=index)
    W.write_table(located, broken.locations, "append", ["date"])
    etl.run_etl(spark, without_ids, broken, d, p)
    a = _tables(spark, full)
    for b in (_tables(spark, inc), _tables(spark, broken)):
        assert a["locations"].drop("processed_at").exceptAll(b["locations"].drop("processed_at")).count() == 0 and b["locations"].count() == 120
        for k in ("grid", "device_days"):
            assert a[k].exceptAll(b[k]).count() == 0 and b[k].exceptAll(a[k]).count() == 0, k


def test_replay_without_ids_through_the_batch_writer(spark, without_ids):
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-nullw-{uuid.uuid4().hex[:8]}"))
    write = make_batch_writer(paths, SP.build_index([("district", d, "district_id"), ("province", p, "province_id")]), d, p)
    counts = []
    for _ in range(2):
        write(normalise_pings(without_ids, with_errors=False), 0)
        counts.append((spark.read.parquet(paths.locations).count(), etl.read_grid(spark, paths).agg(F.sum("point_count")).collect()[0][0]))
    assert counts == [(120, 120), (120, 120)]


def test_positions_without_ids(spark, without_ids):
    root = scratch_path(spark, f"t-dd-{uuid.uuid4().hex[:8]}")
    counts = [etl.run_device_day_job(spark, without_ids, root)["clean_rows"] for _ in range(2)]
    assert counts == [120, 0] and spark.read.parquet(f"{root}/clean_positions").count() == 120
