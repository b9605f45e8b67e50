"""ETL plan: incremental == full, idempotent rerun, failures recorded, late rows replace dates."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from geoping.plans import etl
from geoping.session import scratch_path
from geoping.sources import ledger as L

from .conftest import POLY_SCHEMA, geom_rows, square


def _source(spark, n=600, seed=11):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 1)
    rows = [(i, f"dev-{i % 7}", f"Device {i % 7}", rnd.uniform(0, 2), rnd.uniform(0, 2), float(rnd.randint(300, 600)),
             rnd.choice([None, 0.0, 2.0, 20.0]), float(rnd.randint(0, 100)), -float(rnd.randint(50, 100)),
             rnd.choice(["tigo", None]), rnd.choice(["LTE", "EDGE"]), base + dt.timedelta(hours=rnd.randint(0, 96)))
            for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id long, device_id string, device_name string, latitude double, "
                                       "longitude double, altitude double, speed double, battery double, "
                                       "signal double, sim_operator string, network_type string, "
                                       "timestamp timestamp_ntz")


def _polys(spark):
    d = (spark.createDataFrame(geom_rows([(1, [[square(0, 0, 1)]]), (2, [[square(1, 0, 1)]])]), POLY_SCHEMA)
         .withColumnRenamed("polygon_id", "district_id").withColumn("district_name", F.lit("D")))
    p = (spark.createDataFrame(geom_rows([(9, [[square(0, 0, 2)]])]), POLY_SCHEMA)
         .withColumnRenamed("polygon_id", "province_id").withColumn("province_name", F.lit("P")))
    return d, p


def _tables(spark, paths):
    return {"locations": spark.read.parquet(paths.locations), "grid": etl.read_grid(spark, paths),
            "device_days": spark.read.parquet(paths.device_days)}


def test_incremental_equals_full(spark):
    src = _source(spark)
    d, p = _polys(spark)
    full = etl.EtlPaths(scratch_path(spark, f"t-full-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, full, d, p, mode="full")
    inc = etl.EtlPaths(scratch_path(spark, f"t-inc-{uuid.uuid4().hex[:8]}"))
    r1 = etl.run_etl(spark, src.filter("id <= 250"), inc, d, p)
    r2 = etl.run_etl(spark, src, inc, d, p)
    r3 = etl.run_etl(spark, src, inc, d, p)          # nothing new: a no-op run
    assert r1["rows"] + r2["rows"] == full_rows(spark, full) and r3["rows"] == 0
    a, b = _tables(spark, full), _tables(spark, inc)
    for k in ("grid", "device_days"):
        assert a[k].exceptAll(b[k]).count() == 0 and b[k].exceptAll(a[k]).count() == 0, k
    cols = ["id", "district_id", "province_id", "speed_range"]
    assert a["locations"].select(cols).exceptAll(b["locations"].select(cols)).count() == 0
    assert b["locations"].count() == b["locations"].select("id").distinct().count()
    marks = L.read_ledger(spark, inc.ledger).orderBy("execution_date").collect()
    assert [m["status"] for m in marks] == ["SUCCESS"] * 3 and marks[-1]["last_processed_id"] == 600


def full_rows(spark, paths):
    return spark.read.parquet(paths.locations).count()


def test_failed_run_is_recorded_and_mark_kept(spark):
    src = _source(spark, 100)
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-fail-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src.filter("id <= 50"), paths, d, p)
    broken = src.withColumn("latitude", F.raise_error(F.lit("source unavailable")).cast("double"))
    try:
        etl.run_etl(spark, broken, paths, d, p)
        raise AssertionError("expected a failure")
    except Exception as exc:  # noqa: BLE001
        assert "source unavailable" in str(exc)
    runs = L.read_ledger(spark, paths.ledger).orderBy("execution_date").collect()
    assert [r["status"] for r in runs] == ["SUCCESS", "FAILED"]
    assert L.last_success(L.read_ledger(spark, paths.ledger)).collect()[0][0] == 50


def _same(spark, a, b, columns=("id", "district_id", "province_id", "date")):
    x, y = _tables(spark, a), _tables(spark, b)
    for k in ("grid", "device_days"):
        assert x[k].exceptAll(y[k]).count() == 0 and y[k].exceptAll(x[k]).count() == 0, k
    x, y = (t["locations"].select(*columns) for t in (x, y))
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def _untimed(src):
    """Some pings without a timestamp."""
    return src.withColumn("timestamp", F.when(F.col("id") % 17 != 0, F.col("timestamp")))


@pytest.mark.parametrize("sink", [0, 1, 2])
def test_rerun_after_a_crash_between_sinks_equals_a_full_run(spark, monkeypatch, sink):
    src = _untimed(_source(spark, 200))
    d, p = _polys(spark)
    full = etl.EtlPaths(scratch_path(spark, f"t-cf-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, full, d, p, mode="full")
    paths = etl.EtlPaths(scratch_path(spark, f"t-crash-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src.filter("id < 0"), paths, d, p)      # an empty first batch
    real, calls = etl.W.replace_partitions, []

    def broken(*args, **options):
        calls.append(1)
        if len(calls) > sink:
            raise RuntimeError("lost")
        return real(*args, **options)

    for batch in (src.filter("id <= 90"), src):                # the first run breaks as well as the second
        calls.clear()
        monkeypatch.setattr(etl.W, "replace_partitions", broken)
        if sink < 2:
            with pytest.raises(RuntimeError):
                etl.run_etl(spark, batch, paths, d, p)
        else:                                                  # all sinks written, the ledger row is not
            etl.run_etl(spark, batch, paths, d, p)
            monkeypatch.setattr(etl.L, "last_mark", lambda *a: None)
        monkeypatch.setattr(etl.W, "replace_partitions", real)
        etl.run_etl(spark, batch, paths, d, p)
    _same(spark, full, paths)


def test_duplicate_ids_inside_a_batch_and_across_dates(spark):
    src = _source(spark, 60)
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-dup-{uuid.uuid4().hex[:8]}"))
    old = src.withColumn("timestamp", F.col("timestamp") - F.expr("interval 1 day"))
    etl.run_etl(spark, src.unionByName(old), paths, d, p)
    full = etl.EtlPaths(scratch_path(spark, f"t-dupf-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, full, d, p, mode="full")
    _same(spark, full, paths)
    moved = src.withColumn("timestamp", F.col("timestamp") + F.expr("interval 3 days"))
    later = etl.drop_stored(spark, moved, paths.locations, etl.touched(moved))
    assert later.count() == 0                                   # stored on other dates


def test_full_rebuild_drops_old_days_and_reads_only_touched_dates(spark):
    src = _untimed(_source(spark, 200))
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-re-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, paths, d, p, mode="full")
    stored = spark.read.parquet(paths.locations)
    plan = etl.on_dates(stored, [dt.date(2024, 3, 1), None])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(date" in plan or "PartitionFilters: [((" in plan or "2024-03-01" in plan.split("PartitionFilters")[1][:200]
    etl.run_etl(spark, src.filter("to_date(timestamp) = date'2024-03-02'"), paths, d, p, mode="full")
    assert [r[0] for r in spark.read.parquet(paths.device_days).select("date").distinct().collect()] == [dt.date(2024, 3, 2)]


def test_reassign_fills_rows_without_a_timestamp(spark):
    src = _untimed(_source(spark, 120))
    d, p = _polys(spark)
    paths = etl.EtlPaths(scratch_path(spark, f"t-ra-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, paths, d, p.limit(0), mode="full")
    assert spark.read.parquet(paths.locations).filter("province_id is not null").count() == 0
    etl.reassign_missing(spark, paths, d, p)
    full = etl.EtlPaths(scratch_path(spark, f"t-raf-{uuid.uuid4().hex[:8]}"))
    etl.run_etl(spark, src, full, d, p, mode="full")
    _same(spark, full, paths)


def test_the_same_batch_twice_changes_no_device_day(spark):
    src = _untimed(_source(spark, 120))
    root = scratch_path(spark, f"t-dd-{uuid.uuid4().hex[:8]}")
    etl.run_device_day_job(spark, src, root)
    first = spark.read.parquet(f"{root}/device_day_summary").collect()
    etl.run_device_day_job(spark, src, root)
    assert sorted(map(str, spark.read.parquet(f"{root}/device_day_summary").collect())) == sorted(map(str, first))
    assert sum(r["points_count"] for r in first) == 120


def test_rows_without_known_or_repeated_ids_are_not_shuffled(spark):
    """Whole rows meet in a shuffle only where an id is stored or comes again."""
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    src = _source(spark, 60)
    path = scratch_path(spark, f"t-ids-{uuid.uuid4().hex[:8]}")
    src.filter("id <= 20").write.parquet(path)
    assert etl.touched(src).keyless == 0
    assert "Window" not in plan(etl.latest_per_id(src)) and "Union" not in plan(etl.latest_per_id(src))
    new = src.filter("id > 20")
    assert "Join" not in plan(etl.drop_stored(spark, new, path, etl.touched(new)))
    assert sorted(r.id for r in etl.drop_stored(spark, src, path, etl.touched(src)).collect()) == list(range(21, 61))
    keyless = src.filter("id <= 3").withColumn("id", F.lit(None).cast("long"))
    older = src.filter("id <= 5").withColumn("timestamp", F.col("timestamp") - F.expr("interval 1 day"))
    got = etl.latest_per_id(src.unionByName(older).unionByName(keyless))
    assert sorted(map(tuple, got.select(*src.columns).collect()), key=repr) == sorted(map(tuple, src.unionByName(keyless).collect()), key=repr)
