"""ST03 dedupe within watermark and ST04 day windows, run as bounded streams."""
import datetime as dt
import uuid

from geoping.session import scratch_path
from geoping.streaming import ingest as ST


def _land(spark, root, rows, name):
    df = spark.createDataFrame(rows, "id long, device_id string, device_name string, latitude double, "
                                     "longitude double, altitude double, speed double, battery double, "
                                     "signal double, sim_operator string, network_type string, "
                                     "timestamp timestamp_ntz")
    df.write.mode("overwrite").parquet(f"{root}/landing/{name}")


def test_dedupe_and_day_windows(spark):
    root = scratch_path(spark, f"st-{uuid.uuid4().hex[:8]}")
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(i, "d1", "D", 1.0, 1.0, None, float(i), 50.0, -60.0, None, None, t0 + dt.timedelta(hours=i))
            for i in range(6)]
    _land(spark, root, rows, "a")
    _land(spark, root, rows[:3], "b")     # the same ids again
    s = ST.dedupe_within_watermark(ST.ping_stream(spark, f"{root}/landing/*"), "1 day")
    q = s.writeStream.format("memory").queryName("dedup_t").outputMode("append") \
        .option("checkpointLocation", f"{root}/ck1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) c, count(distinct id) d from dedup_t").collect()[0] == (6, 6)
    days = ST.day_summary_stream(ST.ping_stream(spark, f"{root}/landing/a"), "1 day")
    q2 = days.writeStream.format("memory").queryName("days_t").outputMode("update") \
        .option("checkpointLocation", f"{root}/ck2").trigger(availableNow=True).start()
    q2.awaitTermination()
    r = spark.sql("select points_count, max_speed from days_t").collect()
    assert sorted(tuple(x) for x in r)[-1] == (6, 5.0)


def test_json_landing_stream_through_batch_writer(spark):
    import json

    from pyspark.sql import functions as F

    from geoping.plans.etl import EtlPaths, read_grid
    from tests.conftest import POLY_SCHEMA, geom_rows, square

    root = scratch_path(spark, f"stj-{uuid.uuid4().hex[:8]}")
    rows = [{"id": str(i), "device_id": f"d{i % 3}", "device_name": "D", "latitude": str(0.1 + (i % 10) / 10.0),
             "longitude": str(0.1 + (i % 7) / 10.0), "speed": "1.5" if i % 4 else "oops", "battery": "50",
             "signal": "-60", "network_type": "LTE", "sim_operator": "tigo",
             "timestamp": f"2024-03-0{1 + i % 3}T10:00:00"} for i in range(60)]
    import os
    os.makedirs(f"{root}/landing", exist_ok=True)
    for part in range(2):
        with open(f"{root}/landing/part-{part}.json", "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in rows[part * 30:(part + 1) * 30] + rows[:5]))  # 5 repeats
    d = (spark.createDataFrame(geom_rows([(1, [[square(0, 0, 2)]])]), POLY_SCHEMA)
         .withColumnRenamed("polygon_id", "district_id").withColumn("district_name", F.lit("D1")))
    p = (spark.createDataFrame(geom_rows([(7, [[square(0, 0, 2)]])]), POLY_SCHEMA)
         .withColumnRenamed("polygon_id", "province_id").withColumn("province_name", F.lit("P7")))
    paths = EtlPaths(root)
    ST.run_available_now(spark, f"{root}/landing", paths, f"{root}/_ck", d, p, fmt="json", max_files_per_trigger=1)
    loc = spark.read.parquet(paths.locations)
    assert loc.count() == 60 and loc.select("id").distinct().count() == 60      # repeats dropped
    assert loc.filter("district_id = 1 and province_id = 7").count() == 60
    assert loc.filter("speed = 0.0").count() == 15                               # 'oops' -> null -> 0.0
    grid = read_grid(spark, paths)
    assert grid.agg(F.sum("point_count")).collect()[0][0] == 60


def test_day_streams_send_late_rows_the_batch_way(spark):
    from geoping.operators.devices import device_day_summary

    root = scratch_path(spark, f"days-{uuid.uuid4().hex[:8]}")
    t0 = dt.datetime(2024, 1, 1, 10)
    row = lambda i, day, lat=1.0: (i, f"d{i % 3}", "D", lat, 1.0, None, float(i), 50.0, -60.0, None, None, None if day is None else t0 + dt.timedelta(days=day, minutes=i))
    first = [row(i, i % 10) for i in range(40)]
    late = [row(100 + i, i % 2) for i in range(5)] + first[:7] + [row(200, None), row(201, 3, None), row(202, 12)]
    _land(spark, root, first, "a")
    ST.run_day_streams(spark, f"{root}/landing/*", root)
    _land(spark, root, late, "b")
    ST.run_day_streams(spark, f"{root}/landing/*", root)
    again = ST.settle_days(spark, root)
    stored = spark.read.parquet(f"{root}/positions")
    assert stored.count() == stored.select("id").distinct().count() == 40 + 5 + 2
    want = device_day_summary(stored, ordered=False)
    got = spark.read.parquet(f"{root}/summary").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert None in again and dt.date(2024, 1, 1) in again and dt.date(2024, 1, 5) not in again      # late, closed in the stream
