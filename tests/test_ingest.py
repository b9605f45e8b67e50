"""S01-S06, P01-P05, P03 quarantine, J12."""
import datetime as dt

from pyspark.sql import functions as F

from geoping import schemas as S
from geoping.operators.transform import transform_locations
from geoping.sources import pings as P


def _raw(spark, rows):
    return spark.createDataFrame(rows, S.RAW_PING_SCHEMA)


def test_normalise_dirty_values(spark):
    rows = [("1", "d", "D", "-18.1", "-63.1", "410", "2.5", "87.9", "-65.7", None, None, "2024-01-01T10:00:00"),
            ("2", "d", "D", "abc", "-63.1", "x", "NaN", "50", "-70", "", "", "not a time"),
            ("3", "d", "D", "95", "-200", None, "-1", "120", None, None, None, None)]
    df = P.normalise_pings(_raw(spark, rows)).orderBy("id").collect()
    assert df[0]["battery"] == 87.0 and df[0]["signal"] == -65.0 and df[0]["timestamp"] == dt.datetime(2024, 1, 1, 10)
    assert df[1]["latitude"] is None and df[1]["speed"] is None and df[1]["timestamp"] is None
    assert set(df[1]["_errors"]) == {"unparsable_latitude", "unparsable_altitude", "unparsable_timestamp"}
    valid, bad = P.split_quarantine(P.normalise_pings(_raw(spark, rows)))
    assert [r["id"] for r in valid.collect()] == [1]
    reasons = {r["id"]: r["reason"] for r in bad.collect()}
    assert reasons[3] == "latitude_out_of_range,longitude_out_of_range,speed_negative,battery_out_of_range"
    assert reasons[2].startswith("unparsable_latitude")


def test_coordinate_filter_edges(spark):
    rows = [(str(i), "d", "D", lat, lon, None, None, None, None, None, None, None) for i, (lat, lon) in enumerate(
        [("90", "180"), ("-90", "-180"), ("90.0001", "0"), ("0", "-180.0001"), (None, "1"), ("1", None)])]
    locs = transform_locations(P.normalise_pings(_raw(spark, rows)))
    assert sorted(r["id"] for r in locs.collect()) == [0, 1]


def test_null_fill_after_classes(spark):
    rows = [("1", "d", "D", "1", "1", None, None, None, None, None, None, "2024-01-01T13:00:00")]
    r = transform_locations(P.normalise_pings(_raw(spark, rows))).collect()[0]
    assert r["altitude"] == 0.0 and r["altitude_range"] is None and r["battery_level"] is None
    assert r["speed_range"] == "DETENIDO" and r["period"] == "TARDE" and r["network_type"] == "SIN DATOS"
    assert r["sim_operator"] == "SIN SEÑAL" and r["network_type_raw"] is None


def test_scans(spark):
    rows = [(str(i), f"d{i % 2}", "D", "1", "1", None, None, None, None, None, "LTE" if i % 3 else "EDGE",
             f"2024-01-{1 + i % 28:02d}T00:00:00") for i in range(1, 31)]
    df = P.normalise_pings(_raw(spark, rows))
    assert [r["id"] for r in P.page_scan(df, 5, 10).collect()] == list(range(11, 16))
    assert P.incremental_scan(df, last_id=20).count() == 10
    assert P.incremental_scan(df, last_id=0).count() == 30
    assert P.count_records(df, {"network_type": "EDGE"}).collect()[0]["total"] == 10
    f = P.filtered_scan(df, {"device_id": "d1"}, start="2024-01-05 00:00:00", end="2024-01-10 00:00:00")
    assert sorted(r["id"] for r in f.collect()) == [5, 7, 9]
    existing = df.filter(F.col("id") <= 25)
    assert sorted(r["id"] for r in P.only_new(df, existing).collect()) == [26, 27, 28, 29, 30]


def test_processed_at_is_stamped_only_when_absent(spark):
    pings = P.normalise_pings(_raw(spark, [dict(id=1, latitude=19.5, longitude=-70.5)]))
    before = pings.withColumn("processed_at", F.lit("2020-01-02 03:04:05").cast("timestamp"))
    year = lambda df: [r.y for r in transform_locations(df).select(F.year("processed_at").alias("y")).collect()]
    assert year(before) == [2020]
    assert year(pings)[0] > 2020
