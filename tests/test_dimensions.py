"""Surrogate keys (both paths), dimension load-if-missing, fixed dimensions."""
from pyspark.sql import functions as F

from geoping.operators import dimensions as D


def test_dense_keys_do_not_depend_on_the_number_of_ranges(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i % 7) for i in range(500)], "name string, g int").repartition(6)
    small = {r["name"]: r["id"] for r in D.dense_keys(df, ["g", "name"], partitions=1).collect()}
    large = {r["name"]: r["id"] for r in D.dense_keys(df, ["g", "name"], partitions=9).collect()}
    assert small == large and sorted(small.values()) == list(range(1, 501))


def test_fixed_dimensions_and_missing_members(spark):
    t = D.dim_time(spark).collect()
    assert len(t) == 24 and t[6]["period"] == "MAÑANA" and t[12]["period_code"] == "AFT" and t[0]["period"] == "NOCHE"
    assert [r["altitude_range"] for r in D.dim_altitude(spark).orderBy("id").collect()] == ["BAJA", "MEDIA", "ALTA"]
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "operator_name string")
    old = spark.createDataFrame([("b",)], "operator_name string")
    assert sorted(r[0] for r in D.missing_members(new, old, "operator_name").collect()) == ["a", "c"]


def test_fact_keeps_every_row(spark):
    import datetime as dt
    rows = [(i, f"d{i % 3}", "D", 1.0, 1.0, "LTE" if i % 2 else None, "4G" if i % 2 else "SIN DATOS", "TIGO",
             "BAJA" if i % 4 else None, "ALTO", dt.datetime(2024, 1, 1, i % 24), dt.date(2024, 1, 1), 0.0, 0.0,
             0.0, 0.0, "p") for i in range(40)]
    loc = spark.createDataFrame(rows, "id long, device_id string, device_name string, latitude double, "
                                      "longitude double, network_type_raw string, network_generation string, "
                                      "sim_operator string, altitude_range string, battery_level string, "
                                      "timestamp timestamp_ntz, date date, altitude double, speed double, "
                                      "battery double, signal double, location_geom string")
    f = D.fact_locations(spark, loc)
    assert f.count() == 40
    assert f.filter(F.col("network_id").isNull()).count() == 0      # null raw network joins null-safely
    assert f.filter(F.col("altitude_id").isNull()).count() == 10
