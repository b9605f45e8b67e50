"""F01-F07 thresholds: below, equal, above, null (hand-made rows)."""
import datetime as dt

from pyspark.sql import functions as F

from geoping.functions import classify as C


def _one(spark, values, fn, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_period_boundaries(spark):
    ts = [dt.datetime(2024, 1, 1, h, 0) for h in (5, 6, 11, 12, 18, 19, 23)] + [None]
    got = _one(spark, ts, C.period_of_day, "timestamp_ntz")
    assert got == ["NOCHE", "MAÑANA", "MAÑANA", "TARDE", "TARDE", "NOCHE", "NOCHE", "NOCHE"]


def test_altitude_battery_signal(spark):
    assert _one(spark, [None, 0.0, 400.0, 400.5, 500.0, 500.1], C.altitude_range) == \
        [None, "BAJA", "BAJA", "MEDIA", "MEDIA", "ALTA"]
    assert _one(spark, [None, 24.9, 25.0, 49.9, 50.0, 74.9, 75.0, 100.0], C.battery_level) == \
        [None, "CRITICO", "BAJO", "BAJO", "MEDIO", "MEDIO", "ALTO", "ALTO"]
    assert _one(spark, [None, -59.0, -60.0, -70.0, -70.5, -80.0, -80.5], C.signal_quality) == \
        [None, "EXCELENTE", "EXCELENTE", "BUENA", "REGULAR", "REGULAR", "POBRE"]


def test_speed_range_boundaries(spark):
    vals = [None, 0.0, -1.0, 5 / 3.6, 5 / 3.6 + 1e-9, 10 / 3.6, 10 / 3.6 + 1e-9, 60 / 3.6, 60 / 3.6 + 1e-9]
    got = _one(spark, vals, C.speed_range)
    assert got[0] == "DETENIDO" and got[1] == "DETENIDO" and got[2] == "CAMINANDO"
    assert got[4] == "CORRIENDO" and got[6] == "TRANSPORTE PÚBLICO" and got[8] == "VEHÍCULO"
    # Spark computes speed * 3.6 exactly like the reference, so the boundary rows follow the same float rule
    for v, g in zip(vals[3::2], got[3::2]):
        kmh = v * 3.6
        want = "CAMINANDO" if kmh <= 5 else "CORRIENDO" if kmh <= 10 else "TRANSPORTE PÚBLICO" if kmh <= 60 else "VEHÍCULO"
        assert g == want


def test_network_live_and_strict(spark):
    vals = [None, "", "WiFi", "wi-fi", "5G NR", "LTE", "MOBILE", "Mobile Broadband Net", "HSPA+", "EDGE", "GSM",
            "satellite"]
    live = _one(spark, vals, lambda c: C.network_generation(c), "string")
    strict = _one(spark, vals, lambda c: C.network_generation(c, strict=True), "string")
    assert live == ["SIN DATOS", "SIN DATOS", "WiFi", "WiFi", "5G", "4G", "4G", "4G", "3G", "2G", "2G", "SIN DATOS"]
    assert strict == ["SIN DATOS", "SIN DATOS", "WiFi", "WiFi", "5G", "4G", "4G", "SIN DATOS", "3G", "2G", "2G",
                      "SIN DATOS"]


def test_operator_live_and_strict(spark):
    vals = [None, "", " ", "Unknown", "SIN SEÑAL", "Sin Señal 4", "SIN SEAL", "N/A", "NA", "ENTEL S.A.", "BOMOV",
            "+18vacunate", "LADISTANCIANOSCUIDA", "movil gsm", "T-Mobile", "tigo", "VIVA BO", "Claro"]
    live = _one(spark, vals, lambda c: C.normalize_operator(c), "string")
    strict = _one(spark, vals, lambda c: C.normalize_operator(c, strict=True), "string")
    assert live == ["SIN SEÑAL", "SIN SEÑAL", " ", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL",
                    "NA", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "TIGO", "VIVA", "Claro"]
    assert strict == ["SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL", "SIN SEÑAL",
                      "SIN SEÑAL", "SIN SEÑAL", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "ENTEL", "TIGO", "VIVA",
                      "CLARO"]


def test_grid_and_ewkt(spark):
    df = spark.createDataFrame([(-63.1821, -18.005)], "lon double, lat double")
    r = df.select(C.grid_index("lon", 0.01).alias("i"), C.grid_snap("lat", 0.01).alias("s"),
                  C.ewkt_point("lon", "lat").alias("p")).collect()[0]
    assert r["i"] == -6319 and r["p"] == "SRID=4326;POINT(-63.1821 -18.005)"
    assert abs(r["s"] - (-18.01)) < 1e-12
