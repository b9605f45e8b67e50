"""S05/S09/S10/S11 sources, P13 audit, K07 schema evolution, K09 output, A31 ledger, F31 backfill."""
import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from geoping import schemas as S
from geoping.operators import reports as R
from geoping.operators.transform import backfill_time_fields
from geoping.session import scratch_path
from geoping.sinks import writers as W
from geoping.sources import ledger as L
from geoping.sources import pings as P
from geoping.sources import polygons as PS

from .conftest import POLY_SCHEMA, geom_rows, square


def test_json_pings_fixed_schema_and_empty_input(spark, tmp_path):
    lines = [{"id": 1, "device_id": "a", "latitude": "-18.1", "longitude": -63.2, "battery": 55.5,
              "timestamp": "2024-02-01T08:00:00"},
             {"id": "2", "latitude": "bad", "longitude": "-63.2", "speed": "3.5", "extra": "ignored"}]
    f = tmp_path / "p.json"
    f.write_text("\n".join(json.dumps(x) for x in lines))
    df = P.read_ping_json(spark, str(f)).orderBy("id").collect()
    assert df[0]["latitude"] == -18.1 and df[0]["battery"] == 55.0 and df[1]["speed"] == 3.5
    assert df[1]["_errors"] == ["unparsable_latitude"]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "none.json").write_text("")
    e = P.read_ping_json(spark, str(empty))
    assert e.count() == 0 and e.columns[:len(S.PING_COLUMNS)] == S.PING_COLUMNS


def test_geojson_text_and_lookups(spark):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"DISTRITO": "2", "NOMBRE": "Norte"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"DISTRITO": "1", "NOMBRE": "Sur"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, -1], [1, -1], [1, 0], [0, 0], [0, -1]]]}}]}
    texts = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"type": "Feature"}),)], "text string")
    d = PS.district_attributes(PS.geojson_text_features(spark, texts))
    assert [r["district_name"] for r in PS.ordered(d, "district_number").collect()] == ["Sur", "Norte"]
    assert [r["district_name"] for r in PS.lookup(d, "district_number", 2).collect()] == ["Norte"]
    m = PS.with_measures(d).orderBy("district_number").collect()
    assert m[0]["area_deg2"] == 1.0 and m[0]["issues"] == []


def test_required_columns_and_schema_evolution(spark):
    df = spark.createDataFrame([(1, "a")], "id long, device_id string")
    audit = {r["column_name"]: r["present"] for r in R.required_columns_audit(df, ["id", "date"]).collect()}
    assert audit == {"id": True, "date": False}
    root = scratch_path(spark, f"evolve-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([(1, "a")], "id long, device_id string").write.parquet(f"{root}/t/part=1")
    spark.createDataFrame([(2, "b", 3.0)], "id long, device_id string, speed double").write.parquet(f"{root}/t/part=2")
    ev = W.read_evolving(spark, f"{root}/t", S.PING_SCHEMA)
    assert set(S.PING_COLUMNS) <= set(ev.columns) and ev.filter("speed = 3.0").count() == 1
    aligned = W.align_to(df, ["id", "device_id", "district_id"], {"district_id": "long"})
    assert aligned.columns == ["id", "device_id", "district_id"]
    W.ensure_table(spark, f"{root}/empty", S.DEVICE_DAY_SCHEMA, ["date"])
    assert spark.read.schema(S.DEVICE_DAY_SCHEMA).parquet(f"{root}/empty").count() == 0


def test_write_table_counts_and_replace_partitions(spark):
    root = scratch_path(spark, f"sink-{uuid.uuid4().hex[:8]}")
    df = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 3)) for i in range(30)], "id long, date date")
    assert W.write_table(df, f"{root}/t", "append", ["date"]) == 30
    new_day = spark.createDataFrame([(100, dt.date(2024, 1, 2))], "id long, date date")
    assert W.replace_partitions(new_day, f"{root}/t", ["date"]) == 1
    back = spark.read.parquet(f"{root}/t")
    assert back.count() == 21 and back.filter("date = '2024-01-02'").collect()[0]["id"] == 100


def test_ledger_reports(spark):
    root = scratch_path(spark, f"ledger-{uuid.uuid4().hex[:8]}")
    day = dt.datetime(2024, 5, 1, 10)
    L.append_run(spark, root, 10, 10, "SUCCESS", 1.0, when=day)
    L.append_run(spark, root, 25, 15, "SUCCESS", 1.0, when=day + dt.timedelta(hours=1))
    L.append_run(spark, root, 25, 0, "FAILED", 1.0, "boom", when=day + dt.timedelta(hours=2))
    led = L.read_ledger(spark, root)
    assert L.last_success(led).collect()[0][0] == 25
    assert [r["status"] for r in L.history(led, 2).collect()] == ["FAILED", "SUCCESS"]
    assert L.rows_on(led, "2024-05-01").collect()[0][0] == 25
    assert L.last_success(L.read_ledger(spark, root + "-missing")).collect()[0][0] is None


def test_backfill_time_fields(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 7), None), (2, dt.datetime(2024, 1, 1, 20), 5)],
                               "id long, timestamp timestamp_ntz, hour_value int")
    got = {r["id"]: (r["hour_value"], r["time_period"]) for r in backfill_time_fields(df).collect()}
    assert got == {1: (7, "MAÑANA"), 2: (5, "NOCHE")}


def test_feature_lines_are_read_back_with_unique_numbers_and_closed_rings(spark, tmp_path):
    polys = spark.createDataFrame(geom_rows([(i, [[square(i, 0, 1)]]) for i in range(3)]), POLY_SCHEMA).withColumn("nombre", F.concat(F.lit("P"), "polygon_id"))
    W.geojson_features(polys, ["nombre"]).coalesce(1).write.text(str(tmp_path / "lines"))
    back = PS.province_attributes(PS.read_geojson_lines(spark, str(tmp_path / "lines"))).collect()
    assert sorted(r["province_id"] for r in back) == [1, 2, 3] and {r["province_name"] for r in back} == {"P0", "P1", "P2"}
    assert {r["department"] for r in back} == {"Santa Cruz"}
    open_ring = '{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}'
    feats = PS.geojson_text_features(spark, spark.createDataFrame([(open_ring,)], "text string")).collect()
    assert len(feats[0]["geom"][0][0]) == 5
