"""Geometry measures, WKT/GeoJSON round trips, point-in-polygon boundary rules."""

from geoping.functions import geometry as G
from geoping.sources import polygons as PS

from .conftest import POLY_SCHEMA, geom_rows, square


def _polys(spark, polys):
    return spark.createDataFrame(geom_rows(polys), POLY_SCHEMA)


def test_area_perimeter_centroid_with_hole(spark):
    outer = square(0, 0, 4)
    hole = list(reversed(square(1, 1, 1)))
    df = _polys(spark, [(1, [[outer, hole]])])
    r = df.select(G.area_deg2("geom").alias("a"), G.length_deg("geom").alias("l"),
                  G.centroid("geom").alias("c"), G.area_km2("geom").alias("km")).collect()[0]
    assert r["a"] == 15.0 and r["l"] == 20.0
    # centroid of 4x4 square minus unit square at (1..2): (16*2 - 1*1.5) / 15
    assert abs(r["c"]["x"] - (32 - 1.5) / 15) < 1e-12 and abs(r["c"]["y"] - (32 - 1.5) / 15) < 1e-12
    assert r["km"] == round(15 * 111 * 106, 2)


def test_point_in_polygon_rules(spark):
    concave = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]
    hole = [(1, 0.5), (1, 1), (1.5, 1), (1.5, 0.5), (1, 0.5)]
    second = square(10, 10, 1)
    geom = geom_rows([(1, [[concave, hole], [second]])])[0][1]
    pts = [("vertex", 4.0, 4.0), ("slanted_edge", 3.0, 3.0), ("inside", 3.0, 1.0), ("notch", 2.0, 3.0),
           ("hole_edge", 1.0, 0.75), ("in_hole", 1.25, 0.75), ("second_part", 10.5, 10.5), ("bottom_edge", 2.0, 0.0)]
    p = spark.createDataFrame([(n, x, y, geom) for n, x, y in pts],
                              "name string, x double, y double, " + POLY_SCHEMA.split(", ", 1)[1])
    got = {r["name"]: r["c"] for r in p.select("name", G.contains("geom", "x", "y").alias("c")).collect()}
    assert got == {"vertex": False, "slanted_edge": False, "inside": True, "notch": False, "hole_edge": False,
                   "in_hole": False, "second_part": True, "bottom_edge": False}


def test_wkt_and_geojson_roundtrip(spark):
    df = _polys(spark, [(1, [[square(-63.5, -18.25, 0.125)], [square(-63.0, -18.0, 0.0625)]])])
    back = df.select(G.from_wkt(G.to_wkt("geom")).alias("g"), "geom").collect()[0]
    assert back["g"] == back["geom"]
    gj = df.select(G.to_geojson("geom").alias("t")).collect()[0]["t"]
    assert gj.startswith('{"type":"MultiPolygon","coordinates":[[[[-63.5,-18.25]')
    poly_txt = "SRID=4326;POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"
    r = spark.createDataFrame([(poly_txt,)], "w string").select(G.area_deg2(G.from_wkt("w")).alias("a")).collect()[0]
    assert r["a"] == 1.0


def test_validity_flags_and_repair(spark):
    open_ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    short = [(0, 0), (1, 0), (0, 0)]
    df = _polys(spark, [(1, [[open_ring]]), (2, [[short]]), (3, [[square(0, 0, 1)]])])
    flags = {r["polygon_id"]: r["f"] for r in df.select("polygon_id", G.validity_issues("geom").alias("f")).collect()}
    assert "ring_not_closed" in flags[1] and "ring_too_short" in flags[2] and flags[3] == []
    fixed = df.filter("polygon_id = 1").select(G.validity_issues(G.close_rings("geom")).alias("f")).collect()[0]["f"]
    assert fixed == []


def test_geojson_features(spark, tmp_path):
    doc = """{"type": "FeatureCollection", "features": [
      {"type": "Feature", "properties": {"DISTRITO": "Distrito 7", "NOMBRE": "Centro"},
       "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},
      {"type": "Feature", "properties": {"distrito": "001", "nombre": ""},
       "geometry": {"type": "MultiPolygon", "coordinates": [[[[2,2],[3,2],[3,3],[2,3],[2,2]]]]}},
      {"type": "Feature", "properties": {"name": "Sin numero"},
       "geometry": {"type": "Polygon", "coordinates": [[[5,5],[6,5],[6,6],[5,6],[5,5]]]}},
      {"type": "Feature", "properties": {"NOMBRE": "Punto"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
      {"type": "Feature", "properties": {"NOMBRE": "Nada"}, "geometry": null}
    ]}"""
    path = tmp_path / "d.geojson"
    path.write_text(doc)
    feats = PS.district_attributes(PS.read_geojson_features(spark, str(path)))
    rows = sorted((r["district_number"], r["district_name"]) for r in feats.collect())
    assert rows == [(1, "Distrito 1"), (3, "Sin numero"), (7, "Centro")]
