"""Geometry as Catalyst expressions over nested arrays (no Python, no geometry library).

A (multi)polygon is ``array<array<array<struct<x:double,y:double>>>>``: parts ->
rings -> closed vertex lists (first == last); ring 0 of each part is the shell,
further rings are holes. Every function here is a higher-order-function
expression (``transform``/``aggregate``/``exists``), so it runs inside the JVM
on whatever executor holds the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ring_indexes(ring: Column) -> Column:
    """0 .. n-2 for a closed ring of n vertices (empty for degenerate rings)."""
    return F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(
        F.array().cast("array<int>"))


def ring_edges(ring: Column) -> Column:
    """Edges (x1, y1, x2, y2) of one closed ring."""
    return F.transform(_ring_indexes(ring), lambda i: F.struct(
        ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"),
        ring[i + 1]["x"].alias("x2"), ring[i + 1]["y"].alias("y2")))


def edges(geom: Column | str) -> Column:
    """All edges of all rings of all parts (even-odd over these handles holes and parts)."""
    return F.flatten(F.transform(F.flatten(_c(geom)), ring_edges))


def all_points(geom: Column | str) -> Column:
    return F.flatten(F.flatten(_c(geom)))


def bbox(geom: Column | str) -> Column:
    """struct(minx, miny, maxx, maxy)."""
    pts = all_points(geom)
    return F.struct(
        F.array_min(F.transform(pts, lambda p: p["x"])).alias("minx"),
        F.array_min(F.transform(pts, lambda p: p["y"])).alias("miny"),
        F.array_max(F.transform(pts, lambda p: p["x"])).alias("maxx"),
        F.array_max(F.transform(pts, lambda p: p["y"])).alias("maxy"))


def ring_signed_area(ring: Column) -> Column:
    """Shoelace signed area of a closed ring (deg², counter-clockwise positive)."""
    return F.aggregate(ring_edges(ring), F.lit(0.0),
                       lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / F.lit(2.0)


def _part_area(part: Column) -> Column:
    """|shell| - sum |holes|."""
    return F.aggregate(F.transform(part, lambda ring, i: F.when(i == 0, F.abs(ring_signed_area(ring)))
                                   .otherwise(-F.abs(ring_signed_area(ring)))),
                       F.lit(0.0), lambda a, v: a + v)


def area_deg2(geom: Column | str) -> Column:
    """planar area in square degrees (outer rings minus holes, summed over parts)."""
    return F.aggregate(F.transform(_c(geom), _part_area), F.lit(0.0), lambda a, v: a + v)


def area_km2(geom: Column | str, digits: int | None = 2) -> Column:
    """deg² * 111 * 106, rounded to 2 dp (HALF_UP)."""
    v = area_deg2(geom) * F.lit(S.KM_PER_DEG_AREA_X) * F.lit(S.KM_PER_DEG_AREA_Y)
    return F.round(v, digits) if digits is not None else v


def length_deg(geom: Column | str) -> Column:
    """Sum of the planar edge lengths of every ring (degrees)."""
    return F.aggregate(edges(geom), F.lit(0.0), lambda a, e: a + F.sqrt(
        (e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])))


def perimeter_km(geom: Column | str, digits: int | None = 2) -> Column:
    """planar length * 108.5, rounded to 2 dp."""
    v = length_deg(geom) * F.lit(S.KM_PER_DEG_LENGTH)
    return F.round(v, digits) if digits is not None else v


def centroid(geom: Column | str) -> Column:
    """area-weighted centroid struct(x, y); holes subtract."""
    def ring_terms(ring, i):
        a = ring_signed_area(ring)
        # weighted moments: sum((x1+x2)*cross)/6 equals signed_area * centroid
        mx = F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] + e["x2"]) * (
            e["x1"] * e["y2"] - e["x2"] * e["y1"])) / F.lit(6.0)
        my = F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["y1"] + e["y2"]) * (
            e["x1"] * e["y2"] - e["x2"] * e["y1"])) / F.lit(6.0)
        # normalise orientation: shells count positive, holes negative
        sign = F.when(i == 0, F.signum(a)).otherwise(-F.signum(a))
        return F.struct((F.abs(a) * F.when(i == 0, 1.0).otherwise(-1.0)).alias("a"),
                        (mx * sign).alias("mx"), (my * sign).alias("my"))

    terms = F.flatten(F.transform(_c(geom), lambda part: F.transform(part, ring_terms)))
    tot = F.aggregate(terms, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
                      lambda acc, t: F.struct((acc["a"] + t["a"]).alias("a"), (acc["mx"] + t["mx"]).alias("mx"),
                                              (acc["my"] + t["my"]).alias("my")))
    return F.struct(F.try_divide(tot["mx"], tot["a"]).alias("x"), F.try_divide(tot["my"], tot["a"]).alias("y"))


def point_in_edges(edge_list: Column, x: Column, y: Column) -> Column:
    """contains(polygon, point) with the boundary excluded (as ST_Contains).

    Even-odd ray casting toward +x over all edges, AND the point is on no edge.
    """
    crossings = F.aggregate(edge_list, F.lit(0), lambda acc, e: acc + F.when(
        ((e["y1"] > y) != (e["y2"] > y))
        & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0))
    return ((crossings % 2) == 1) & ~on_boundary(edge_list, x, y)


def on_boundary(edge_list: Column, x: Column, y: Column) -> Column:
    """True when (x, y) lies on one of the edges (collinear and inside the edge's box)."""
    return F.exists(edge_list, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) == 0)
        & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))))


def contains(geom: Column | str, x: Column | str, y: Column | str) -> Column:
    """contains(polygon, point) directly on a geometry column (simple mode)."""
    return point_in_edges(edges(geom), _c(x), _c(y))


def _fmt(v: Column) -> Column:
    return v.cast("string")


def to_wkt(geom: Column | str) -> Column:
    """MULTIPOLYGON WKT text."""
    ring_txt = lambda ring: F.concat(F.lit("("), F.array_join(
        F.transform(ring, lambda p: F.concat(_fmt(p["x"]), F.lit(" "), _fmt(p["y"]))), ", "), F.lit(")"))
    part_txt = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring_txt), ", "), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(_c(geom), part_txt), ", "), F.lit(")"))


def to_geojson(geom: Column | str) -> Column:
    """GeoJSON geometry text {"type":"MultiPolygon","coordinates":[...]}."""
    coords = F.transform(_c(geom), lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))


def _coords_to_geom(nested: Column) -> Column:
    """array<array<array<array<double>>>> -> geometry structs."""
    return F.transform(nested, lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def from_geojson_coordinates(geom_type: Column | str, coordinates_json: Column | str) -> Column:
    """Polygon / MultiPolygon coordinate text -> multipolygon (Polygon promoted); other types -> null."""
    t, c = _c(geom_type), _c(coordinates_json)
    multi = F.from_json(c, "array<array<array<array<double>>>>")
    single = F.from_json(c, "array<array<array<double>>>")
    return (F.when(t == "MultiPolygon", _coords_to_geom(multi))
            .when(t == "Polygon", _coords_to_geom(F.array(single)))
            .otherwise(F.lit(None).cast(S.MULTIPOLYGON)))


def from_wkt(wkt: Column | str) -> Column:
    """POLYGON / MULTIPOLYGON WKT (optionally with SRID=...;) -> multipolygon.

    Rewrites the text to JSON arrays with regexes and parses with ``from_json``.
    """
    w = F.upper(F.trim(F.regexp_replace(_c(wkt), r"^SRID=\d+;", "")))
    body = F.regexp_replace(w, r"^(MULTIPOLYGON|POLYGON)\s*", "")
    js = F.regexp_replace(body, r"\(", "[")
    js = F.regexp_replace(js, r"\)", "]")
    # "x y" pairs -> [x,y]
    js = F.regexp_replace(js, r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)", "[$1,$2]")
    js = F.regexp_replace(js, r"\s+", "")
    kind = F.when(w.startswith("MULTIPOLYGON"), F.lit("MultiPolygon")).when(
        w.startswith("POLYGON"), F.lit("Polygon"))
    return from_geojson_coordinates(kind, js)


def close_rings(geom: Column | str) -> Column:
    """F23 (partial repair): drop consecutive repeated vertices and close open rings."""
    def fix(ring):
        dedup = F.filter(ring, lambda p, i: (i == 0) | ~((p["x"] == ring[i - 1]["x"]) & (p["y"] == ring[i - 1]["y"])))
        first, last = dedup[0], F.element_at(dedup, -1)
        return F.when((F.size(dedup) > 0) & ~((first["x"] == last["x"]) & (first["y"] == last["y"])),
                      F.concat(dedup, F.array(first))).otherwise(dedup)
    return F.transform(_c(geom), lambda part: F.filter(F.transform(part, fix), lambda r: F.size(r) >= 4))


def validity_issues(geom: Column | str) -> Column:
    """F23 (flagging): reasons a geometry cannot be used as is (empty array = usable)."""
    g = _c(geom)
    rings = F.flatten(g)
    return F.array_compact(F.array(
        F.when(g.isNull() | (F.size(g) == 0), F.lit("empty")),
        F.when(F.exists(rings, lambda r: F.size(r) < 4), F.lit("ring_too_short")),
        F.when(F.exists(rings, lambda r: ~((r[0]["x"] == F.element_at(r, -1)["x"])
                                          & (r[0]["y"] == F.element_at(r, -1)["y"]))), F.lit("ring_not_closed")),
        F.when(F.exists(rings, lambda r: ring_signed_area(r) == 0), F.lit("zero_area_ring")),
    ))
