"""Polygon sources: vertex tables, GeoJSON FeatureCollections, WKT tables, lookups.

S07-S11, F18-F20. Polygon tables are dimension-sized (one row per district),
so per-polygon ``collect_list`` of its own vertices is bounded by the polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators.dimensions import dense_keys

FEATURE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        # kept as raw JSON text; parsed by geometry type afterwards
        T.StructField("coordinates", T.StringType()),
    ])),
])
#: A FeatureCollection document, or a single Feature.
GEOJSON_SCHEMA = T.StructType([*FEATURE_SCHEMA.fields, T.StructField("features", T.ArrayType(FEATURE_SCHEMA))])

# Property aliases tried in order (first non-blank wins).
DISTRICT_NUMBER_ALIASES = ["DISTRITO", "distrito", "district", "Distrito", "DISTRICT_N", "id"]
DISTRICT_NAME_ALIASES = ["NOMBRE", "nombre", "name", "Nombre", "NAME"]
PROVINCE_NAME_ALIASES = ["provincia", "PROVINCIA", "nombre", "NOMBRE", "name"]
MUNICIPALITY_ALIASES = ["municipio", "MUNICIPIO", "municipality"]
DEPARTMENT_ALIASES = ["departamen", "DEPARTAMEN", "departamento"]
DEFAULT_DEPARTMENT = "Santa Cruz"


def polygons_from_vertices(vertices: DataFrame, attrs: list[str] | None = None,
                           id_col: str = "polygon_id") -> DataFrame:
    """Vertex rows (id, part, ring, seq, x, y, attrs...) -> one row per polygon with ``geom``.

    One aggregation per polygon (its own vertices, sorted by part, ring, seq);
    parts and rings are then cut out of the sorted list with higher-order functions.
    """
    attrs = attrs or []
    v = (vertices.groupBy(id_col)
         .agg(F.sort_array(F.collect_list(F.struct("part", "ring", "seq", "x", "y"))).alias("v"),
              *[F.first(a).alias(a) for a in attrs]))
    vs = F.col("v")
    geom = F.transform(
        F.array_distinct(F.transform(vs, lambda p: p["part"])),
        lambda part: F.transform(
            F.array_distinct(F.transform(F.filter(vs, lambda p: p["part"] == part), lambda p: p["ring"])),
            lambda ring: F.transform(F.filter(vs, lambda p: (p["part"] == part) & (p["ring"] == ring)),
                                     lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return v.select(id_col, *attrs, geom.alias("geom"))


def _first_present(props: Column, aliases: list[str], skip_zero: bool = False) -> Column:
    """coalesce of property aliases; '' (and '0' when ``skip_zero``) fall through like Python ``or``."""
    vals = []
    for a in aliases:
        v = F.nullif(F.trim(props[a]), F.lit(""))
        if skip_zero:
            v = F.nullif(v, F.lit("0"))
        vals.append(v)
    return F.coalesce(*vals)


def first_int(text: Column) -> Column:
    """first run of digits in a text as int ('Distrito 7' -> 7, '001' -> 1); null when none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection file(s) -> one row per feature with position, properties, geometry.

    Rejects documents other than FeatureCollections and Features, and features without
    geometry or of types other than Polygon/MultiPolygon (F20).
    """
    doc = spark.read.option("multiLine", True).schema(GEOJSON_SCHEMA).json(path)
    return features_to_polygons(doc.select("*", F.col("_metadata.file_path").alias("source")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """S08 for large polygon sets: one Feature (as ``geojson_features`` writes) or FeatureCollection per line.

    Unlike a single multi-line document (read by one task), line-delimited files
    split across tasks like any text input.
    """
    lines = spark.read.text(path)
    return geojson_text_features(spark, lines.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file")))


def geojson_text_features(spark: SparkSession, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """FeatureCollection or Feature documents held in a string column -> feature rows."""
    source = F.concat_ws("|", F.col("file") if "file" in texts.columns else F.lit(""), F.md5(F.col(text_col)))
    doc = texts.select(F.from_json(F.col(text_col), GEOJSON_SCHEMA).alias("d"), source.alias("source")).select("d.*", "source")
    return features_to_polygons(doc)


def features_to_polygons(doc: DataFrame) -> DataFrame:
    """Features numbered from 0 over all documents (``pos``, in the order of document and position), rings closed."""
    own = F.array(F.struct("type", "properties", "geometry"))
    feats = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type") == "Feature", own)
    feats = doc.select("source", F.posexplode(feats).alias("at", "f"))
    feats = dense_keys(feats, ["source", "at"], key="n").withColumn("pos", (F.col("n") - 1).cast("int"))
    feats = feats.filter(F.col("f.geometry").isNotNull())
    out = feats.select(
        "pos",
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geom_type"),
        G.close_rings(G.from_geojson_coordinates(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("geom"))
    return out.filter(F.col("geom").isNotNull())


def district_attributes(features: DataFrame) -> DataFrame:
    """F18/F19 for district files: number from aliases (digits, fallback position + 1), name."""
    p = F.col("properties")
    number_text = _first_present(p, DISTRICT_NUMBER_ALIASES, skip_zero=True)
    number = F.coalesce(first_int(number_text), F.col("pos") + 1)
    name = F.coalesce(_first_present(p, DISTRICT_NAME_ALIASES),
                      F.concat(F.lit("Distrito "), number.cast("string")))
    return features.select(number.cast("int").alias("district_number"), name.alias("district_name"),
                           "geom", "pos")


def province_attributes(features: DataFrame) -> DataFrame:
    """F19 for province files: name, municipality, department."""
    p = F.col("properties")
    return features.select(
        (F.col("pos") + 1).cast("long").alias("province_id"),
        F.coalesce(_first_present(p, PROVINCE_NAME_ALIASES),
                   F.concat(F.lit("Provincia "), (F.col("pos") + 1).cast("string"))).alias("province_name"),
        _first_present(p, MUNICIPALITY_ALIASES).alias("municipality"),
        F.coalesce(_first_present(p, DEPARTMENT_ALIASES), F.lit(DEFAULT_DEPARTMENT)).alias("department"),
        "geom")


def read_wkt_polygons(df: DataFrame, wkt_col: str = "geom_wkt") -> DataFrame:
    """A table with WKT text (e.g. a JDBC read) -> geometry column."""
    return df.withColumn("geom", G.close_rings(G.from_wkt(F.col(wkt_col))))


def with_measures(polys: DataFrame) -> DataFrame:
    """F21, F22, F28, F29 and F23 flags on a polygon table."""
    return polys.select(
        "*",
        G.area_deg2("geom").alias("area_deg2"),
        G.area_km2("geom").alias("area_km2"),
        G.perimeter_km("geom").alias("perimeter_km"),
        G.centroid("geom").alias("centroid"),
        G.validity_issues("geom").alias("issues"))


def ordered(polys: DataFrame, key: str) -> DataFrame:
    """All polygons ordered by their number / id."""
    return polys.orderBy(key)


def lookup(polys: DataFrame, key: str, value) -> DataFrame:
    """One polygon by key (at most one row)."""
    return polys.filter(F.col(key) == F.lit(value)).orderBy(key).limit(1)
