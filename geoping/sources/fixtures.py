"""Adapter: driver tables -> raw pings and polygon vertices.

The driver's tables carry no coordinates, so the test inputs (pings, district
and province polygons) are derived from ``events``, ``nation`` and ``region``.
This module only produces rows in the schemas the jobs expect; it does none of
the jobs' work. The SQL text is shared verbatim by the Spark side (DataFrame
parameters ``{events}``, ``{nation}``, ``{region}``) and the DuckDB oracle
(plain table names), so both engines see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_PINGS_SQL = """
SELECT
  event_id AS id,
  'dev-' || CAST(user_id AS STRING) AS device_id,
  'Device ' || CAST(user_id AS STRING) AS device_name,
  CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN event_id % 89 = 0 THEN CAST(95 AS DOUBLE)
       ELSE CAST(-18.30 AS DOUBLE) + CAST((event_id * 7919) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 83 = 0 THEN CAST(-200 AS DOUBLE)
       ELSE CAST(-63.70 AS DOUBLE) + CAST((event_id * 104729) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS longitude,
  CASE WHEN event_id % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(300 + event_id % 300 AS DOUBLE) END AS altitude,
  CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE)
       ELSE value / CAST(10 AS DOUBLE) END AS speed,
  CASE WHEN event_id % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS battery,
  CASE WHEN event_id % 29 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(-50 - (event_id * 13) % 60 AS DOUBLE) END AS signal,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'WiFi' WHEN 3 THEN 'wi-fi' WHEN 4 THEN '5G NR'
       WHEN 5 THEN 'LTE' WHEN 6 THEN 'MOBILE' WHEN 7 THEN 'Mobile Broadband Net' WHEN 8 THEN 'HSPA+'
       WHEN 9 THEN 'EDGE' ELSE 'satellite' END AS network_type,
  CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'SIN SEÑAL'
       WHEN 4 THEN 'Sin Señal 4' WHEN 5 THEN 'ENTEL S.A.' WHEN 6 THEN 'BOMOV' WHEN 7 THEN '+18vacunate'
       WHEN 8 THEN 'tigo' WHEN 9 THEN 'VIVA BO' WHEN 10 THEN 'NA' WHEN 11 THEN ' ' ELSE 'Claro' END AS sim_operator,
  ts AS timestamp
FROM {events}
"""

DISTRICT_VERTICES_SQL = """
WITH o AS (
  SELECT n_nationkey AS district_id, n_nationkey + 1 AS district_number, n_name AS district_name,
    CAST(-63.65005 AS DOUBLE) + CAST(0.18 AS DOUBLE) * CAST(n_nationkey % 5 AS DOUBLE) AS x0,
    CAST(-18.25005 AS DOUBLE) + CAST(0.18 AS DOUBLE) * CAST((n_nationkey - n_nationkey % 5) / 5 AS DOUBLE) AS y0
  FROM {nation}),
v AS (
  SELECT * FROM (VALUES
    (0, 0, 0, 0.0, 0.0), (0, 0, 1, 0.17, 0.0), (0, 0, 2, 0.17, 0.17), (0, 0, 3, 0.085, 0.10), (0, 0, 4, 0.0, 0.17), (0, 0, 5, 0.0, 0.0),
    (0, 1, 0, 0.02, 0.02), (0, 1, 1, 0.02, 0.05), (0, 1, 2, 0.05, 0.05), (0, 1, 3, 0.05, 0.02), (0, 1, 4, 0.02, 0.02),
    (1, 0, 0, 0.07, 0.13), (1, 0, 1, 0.10, 0.13), (1, 0, 2, 0.10, 0.16), (1, 0, 3, 0.07, 0.16), (1, 0, 4, 0.07, 0.13)
  ) AS t(part, ring, seq, dx, dy))
SELECT district_id, district_number, district_name, part, ring, seq,
  x0 + CAST(dx AS DOUBLE) AS x, y0 + CAST(dy AS DOUBLE) AS y
FROM o CROSS JOIN v
WHERE (ring = 0 AND part = 0) OR (ring = 1 AND district_id % 5 = 0) OR (part = 1 AND district_id % 7 = 3)
"""

PROVINCE_VERTICES_SQL = """
SELECT r_regionkey AS province_id, r_name AS province_name, 0 AS part, 0 AS ring, seq,
  CAST(-63.66005 AS DOUBLE) + CAST(0.2 AS DOUBLE) * CAST(r_regionkey AS DOUBLE) + CAST(dx AS DOUBLE) AS x,
  CAST(-18.28005 AS DOUBLE) + CAST(dy AS DOUBLE) AS y
FROM {region} CROSS JOIN (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 0.19, 0.0), (2, 0.19, 0.88), (3, 0.0, 0.88), (4, 0.0, 0.0)) AS t(seq, dx, dy)) v
"""


POI_SQL = """
SELECT s_suppkey AS poi_id, s_name AS name,
  CAST(-18.30 AS DOUBLE) + CAST((s_suppkey * 7919) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS latitude,
  CAST(-63.70 AS DOUBLE) + CAST((s_suppkey * 104729) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude
FROM {supplier}
"""


PARCEL_VERTICES_SQL = """
WITH o AS (
  SELECT s_suppkey AS parcel_id, s_name AS parcel_name,
    CAST(-63.70005 AS DOUBLE) + CAST((s_suppkey * 104729) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS x0,
    CAST(-18.30005 AS DOUBLE) + CAST((s_suppkey * 7919) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS y0
  FROM {supplier}),
v AS (
  SELECT * FROM (VALUES
    (0, 0, 0, 0.0, 0.0), (0, 0, 1, 0.17, 0.0), (0, 0, 2, 0.17, 0.17), (0, 0, 3, 0.085, 0.10), (0, 0, 4, 0.0, 0.17), (0, 0, 5, 0.0, 0.0),
    (0, 1, 0, 0.02, 0.02), (0, 1, 1, 0.02, 0.05), (0, 1, 2, 0.05, 0.05), (0, 1, 3, 0.05, 0.02), (0, 1, 4, 0.02, 0.02),
    (1, 0, 0, 0.07, 0.13), (1, 0, 1, 0.10, 0.13), (1, 0, 2, 0.10, 0.16), (1, 0, 3, 0.07, 0.16), (1, 0, 4, 0.07, 0.13)
  ) AS t(part, ring, seq, dx, dy))
SELECT parcel_id, parcel_name, part, ring, seq,
  x0 + CAST(dx AS DOUBLE) * CAST(0.1 AS DOUBLE) AS x, y0 + CAST(dy AS DOUBLE) * CAST(0.1 AS DOUBLE) AS y
FROM o CROSS JOIN v
WHERE (ring = 0 AND part = 0) OR (ring = 1 AND parcel_id % 5 = 0) OR (part = 1 AND parcel_id % 7 = 3)
"""


def oracle_ctes() -> str:
    """The adapter as DuckDB CTE text (``WITH`` clause body, no trailing comma)."""
    return (
        "raw_pings AS (" + RAW_PINGS_SQL.format(events="events") + "),\n"
        "district_vertices AS (" + DISTRICT_VERTICES_SQL.format(nation="nation") + "),\n"
        "province_vertices AS (" + PROVINCE_VERTICES_SQL.format(region="region") + "),\n"
        "points_of_interest AS (" + POI_SQL.format(supplier="supplier") + "),\n"
        "parcel_vertices AS (" + PARCEL_VERTICES_SQL.format(supplier="supplier") + ")"
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed raw pings (id, device, coordinates, measures, texts, timestamp) from ``events``."""
    events = _table(spark, sf_dir, "events")
    return spark.sql(RAW_PINGS_SQL, events=events)


def points_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named points (poi_id, name, latitude, longitude) from ``supplier`` on the ping lattice."""
    return spark.sql(POI_SQL, supplier=_table(spark, sf_dir, "supplier"))


# Vertex templates (part, ring, seq, dx, dy) of the SQL above, used by the
# Spark side as a literal array exploded per nation / region row (no join).
DISTRICT_TEMPLATE = [
    (0, 0, 0, 0.0, 0.0), (0, 0, 1, 0.17, 0.0), (0, 0, 2, 0.17, 0.17), (0, 0, 3, 0.085, 0.10), (0, 0, 4, 0.0, 0.17),
    (0, 0, 5, 0.0, 0.0),
    (0, 1, 0, 0.02, 0.02), (0, 1, 1, 0.02, 0.05), (0, 1, 2, 0.05, 0.05), (0, 1, 3, 0.05, 0.02), (0, 1, 4, 0.02, 0.02),
    (1, 0, 0, 0.07, 0.13), (1, 0, 1, 0.10, 0.13), (1, 0, 2, 0.10, 0.16), (1, 0, 3, 0.07, 0.16), (1, 0, 4, 0.07, 0.13),
]
PROVINCE_TEMPLATE = [(0, 0.0, 0.0), (1, 0.19, 0.0), (2, 0.19, 0.88), (3, 0.0, 0.88), (4, 0.0, 0.0)]


def _template(rows, names) -> F.Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def district_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    o = _table(spark, sf_dir, "nation").select(
        n.alias("district_id"), (n + 1).alias("district_number"), F.col("n_name").alias("district_name"),
        (F.lit(-63.65005) + F.lit(0.18) * (n % 5).cast("double")).alias("x0"),
        (F.lit(-18.25005) + F.lit(0.18) * ((n - n % 5) / 5).cast("double")).alias("y0"))
    v = o.select("*", F.explode(_template(DISTRICT_TEMPLATE, ["part", "ring", "seq", "dx", "dy"])).alias("t"))
    keep = (((F.col("t.ring") == 0) & (F.col("t.part") == 0))
            | ((F.col("t.ring") == 1) & (F.col("district_id") % 5 == 0))
            | ((F.col("t.part") == 1) & (F.col("district_id") % 7 == 3)))
    return v.filter(keep).select(
        "district_id", "district_number", "district_name", F.col("t.part").alias("part"),
        F.col("t.ring").alias("ring"), F.col("t.seq").alias("seq"),
        (F.col("x0") + F.col("t.dx")).alias("x"), (F.col("y0") + F.col("t.dy")).alias("y"))


def province_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    v = _table(spark, sf_dir, "region").select(
        r.alias("province_id"), F.col("r_name").alias("province_name"),
        F.explode(_template(PROVINCE_TEMPLATE, ["seq", "dx", "dy"])).alias("t"))
    return v.select(
        "province_id", "province_name", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("t.seq").alias("seq"),
        (F.lit(-63.66005) + F.lit(0.2) * F.col("province_id").cast("double") + F.col("t.dx")).alias("x"),
        (F.lit(-18.28005) + F.col("t.dy")).alias("y"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District polygon table: district_id, district_number, district_name, geom."""
    from .polygons import polygons_from_vertices
    v = district_vertices(spark, sf_dir).withColumnRenamed("district_id", "polygon_id")
    polys = polygons_from_vertices(v, attrs=["district_number", "district_name"])
    return polys.withColumnRenamed("polygon_id", "district_id")


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province polygon table: province_id, province_name, geom."""
    from .polygons import polygons_from_vertices
    v = province_vertices(spark, sf_dir).withColumnRenamed("province_id", "polygon_id")
    polys = polygons_from_vertices(v, attrs=["province_name"])
    return polys.withColumnRenamed("polygon_id", "province_id")


def parcel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small polygon per ``supplier`` row (same shape rules as the districts, 1/10 the size)."""
    k = F.col("s_suppkey")
    o = _table(spark, sf_dir, "supplier").select(
        k.alias("parcel_id"), F.col("s_name").alias("parcel_name"),
        (F.lit(-63.70005) + ((k * 104729) % 10000).cast("double") / F.lit(10000.0)).alias("x0"),
        (F.lit(-18.30005) + ((k * 7919) % 10000).cast("double") / F.lit(10000.0)).alias("y0"))
    v = o.select("*", F.explode(_template(DISTRICT_TEMPLATE, ["part", "ring", "seq", "dx", "dy"])).alias("t"))
    keep = (((F.col("t.ring") == 0) & (F.col("t.part") == 0))
            | ((F.col("t.ring") == 1) & (F.col("parcel_id") % 5 == 0))
            | ((F.col("t.part") == 1) & (F.col("parcel_id") % 7 == 3)))
    return v.filter(keep).select(
        "parcel_id", "parcel_name", F.col("t.part").alias("part"), F.col("t.ring").alias("ring"),
        F.col("t.seq").alias("seq"),
        (F.col("x0") + F.col("t.dx") * F.lit(0.1)).alias("x"), (F.col("y0") + F.col("t.dy") * F.lit(0.1)).alias("y"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel polygon table (grows with ``supplier``): parcel_id, parcel_name, geom."""
    from .polygons import polygons_from_vertices
    v = parcel_vertices(spark, sf_dir).withColumnRenamed("parcel_id", "polygon_id")
    return polygons_from_vertices(v, attrs=["parcel_name"]).withColumnRenamed("polygon_id", "parcel_id")
