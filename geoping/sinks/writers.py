"""Sinks (K01-K11): parquet tables with counts from ``observe``, partition replacement, GeoJSON out.

No ``toPandas`` and no row loops on the driver: every write is a distributed
Spark write. Counts come from ``DataFrame.observe`` during the write itself,
so no second scan is needed. Replacing dates is dynamic partition overwrite.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def table_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None,
                fmt: str = "parquet", options: dict[str, str] | None = None) -> int:
    """Write and return the number of rows written (observed during the write)."""
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).format(fmt).options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(obs.get.get("rows", 0))


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> int:
    """Replace exactly the partitions present in ``df`` (dynamic overwrite); others stay."""
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))
    return int(obs.get.get("rows", 0))


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> None:
    """Create an empty table with the given schema when the path does not exist.

    A partitioned empty table has no data file to infer from: read it with the
    same ``StructType`` (``spark.read.schema(schema).parquet(path)``).
    """
    if _exists(spark, path):
        return
    w = spark.createDataFrame([], schema).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_evolving(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table whose files gained columns over time (``mergeSchema``); add missing contract columns."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if schema is not None:
        for f in schema.fields:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def align_to(df: DataFrame, target_columns: list[str], types: dict | None = None) -> DataFrame:
    """Add missing columns as typed nulls and order like the target (unionByName-compatible)."""
    types = types or {}
    out = df
    for c in target_columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return out.select(*target_columns)


def geojson_features(polys: DataFrame, props: list[str]) -> DataFrame:
    """One GeoJSON Feature text per polygon (JSON lines; scales with the polygon table)."""
    return polys.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
        F.from_json(G.to_geojson("geom"), "type string, coordinates array<array<array<array<double>>>>")
        .alias("geometry"))).alias("feature"))


def feature_collection(features: DataFrame, max_features: int) -> DataFrame:
    """A single FeatureCollection document, for polygon tables of at most the caller's ``max_features`` rows."""
    n = features.count()
    if n > max_features:
        raise ValueError(f"{n} features: write JSON lines with geojson_features instead")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                                 F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("geojson"))
