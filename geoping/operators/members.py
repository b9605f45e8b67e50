"""Stored dimensions that keep their keys (D06, D08): members by natural key, extents that widen, names that are versioned.

A load merges a batch into the newest stored version and writes the next one; readers take the newest complete
version, so a load that breaks off changes nothing. Members keep their key for good, new ones get the next numbers
above the largest stored, in the order of their natural key. What a member was called is kept per name with the time
it was first and last seen; the current name is the one seen last. Extents and names are minima and maxima, so any split of
the rows into loads gives the same members, and a batch loaded twice gives no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dimensions import dense_keys
from ..sinks import writers as W


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, rising (a folder counts once it has its success mark)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hpath)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("load=")]
    return sorted(n for n in numbers if W.table_exists(spark, f"{path}/load={n}/members/_SUCCESS") and W.table_exists(spark, f"{path}/load={n}/names/_SUCCESS"))


def read_members(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, natural key, first_seen, last_seen) of the newest version; None before the first load."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/load={done[-1]}/members") if done else None


def read_names(spark: SparkSession, path: str) -> DataFrame | None:
    """(natural key, name, first_seen, last_seen): every name a member was seen with."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/load={done[-1]}/names") if done else None


def _extents(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def load_members(spark: SparkSession, path: str, batch: DataFrame, key: str, name: str, time: str = "timestamp") -> int:
    """Merge a batch of rows (``key``, ``name``, ``time``) into the stored dimension; returns the number of new members.

    The batch is aggregated to its members before anything is shuffled with the stored ones; rows without a key are no member.
    """
    seen = batch.filter(F.col(key).isNotNull()).select(key, F.col(name).alias("name"), F.col(time).alias("first_seen"), F.col(time).alias("last_seen"))
    names = _extents(seen, [key, "name"])
    done = _versions(spark, path)
    if done:
        names = _extents(names.unionByName(spark.read.parquet(f"{path}/load={done[-1]}/names")), [key, "name"])
    names = names.checkpoint(eager=True)
    members = _extents(names, [key])
    if done:
        stored = spark.read.parquet(f"{path}/load={done[-1]}/members").select("id", key)
        most = stored.agg(F.max("id").alias("m")).collect()[0]["m"] or 0
        known = members.join(stored, key)
        new = members.join(stored.select(key), key, "left_anti")
    else:
        most, known, new = 0, None, members
    new = dense_keys(new, [key]).withColumn("id", F.col("id") + F.lit(most))
    columns = ["id", key, "first_seen", "last_seen"]
    all_ = new.select(*columns) if known is None else known.select(*columns).unionByName(new.select(*columns))
    target = f"{path}/load={(done[-1] if done else 0) + 1}"
    W.write_table(names, f"{target}/names", "overwrite")
    W.write_table(all_, f"{target}/members", "overwrite")     # last: its mark completes the version
    return new.count()


def current_members(spark: SparkSession, path: str, key: str, name: str) -> DataFrame | None:
    """(id, key, current name, first_seen, last_seen); of names last seen at the same time the greatest."""
    members, names = read_members(spark, path), read_names(spark, path)
    if members is None:
        return None
    latest = names.groupBy(key).agg(F.max(F.struct("last_seen", "name")).getField("name").alias(name))
    return members.join(latest, key).select("id", key, name, "first_seen", "last_seen")


def name_versions(spark: SparkSession, path: str, key: str, name: str) -> DataFrame | None:
    """The names of each member in the order they were first seen: valid_from, valid_to (null: still), current."""
    names = read_names(spark, path)
    if names is None:
        return None
    order = Window.partitionBy(key).orderBy("first_seen", "name")      # a member's own names
    nexts = F.lead("first_seen").over(order)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last_seen"), F.desc("name"))) == 1
    return names.select(key, F.col("name").alias(name), F.col("first_seen").alias("valid_from"), nexts.alias("valid_to"), last.alias("current"))
