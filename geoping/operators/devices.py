"""Device-level aggregates.

A08 is the older job's device-per-day summary; it runs on raw values (no
null filling), so averages ignore nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean
from ..session import ensure_checkpoint_dir


def device_day_summary(clean: DataFrame, ordered: bool = True) -> DataFrame:
    """Per (device_id, device_name, date): points_count, avg_speed, max_speed, avg_battery; date desc."""
    out = (clean.groupBy("device_id", "device_name", F.to_date("timestamp").alias("date"))
           .agg(F.count(F.lit(1)).alias("points_count"), exact_mean("speed").alias("avg_speed"),
                F.max("speed").alias("max_speed"), exact_mean("battery").alias("avg_battery")))
    return out.orderBy(F.desc("date"), "device_id", "device_name") if ordered else out


def latest_device_days(summary: DataFrame, limit: int = 100) -> DataFrame:
    """The latest ``limit`` device-day rows (date desc, then device) -- TakeOrderedAndProject."""
    return summary.orderBy(F.desc_nulls_last("date"), "device_id", "device_name").limit(limit)


def device_extents(locations: DataFrame) -> DataFrame:
    """first_seen / last_seen per (device_id, device_name)."""
    return (locations.groupBy("device_id", "device_name")
            .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")))


def device_stats(locations: DataFrame, coord_digits: int = 3) -> DataFrame:
    """Per device latest name, records, first/last seen, averages, most common (rounded) position, label maps.

    Two scans: one pre-aggregate per (device, network, operator) -- a few rows per
    device, checkpointed -- feeds the totals and both label maps;
    the most common position is a second two-level aggregate with ties broken by
    the smaller latitude, then longitude.
    """
    level = (locations.groupBy("device_id", "network_type", "sim_operator")
             .agg(F.count(F.lit(1)).alias("__n"), F.min("timestamp").alias("__first"),
                  F.max("timestamp").alias("__last"), F.max(F.struct("timestamp", "device_name")).alias("__latest"),
                  *[F.sum(F.col(c).cast("decimal(18,6)")).alias(f"__s_{c}") for c in ("battery", "signal", "speed")],
                  *[F.count(c).alias(f"__c_{c}") for c in ("battery", "signal", "speed")]))
    # aggregated (a few rows per device) and read three times: materialise once so the raw scan runs once
    ensure_checkpoint_dir(locations.sparkSession)
    level = level.checkpoint(eager=True)
    base = (level.groupBy("device_id")
            .agg(F.max("__latest")["device_name"].alias("device_name"),
                 F.sum("__n").alias("total_records"), F.min("__first").alias("first_seen"),
                 F.max("__last").alias("last_seen"),
                 *[F.try_divide(F.sum(f"__s_{c}").cast("double"), F.sum(f"__c_{c}").cast("double")).alias(f"avg_{c}")
                   for c in ("battery", "signal", "speed")]))

    def label_map(col, out):
        return (level.groupBy("device_id", col).agg(F.sum("__n").alias("__v"))
                .groupBy("device_id")
                .agg(F.map_from_entries(F.sort_array(F.collect_list(
                    F.struct(F.coalesce(F.col(col), F.lit("NULL")).alias("k"), F.col("__v").alias("v"))))).alias(out)))

    pos = (locations.select("device_id", F.round("latitude", coord_digits).alias("lat_r"),
                            F.round("longitude", coord_digits).alias("lon_r"))
           .groupBy("device_id", "lat_r", "lon_r").agg(F.count(F.lit(1)).alias("__n"))
           .groupBy("device_id")
           .agg(F.max_by(F.struct("lat_r", "lon_r"),
                         F.struct(F.col("__n"), -F.col("lat_r"), -F.col("lon_r"))).alias("__mode")))
    pos = pos.select("device_id", F.col("__mode.lat_r").alias("most_common_lat"),
                     F.col("__mode.lon_r").alias("most_common_lon"))
    return (base.join(pos, "device_id", "left")
            .join(label_map("network_type", "network_distribution"), "device_id", "left")
            .join(label_map("sim_operator", "operator_distribution"), "device_id", "left"))


def map_as_text(m: Column | str) -> Column:
    """'k1:v1,k2:v2' (keys sorted) -- a scalar rendering of a count map for reports and checks."""
    c = F.col(m) if isinstance(m, str) else m
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
