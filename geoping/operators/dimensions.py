"""Star schema: dimensions, surrogate keys and the location fact.

Label dimensions (time, altitude, battery) are fixed rows from the label
constants; data dimensions (network, operator, device) are distinct values of
the location table with dense surrogate keys. Facts join dimensions on their
natural keys; a dimension is broadcast only after its row count is measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import classify as C
from ..session import ensure_checkpoint_dir

BROADCAST_MAX_DIM_ROWS = 1_000_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_keys(df: DataFrame, order_cols: list, key: str = "id", partitions: int | None = None) -> DataFrame:
    """Surrogate keys 1..n in the order of ``order_cols``.

    Rows are never gathered in one task: a range partitioning by the order (as many
    ranges as the session shuffles to, unless given), a ``row_number`` inside each range, and
    each range's offset (prefix sum of the range counts; one number per range reaches
    the driver) added through a broadcast join.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(partitions or shuffle_partitions(spark), *order_cols).withColumn("__pid", F.spark_partition_id())
              .checkpoint(eager=True))                       # fixes the partition of every row
    counts = sorted((r["__pid"], int(r["n"])) for r in
                    ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid, n in counts:
        offsets.append((pid, run))
        run += n
    off = spark.createDataFrame(offsets, "__pid int, __off long")
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(*order_cols))
    return (ranged.withColumn("__rn", local).join(F.broadcast(off), "__pid")
            .withColumn(key, (F.col("__off") + F.col("__rn")).cast("long")).drop("__pid", "__rn", "__off"))


def dim_time(spark: SparkSession) -> DataFrame:
    """24 hours -> id (= hour), hour, period, period code."""
    return (spark.range(24).select(F.col("id").cast("int").alias("id"), F.col("id").cast("int").alias("hour"))
            .withColumn("period", C.period_from_hour("hour"))
            .withColumn("period_code", C.period_code("period")))


def dim_altitude(spark: SparkSession) -> DataFrame:
    """The three altitude ranges with bounds."""
    rows = [(i + 1, label, lo, hi) for i, (label, lo, hi) in enumerate(S.ALTITUDE_DIM)]
    return spark.createDataFrame(rows, "id int, altitude_range string, min_altitude double, max_altitude double")


def dim_battery(spark: SparkSession) -> DataFrame:
    """The four battery levels with bounds."""
    rows = [(i + 1, label, lo, hi) for i, (label, lo, hi) in enumerate(S.BATTERY_DIM)]
    return spark.createDataFrame(rows, "id int, battery_level string, min_battery double, max_battery double")


def dimension_source(locations: DataFrame) -> DataFrame:
    """One pre-aggregate per (device, raw network, generation, operator) that every data dimension reads.

    A few rows per device: the three data dimensions then cost one scan of the
    location table instead of three.
    """
    return (locations.groupBy("device_id", "network_type_raw", "network_generation", "sim_operator")
            .agg(F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("last_ts"),
                 F.max_by("device_name", F.struct("timestamp", "device_name")).alias("device_name"),
                 F.max(F.struct("timestamp", "device_name")).alias("__latest")))


def dim_network(locations: DataFrame) -> DataFrame:
    """Distinct raw network texts with their generation label and number; keys in first-seen order."""
    first = (locations.groupBy(F.col("network_type_raw").alias("network_type"))
             .agg(F.min_by("network_generation", "timestamp").alias("network_generation"),
                  F.min("timestamp").alias("__first")))
    first = first.withColumn("generation", F.nullif(F.regexp_extract("network_generation", r"([2-5])G", 1),
                                                    F.lit("")).try_cast("int"))
    return dense_keys(first, [F.col("__first"), F.asc_nulls_first("network_type")]).drop("__first")


def dim_operator(locations: DataFrame) -> DataFrame:
    """Distinct normalised operators by name with a 3-letter code."""
    ops = locations.select(F.col("sim_operator").alias("operator_name")).distinct()
    ops = ops.withColumn("operator_code", F.upper(F.substring("operator_name", 1, 3)))
    return dense_keys(ops, ["operator_name"])


def dim_device(locations: DataFrame) -> DataFrame:
    """One row per device: latest name (``max_by`` on time), first and last seen."""
    if "__latest" in locations.columns:      # a dimension_source pre-aggregate
        dev = (locations.groupBy("device_id")
               .agg(F.max("__latest").alias("__l"), F.min("timestamp").alias("first_seen"),
                    F.max("last_ts").alias("last_seen"))
               .select("device_id", F.col("__l.device_name").alias("device_name"), "first_seen", "last_seen"))
    else:
        dev = (locations.groupBy("device_id")
               .agg(F.max_by("device_name", F.struct("timestamp", "device_name")).alias("device_name"),
                    F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")))
    return dense_keys(dev, ["device_id"])


def all_dimensions(spark: SparkSession, locations: DataFrame) -> dict[str, DataFrame]:
    """Every dimension frame by name; the data dimensions share one pre-aggregate (one scan)."""
    ensure_checkpoint_dir(spark)
    src = dimension_source(locations).checkpoint(eager=True)
    return {"dim_time": dim_time(spark), "dim_altitude": dim_altitude(spark), "dim_battery": dim_battery(spark),
            "dim_network": dim_network(src), "dim_operator": dim_operator(src), "dim_device": dim_device(src)}


def missing_members(new_dim: DataFrame, existing: DataFrame, natural_key: str) -> DataFrame:
    """Members of a freshly built dimension not yet stored (load-if-missing)."""
    return new_dim.join(existing.select(natural_key), natural_key, "left_anti")


def _dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a dimension; broadcast when its row count is known to be small.

    Fixed label dimensions pass their row count, networks and operators their measured
    one (few values, so a shuffle on them would be skewed). Devices pass none: AQE
    measures the materialised side at runtime and converts the join to a broadcast only
    when it is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    side = F.broadcast(dim) if rows is not None and rows <= BROADCAST_MAX_DIM_ROWS else dim
    return fact.join(side, on, how)


def fact_locations(spark: SparkSession, locations: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """The location fact with the six foreign keys, measures and the point.

    Each dimension joins on its natural key (LEFT, so no fact row is lost).
    """
    dims = dims or all_dimensions(spark, locations)
    f = locations.withColumn("__hour", F.hour("timestamp"))
    f = _dim_join(f, dims["dim_time"].select(F.col("hour").alias("__hour"), F.col("id").alias("time_id")), "__hour",
                  rows=24)
    f = _dim_join(f, dims["dim_altitude"].select("altitude_range", F.col("id").alias("altitude_id")),
                  "altitude_range", rows=len(S.ALTITUDE_DIM))
    f = _dim_join(f, dims["dim_battery"].select("battery_level", F.col("id").alias("battery_id")), "battery_level",
                  rows=len(S.BATTERY_DIM))
    nets = dims["dim_network"].select(F.col("network_type").alias("__net"), F.col("id").alias("network_id"))
    f = _dim_join(f, nets, f["network_type_raw"].eqNullSafe(nets["__net"]), rows=nets.count()).drop("__net")
    ops = dims["dim_operator"].select(F.col("operator_name").alias("sim_operator"), F.col("id").alias("operator_id"))
    f = _dim_join(f, ops, "sim_operator", rows=ops.count())
    f = _dim_join(f, dims["dim_device"].select("device_id", F.col("id").alias("device_key")), "device_id")
    return f.select(F.col("id").alias("location_id"), "time_id", "altitude_id", "battery_id", "network_id",
                    "operator_id", "device_key", "date", "latitude", "longitude", "altitude", "speed", "battery",
                    "signal", "location_geom")


def date_hour_report(spark: SparkSession, locations: DataFrame) -> DataFrame:
    """Locations joined to dim_time on the hour, grouped by (date, hour, period)."""
    t = dim_time(spark).select(F.col("id").alias("time_id"), F.col("hour").alias("hour_value"),
                               F.col("period").alias("time_period"))
    f = locations.select(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("time_id"))
    return (_dim_join(f, t, "time_id", "inner", rows=24)
            .groupBy("date", "hour_value", "time_period").agg(F.count(F.lit(1)).alias("records")))
