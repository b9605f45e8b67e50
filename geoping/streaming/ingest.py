"""Structured Streaming ingest (ST01-ST06).

``readStream`` over a landing folder of ping files (fixed schema, no
inference), ``trigger(availableNow=True)`` for scheduled runs (the checkpoint
replaces the ledger's id mark), and ``foreachBatch`` for the idempotent,
partitioned writes of each micro-batch:

* ST02: one row per id; ids already stored are removed with a left anti join before appending;
* ST06: each micro-batch is geo-assigned with the stream-static spatial join;
* ST05: the per-(date, cell, device) grid state of the dates the batch touched is derived from the stored rows;
* ST04: device-day rows of the dates the batch touched are recomputed from the
  stored locations and replace those partitions (late rows handled);
* ST03: optional ``dropDuplicatesWithinWatermark`` on ``id`` inside the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import spatial as SP
from ..operators.transform import transform_locations
from ..plans.etl import EtlPaths, drop_stored_ids, drop_stored_keyless, fresh_positions, latest_per_id, on_dates, repeated_ids, touched, write_batch_outputs
from ..sinks import writers as W
from ..sources.pings import normalise_pings


def ping_stream(spark: SparkSession, landing: str, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                schema=None) -> DataFrame:
    """ST01: streaming source over a landing folder with a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema or _landing_schema(fmt))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalise_pings(reader.load(landing), with_errors=False)


def _landing_schema(fmt: str):
    from pyspark.sql import types as T
    if fmt == "json":
        return S.RAW_PING_SCHEMA
    fields = [f if f.name != "timestamp" else T.StructField("timestamp", T.TimestampNTZType()) for f in S.PING_SCHEMA]
    return T.StructType(fields)


def _event_time(stream: DataFrame) -> DataFrame:
    """Watermarks need an instant (TIMESTAMP); UTC wall-clock NTZ values are converted as UTC."""
    from pyspark.sql import types as T
    if isinstance(stream.schema["timestamp"].dataType, T.TimestampNTZType):
        # the cast reads the wall clock in the session zone; shift it so the wall clock is read as UTC
        tz = stream.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
        return stream.withColumn("timestamp", F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), tz))
    return stream


def dedupe_within_watermark(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST03: drop repeated ids that arrive within the watermark delay of each other."""
    return _event_time(stream).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def make_batch_writer(paths: EtlPaths, index: SP.SpatialIndex, districts: DataFrame, provinces: DataFrame,
                      grid_size: float = S.DEFAULT_GRID_SIZE):
    """ST02/ST04/ST05/ST06: the ``foreachBatch`` function."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # a replayed epoch finds its rows stored, and derives the same partitions from them again
        spark = batch.sparkSession
        span = touched(batch)
        if not span.dates:
            return
        new = latest_per_id(drop_stored_ids(spark, batch, paths.locations, span), repeated_ids(batch))
        located = SP.assign_locations(transform_locations(new, grid_size), districts, provinces, index=index)
        write_batch_outputs(spark, drop_stored_keyless(spark, located, paths.locations, span), paths, False, span.dates, grid_size)

    return write_batch


def run_available_now(spark: SparkSession, landing: str, paths: EtlPaths, checkpoint: str, districts: DataFrame,
                      provinces: DataFrame, fmt: str = "parquet", grid_size: float = S.DEFAULT_GRID_SIZE,
                      max_files_per_trigger: int | None = None) -> None:
    """ST01: process everything that landed since the last run, then stop (scheduled incremental run)."""
    index = SP.build_index([("district", districts, "district_id"), ("province", provinces, "province_id")],
                           grid_size)
    stream = ping_stream(spark, landing, fmt, max_files_per_trigger)
    q = (stream.writeStream.foreachBatch(make_batch_writer(paths, index, districts, provinces, grid_size))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def day_summary_stream(stream: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """ST04 (stream form): tumbling 1-day windows per device with a watermark (update or append mode; ``delay`` None: the stream has one)."""
    timed = stream if delay is None else _event_time(stream).withWatermark("timestamp", delay)
    return (timed
            .groupBy(F.window("timestamp", "1 day").alias("day"), "device_id", "device_name")
            .agg(F.count(F.lit(1)).alias("points_count"), F.max("speed").alias("max_speed"),
                 F.sum(F.col("speed").cast("decimal(18,6)")).alias("sum_speed"), F.count("speed").alias("cnt_speed"),
                 F.sum(F.col("battery").cast("decimal(18,6)")).alias("sum_battery"),
                 F.count("battery").alias("cnt_battery")))


def windows_as_days(windows: DataFrame) -> DataFrame:
    """Rows of ``day_summary_stream`` in the columns of the device-day summary."""
    return windows.select("device_id", "device_name", F.to_date("day.start").alias("date"), "points_count",
                          F.try_divide(F.col("sum_speed").cast("double"), F.col("cnt_speed").cast("double")).alias("avg_speed"), "max_speed",
                          F.try_divide(F.col("sum_battery").cast("double"), F.col("cnt_battery").cast("double")).alias("avg_battery"))


def run_day_streams(spark: SparkSession, landing: str, root: str, delay: str = "1 day", fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> None:
    """ST03/ST04: two streams over one landing folder, until all that has landed is processed.

    * positions: every micro-batch is stored, each id once, whatever its time (``fresh_positions``);
    * days: ids repeated within the watermark are dropped in the stream's state, day windows are summed in it, and a
      day's rows are written once, when the watermark has passed it. State is bounded by the devices and ids of ``delay``.

    Rows later than the watermark are in the positions alone: ``settle_days`` finds their dates.
    """
    def complete(stream: DataFrame) -> DataFrame:
        return stream.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())

    def store(batch: DataFrame, epoch_id: int) -> None:
        span = touched(batch)
        if span.dates:
            fresh = fresh_positions(batch.sparkSession, batch, f"{root}/positions", span)
            W.write_table(fresh.hint("rebalance", "date"), f"{root}/positions", "append", ["date"])

    source = complete(ping_stream(spark, landing, fmt, max_files_per_trigger))
    (source.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/_positions").trigger(availableNow=True).start().awaitTermination())
    days = windows_as_days(day_summary_stream(dedupe_within_watermark(complete(ping_stream(spark, landing, fmt, max_files_per_trigger)), delay), delay=None))
    (days.writeStream.outputMode("append").format("parquet").partitionBy("date").option("path", f"{root}/days")
     .option("checkpointLocation", f"{root}/_days").trigger(availableNow=True).start().awaitTermination())


def settle_days(spark: SparkSession, root: str) -> list:
    """Dates whose stored positions and streamed days differ in number (late rows, windows still open, no timestamp) go the
    batch way: their summary is made from the positions. Writes ``root/summary``; returns the dates made anew."""
    from ..operators.devices import device_day_summary

    positions = spark.read.parquet(f"{root}/positions")
    columns = "device_id string, device_name string, points_count bigint, avg_speed double, max_speed double, avg_battery double, date date"
    days = spark.read.schema(columns).parquet(f"{root}/days")
    have = days.groupBy("date").agg(F.sum("points_count").alias("n"))
    want = positions.groupBy("date").agg(F.count(F.lit(1)).alias("m"))
    both = want.join(have, want["date"].eqNullSafe(have["date"]), "left").select(want["date"], "n", "m")
    off = [r["date"] for r in both.filter(~F.col("n").eqNullSafe(F.col("m"))).collect()]   # a row per day
    settled = days if not off else days.join(F.broadcast(spark.createDataFrame([(d,) for d in off], "off date")), F.col("date").eqNullSafe(F.col("off")), "left_anti")
    made = device_day_summary(on_dates(positions, off), ordered=False) if off else days.limit(0)
    W.write_table(settled.unionByName(made), f"{root}/summary", "overwrite", ["date"])
    return off
