"""The ETL job (flagship lifecycle, §3.1): ingest -> clean/classify -> geo-assign -> write -> grid -> day summary -> ledger.

One lazy plan per step, no driver-side rows:

* the batch is the source above the ledger's high-water mark (S03/S12), minus the ids already
  stored, one row per id (the latest; ids are unique in the table, J12);
* rows cleaned, classified and geo-assigned (P01-P07, J01) are appended to the location table,
  partitioned and clustered by ``date`` (K01); what is stored already is left out before that work;
* everything else is derived from the *stored* rows of the dates that the batch (before
  the anti join) touches, and replaces those date partitions: the mergeable per-(date, cell,
  device) grid state (ST05) and the device-day summaries (K02). A rerun after a crash between
  two sinks, or a batch that comes twice, therefore ends in the same tables;
* the grid is merged from the state when it is read (``read_grid``); ``compact_grid`` writes it down;
* the ledger row is appended last; FAILED runs are recorded and do not move the mark (K06).

The touched dates are the only thing that reaches the driver (a row per day); as literals they prune
the partitions of every later read. Pings without a timestamp are a date of their own (null).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import devices as dev_ops
from ..operators import grid as grid_ops
from ..operators import spatial as SP
from ..operators.transform import transform_locations
from ..session import ensure_checkpoint_dir
from ..sinks import writers as W
from ..sources import id_index as ID
from ..sources import ledger as L
from ..sources.pings import incremental_scan, normalise_pings, only_new


@dataclass
class EtlPaths:
    root: str

    @property
    def locations(self) -> str:
        return f"{self.root}/locations"

    @property
    def grid_state(self) -> str:
        return f"{self.root}/grid_state"

    @property
    def grid(self) -> str:
        return f"{self.root}/grid"

    @property
    def device_days(self) -> str:
        return f"{self.root}/device_days"

    @property
    def id_index(self) -> str:
        return f"{self.root}/id_index"

    @property
    def ledger(self) -> str:
        return f"{self.root}/etl_runs"


@dataclass
class Touched:
    """Dates (None: no timestamp), id range and number of rows without an id (None: not counted) of a batch."""

    dates: list
    low: int | None
    high: int | None
    keyless: int | None = None


def touched(batch: DataFrame) -> Touched:
    rows = batch.groupBy(F.to_date("timestamp").alias("d")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("keyless")).collect()
    return Touched([r["d"] for r in rows], min((r["low"] for r in rows if r["low"] is not None), default=None),
                   max((r["high"] for r in rows if r["high"] is not None), default=None), sum(r["keyless"] for r in rows))


def on_dates(df: DataFrame, dates: list) -> DataFrame:
    """Rows of the given dates as a literal filter, which prunes the ``date`` partitions."""
    days = [d for d in dates if d is not None]
    keep = F.col("date").isin(days) if days else F.lit(False)
    return df.filter(keep | F.col("date").isNull() if None in dates else keep)


def repeated_ids(batch: DataFrame) -> tuple[DataFrame, int]:
    """Ids that ``batch`` holds more than once, and their number; only the id column is shuffled."""
    ensure_checkpoint_dir(batch.sparkSession)
    ids = batch.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id").checkpoint(eager=True)
    return ids, ids.count()


def latest_per_id(batch: DataFrame, repeated: tuple[DataFrame, int] | None = None) -> DataFrame:
    """One row per id: the latest timestamp, then the largest values column by column. Rows without an id all stay here;
    what they hold is their identity (``drop_stored``). Rows whose id is not among ``repeated`` (``repeated_ids`` of the
    batch or of more) pass as they are; whole rows are shuffled for the others, or for all if those are many."""
    ids, n = repeated or repeated_ids(batch)
    if not n:
        return batch
    order = [F.col("timestamp").desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in sorted(batch.columns) if c not in ("id", "timestamp")]
    first = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    known, others = batch.filter("id is not null"), batch.filter("id is null")
    if n <= SP.DEFAULT_BROADCAST_MAX_ROWS:
        others = others.unionByName(known.join(F.broadcast(ids), "id", "left_anti"))
        known = known.join(F.broadcast(ids), "id", "left_semi")
    return known.withColumn("__first", first).filter("__first = 1").drop("__first").unionByName(others)


def device_day_from_locations(locations: DataFrame) -> DataFrame:
    """Device-day summary maintained by the ETL (from the stored location table)."""
    return dev_ops.device_day_summary(locations, ordered=False)


def dated_grid_state(locations: DataFrame, grid_size: float) -> DataFrame:
    """Grid state per date: sums that merge exactly over dates."""
    return grid_ops.grid_state(locations, grid_size, by=["date"])


def read_grid(spark: SparkSession, paths: EtlPaths, grid_size: float = S.DEFAULT_GRID_SIZE) -> DataFrame:
    """The grid cells of all stored dates, merged from the state."""
    return grid_ops.grid_from_state(grid_ops.merge_grid_state(spark.read.parquet(paths.grid_state)), grid_size)


def compact_grid(spark: SparkSession, paths: EtlPaths, grid_size: float = S.DEFAULT_GRID_SIZE) -> int:
    """Write the merged grid to ``paths.grid`` for readers that want a table; run it as often as they need."""
    return W.write_table(read_grid(spark, paths, grid_size), paths.grid, "overwrite")


def write_batch_outputs(spark: SparkSession, located: DataFrame, paths: EtlPaths, full: bool, dates: list,
                        grid_size: float = S.DEFAULT_GRID_SIZE) -> int:
    """Write one classified, geo-assigned batch to every table; returns the rows added to the location table.

    The location table write is the materialisation: the downstream sinks read the written
    table back instead of a second copy.
    """
    schema = located.schema
    clustered = located.hint("rebalance", "date")   # few files per date; AQE splits large dates
    rows = W.write_table(clustered, paths.locations, "overwrite" if full else "append", ["date"])
    stored = spark.read.schema(schema).parquet(paths.locations)
    if full:
        W.write_table(dated_grid_state(stored, grid_size), paths.grid_state, "overwrite", ["date"])
        W.write_table(device_day_from_locations(stored), paths.device_days, "overwrite", ["date"])
        return rows
    affected = on_dates(stored, dates)
    W.replace_partitions(dated_grid_state(affected, grid_size), paths.grid_state, ["date"])
    W.replace_partitions(device_day_from_locations(affected), paths.device_days, ["date"])
    return rows


#: Columns that are not part of what a ping says.
_DERIVED = {"id", "processed_at", "district_id", "district_name", "province_id", "province_name"}


def drop_stored(spark: SparkSession, batch: DataFrame, path: str, span: Touched, index_path: str | None = None) -> DataFrame:
    """J12 at scale: the rows of ``batch`` (in the columns of the table) that the table does not hold yet: ``drop_stored_ids``
    for rows with an id, ``drop_stored_keyless`` for those without."""
    return drop_stored_keyless(spark, drop_stored_ids(spark, batch, path, span, index_path), path, span)


def drop_stored_ids(spark: SparkSession, batch: DataFrame, path: str, span: Touched, index_path: str | None = None) -> DataFrame:
    """Rows of ``batch`` without those whose id the table holds, whatever their date: an anti join on the ids in the batch's
    id range. Only the id column is read, and the range is pushed to the files: ids above the mark are stored only if an
    earlier run broke off, so mostly there is nothing to join. With ``index_path`` (ids in any order) the Bloom filters of
    the dates say first which partitions can hold one. It asks for ids alone, so it comes before any other work on the rows.
    """
    if span.low is None or not W.table_exists(spark, path):
        return batch
    keyed = batch.filter("id is not null")
    if index_path is not None:
        held = ID.stored_ids(spark, keyed, index_path, path)
    else:
        held = spark.read.schema("id bigint").parquet(path).filter(F.col("id").between(span.low, span.high))
        n = held.count()
        held = None if not n else F.broadcast(held) if n <= SP.DEFAULT_BROADCAST_MAX_ROWS else held
    return batch if held is None else only_new(keyed, held).unionByName(batch.filter("id is null"))


def drop_stored_keyless(spark: SparkSession, batch: DataFrame, path: str, span: Touched) -> DataFrame:
    """Rows without an id are the same ping if all that they hold is the same (null equals null): equal rows of ``batch`` (in
    the columns of the table) are one, and those stored on the batch's dates are left out. So a replay adds none of them.
    """
    if span.keyless == 0:
        return batch
    said = [c for c in batch.columns if c not in _DERIVED]
    keyed, keyless = batch.filter("id is not null"), batch.filter("id is null").dropDuplicates(said)
    if not W.table_exists(spark, path):
        return keyed.unionByName(keyless)
    table = spark.read.schema(batch.schema).parquet(path)
    same = on_dates(table, span.dates) if "date" in batch.columns else table
    same = same.filter("id is null").select(F.struct(*said).alias("__said"))
    keyless = keyless.withColumn("__said", F.struct(*said))
    keyless = keyless.join(same, keyless["__said"].eqNullSafe(same["__said"]), "left_anti").drop("__said")
    return keyed.unionByName(keyless)


def index_ids(spark: SparkSession, located: DataFrame, paths: EtlPaths, full: bool) -> None:
    """Add a batch's ids to the id index, before its rows are written; build it with more blocks when it gets full."""
    blocks = None if full else ID.index_blocks(spark, paths.id_index)
    if blocks is not None and ID.fill(spark, paths.id_index) > ID.FULL:
        blocks = ID.rebuild(spark, paths.id_index, paths.locations)
    if blocks is None:
        blocks = ID.blocks_for(located.filter("id is not null").count())
        W.write_table(ID.id_filters(located, blocks), paths.id_index, "overwrite", ["date"])
    else:
        ID.add_ids(spark, paths.id_index, located, blocks)


def run_etl(spark: SparkSession, source: DataFrame, paths: EtlPaths, districts: DataFrame, provinces: DataFrame,
            mode: str = "incremental", grid_size: float = S.DEFAULT_GRID_SIZE,
            index: SP.SpatialIndex | None = None, start=None, end=None, rising_ids: bool = True) -> dict:
    """ST07/P09: ``mode='full'`` (force) rebuilds every table; ``'incremental'`` processes rows above the mark.

    ``start`` / ``end`` optionally bound the batch by timestamp (inclusive). ``rows`` of the
    result is the number of rows added. Rows without an id are never above a mark: all of the source's
    are looked at, and those stored are known by what they hold. ``rising_ids=False``: ids come in any
    order, so the mark bounds nothing; stored ids are told by the Bloom filters in ``paths.id_index``.
    """
    if mode not in ("full", "incremental"):
        raise ValueError("mode must be 'full' or 'incremental'")
    ensure_checkpoint_dir(spark)
    started = time.time()
    mark = L.last_mark(spark, paths.ledger) if mode == "incremental" else None
    try:
        pings = normalise_pings(source, with_errors=False)
        batch = incremental_scan(pings, last_id=mark if rising_ids else None, start=start, end=end)
        if mark and rising_ids:
            batch = batch.unionByName(incremental_scan(pings.filter("id is null"), start=start, end=end))
        span = touched(batch)
        rows, new_mark = 0, mark
        if span.dates or mode == "full":
            index = index or SP.build_index([("district", districts, "district_id"),
                                             ("province", provinces, "province_id")], grid_size)
            repeated = repeated_ids(batch)
            if mode == "incremental":
                batch = drop_stored_ids(spark, batch, paths.locations, span, None if rising_ids else paths.id_index)
            located = SP.assign_locations(transform_locations(latest_per_id(batch, repeated), grid_size), districts, provinces, index=index)
            if mode == "incremental":
                located = drop_stored_keyless(spark, located, paths.locations, span)
                if not rising_ids:   # read by the id index and by the write
                    located = located.checkpoint(eager=True)
            else:
                said = [c for c in located.columns if c not in _DERIVED]
                located = located.filter("id is not null").unionByName(located.filter("id is null").dropDuplicates(said))
            if not rising_ids:
                index_ids(spark, located, paths, mode == "full")
            rows = write_batch_outputs(spark, located, paths, mode == "full", span.dates, grid_size)
            new_mark = span.high if span.high is not None else mark
        L.append_run(spark, paths.ledger, new_mark, rows, S.STATUS_SUCCESS, time.time() - started)
        return {"rows": rows, "last_processed_id": new_mark}
    except Exception as exc:  # record the failure; the mark stays where it was
        L.append_run(spark, paths.ledger, mark, 0, S.STATUS_FAILED, time.time() - started, str(exc)[:2000])
        raise


def reassign_missing(spark: SparkSession, paths: EtlPaths, districts: DataFrame, provinces: DataFrame,
                     index: SP.SpatialIndex | None = None) -> int:
    """K05/ST06: fill district/province where still null, rewriting only the date partitions that have such rows.

    The affected partitions are read, re-assigned (rows that already have both
    ids keep them), checkpointed (so the read does not depend on the files being
    replaced) and written back with dynamic partition overwrite.
    """
    ensure_checkpoint_dir(spark)
    stored = spark.read.parquet(paths.locations)
    missing = stored.filter(F.col("district_id").isNull() | F.col("province_id").isNull())
    dates = [r["date"] for r in missing.select("date").distinct().collect()]   # a row per day
    if not dates:
        return 0
    index = index or SP.build_index([("district", districts, "district_id"), ("province", provinces, "province_id")])
    fixed = SP.assign_locations(on_dates(stored, dates), districts, provinces, index=index, only_missing=True)
    fixed = fixed.select(*stored.columns).checkpoint(eager=True)
    return W.replace_partitions(fixed.hint("rebalance", "date"), paths.locations, ["date"])


def fresh_positions(spark: SparkSession, batch: DataFrame, path: str, span: Touched) -> DataFrame:
    """The rows of a batch, each id once, that the positions at ``path`` do not hold, with their date."""
    new = latest_per_id(drop_stored_ids(spark, batch, path, span), repeated_ids(batch))
    return drop_stored_keyless(spark, new.withColumn("date", F.to_date("timestamp")), path, span)


def run_device_day_job(spark: SparkSession, source: DataFrame, root: str) -> dict:
    """The device-per-day job (§3.2): P02/P04 clean -> K11 clean positions -> A08 summary -> K02 replace dates.

    Positions already stored (by id) are not added again. The summary of every date
    present in the batch is recomputed from the whole clean-positions table (not from the
    batch alone), then replaces those date partitions; other dates stay untouched. The
    same batch twice changes nothing.
    """
    ensure_checkpoint_dir(spark)
    clean = normalise_pings(source, with_errors=False)
    clean = clean.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    span = touched(clean)
    if not span.dates:
        return {"clean_rows": 0, "summary_rows": 0}
    positions = f"{root}/clean_positions"
    fresh = fresh_positions(spark, clean, positions, span)
    written = W.write_table(fresh.hint("rebalance", "date"), positions, "append", ["date"])
    affected = on_dates(spark.read.schema(fresh.schema).parquet(positions), span.dates)
    summary = dev_ops.device_day_summary(affected, ordered=False)
    replaced = W.replace_partitions(summary, f"{root}/device_day_summary", ["date"])
    return {"clean_rows": written, "summary_rows": replaced}
