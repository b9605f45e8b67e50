"""Bloom filters of stored ids, a set per date partition (J12, ST02).

A filter is rows (date, block, bits): an id belongs to one block of ``BLOCK_BITS`` bits and sets ``HASHES`` of
them. Rows come from an aggregation (``bitmap_construct_agg``) and only ever gain bits, so the index of two
batches is their union, a batch indexed twice changes nothing, and rows of one block are or-ed when read.

A batch asks in three steps, each on what is left: all dates together (one row a block), the dates of the
few ids that may be there, and last the id column of just those date partitions, by an exact join. An id
that is stored always answers "may be", so none is taken for new; the filters only save reading.

Write the index before the rows: after a crash in between it names ids that are not stored, which the
exact step finds out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import writers as W

BLOCK_BITS = 32_768      # of a bitmap of Spark's bitmap functions: 4 KiB
HASHES = 4
BITS_PER_ID = 12         # about 0.3 % of strange ids pass with 4 hashes
FULL = 0.4               # share of set bits above which an index is built anew with more blocks


def blocks_for(ids: int) -> int:
    """Blocks for four times as many ids as there are."""
    return max(1, -(-4 * ids * BITS_PER_ID // BLOCK_BITS))


def _block(ident: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), ident), blocks)


def _places(ident: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(100 + j), ident), F.lit(BLOCK_BITS)) for j in range(HASHES)])


def id_filters(rows: DataFrame, blocks: int, id_col: str = "id") -> DataFrame:
    """(date, block, blocks, bits) of the ids of ``rows`` (id, date); rows without an id have none."""
    ids = rows.filter(F.col(id_col).isNotNull())
    spread = ids.select("date", _block(F.col(id_col), F.lit(blocks)).alias("block"), F.explode(_places(F.col(id_col))).alias("place"))
    return (spread.groupBy("date", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
            .select("date", "block", F.lit(blocks).cast("bigint").alias("blocks"), "bits"))


def _has(bits: Column, ident: Column) -> Column:
    def one(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (F.floor(byte / F.pow(F.lit(2.0), F.pmod(place, F.lit(8)).cast("double"))).cast("int") % 2) == 1

    return F.forall(_places(ident), one)


def index_blocks(spark: SparkSession, path: str) -> int | None:
    """Blocks of the stored index; None without one."""
    if not W.table_exists(spark, path):
        return None
    row = spark.read.parquet(path).agg(F.max("blocks").alias("blocks")).collect()[0]
    return row["blocks"]


def add_ids(spark: SparkSession, path: str, rows: DataFrame, blocks: int) -> None:
    """Add the ids of a batch (id, date) to the index."""
    W.write_table(id_filters(rows, blocks), path, "append", ["date"])


def rebuild(spark: SparkSession, path: str, table: str, blocks: int | None = None) -> int:
    """Build the index anew from the id column of a stored table; returns its blocks."""
    stored = spark.read.schema("id bigint, date date").parquet(table)
    blocks = blocks or blocks_for(stored.filter("id is not null").count())
    W.write_table(id_filters(stored, blocks), path, "overwrite", ["date"])
    return blocks


def fill(spark: SparkSession, path: str) -> float:
    """Share of the bits set, all dates together."""
    whole = _whole(spark.read.parquet(path))
    row = whole.agg(F.sum(F.bitmap_count("bits")).alias("set"), F.max("blocks").alias("blocks")).collect()[0]
    return (row["set"] or 0) / (BLOCK_BITS * (row["blocks"] or 1))


def _whole(index: DataFrame) -> DataFrame:
    return index.groupBy("block", "blocks").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_stored(ids: DataFrame, index: DataFrame, blocks: int) -> DataFrame:
    """(id, date): the dates whose filters an id of ``ids`` passes; ids surely not stored have no row."""
    asked = ids.filter("id is not null").select("id", _block(F.col("id"), F.lit(blocks)).alias("block")).distinct()
    some = asked.join(_whole(index).select("block", "bits"), "block").filter(_has(F.col("bits"), F.col("id"))).select("id", "block")
    dated = index.groupBy("date", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return some.join(dated, "block").filter(_has(F.col("bits"), F.col("id"))).select("id", "date")


def stored_ids(spark: SparkSession, ids: DataFrame, index_path: str, table: str) -> DataFrame | None:
    """The ids of ``ids`` that are in ``table``, exactly; None if surely none is. Reads the id column of the dates that may hold one."""
    blocks = index_blocks(spark, index_path)
    if blocks is None or not W.table_exists(spark, table):
        return None
    index = spark.read.parquet(index_path)
    maybe = maybe_stored(ids, index, blocks).checkpoint(eager=True)
    dates = [r["date"] for r in maybe.select("date").distinct().collect()]   # a row per day
    if not dates:
        return None
    days = [d for d in dates if d is not None]
    here = F.col("date").isin(days) if days else F.lit(False)
    here = here | F.col("date").isNull() if None in dates else here
    stored = spark.read.schema("id bigint, date date").parquet(table).filter(here).select("id")
    return maybe.select("id").distinct().join(stored, "id", "left_semi")
