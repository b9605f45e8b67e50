"""Run ledger (S12, K06, A31): one row per ETL run, append-only parquet.

The high-water mark only moves on SUCCESS; failed and zero-row runs are
recorded too (the reference recorded only successes).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    from ..sinks.writers import table_exists
    if not table_exists(spark, path):
        return spark.createDataFrame([], S.LEDGER_SCHEMA)
    return spark.read.schema(S.LEDGER_SCHEMA).parquet(path)


def last_success(ledger: DataFrame) -> DataFrame:
    """Last processed id of the latest successful run (one row; null when none)."""
    return (ledger.filter(F.col("status") == S.STATUS_SUCCESS)
            .agg(F.max_by("last_processed_id", "execution_date").alias("last_processed_id")))


def last_mark(spark: SparkSession, path: str) -> int | None:
    """The mark as a Python value (a one-row aggregate)."""
    row = last_success(read_ledger(spark, path)).collect()[0]
    return row["last_processed_id"]


def append_run(spark: SparkSession, path: str, last_processed_id: int | None, records: int, status: str,
               seconds: float, error: str | None = None, when: dt.datetime | None = None) -> None:
    """Append one run row."""
    row = (uuid.uuid4().hex, when or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
           last_processed_id, int(records), status, float(seconds), error)
    spark.createDataFrame([row], S.LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def history(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Latest ``n`` runs."""
    return ledger.orderBy(F.desc("execution_date"), "run_id").limit(n)


def rows_on(ledger: DataFrame, day: str) -> DataFrame:
    """Records processed by successful runs on one day (e.g. today)."""
    return (ledger.filter((F.to_date("execution_date") == F.lit(day).cast("date"))
                          & (F.col("status") == S.STATUS_SUCCESS))
            .agg(F.coalesce(F.sum("records_processed"), F.lit(0)).alias("records_processed")))
