"""Ping sources: file reads with a fixed schema, normalisation, scans, quarantine.

S01-S06, P02-P04, P09, J12. Reads never infer a schema; dirty values become
null plus an error tag, and rows can be split into valid and quarantine frames
instead of failing the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_DOUBLE_COLS = ["latitude", "longitude", "altitude", "speed", "battery", "signal"]
_WHOLE_UNIT_COLS = ["battery", "signal"]


def read_ping_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines pings with the fixed raw schema (no inference), normalised.

    An empty input keeps the schema, so later column use never breaks.
    """
    raw = spark.read.schema(S.RAW_PING_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return normalise_pings(raw)


def read_ping_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed ping files (the ETL's own landing format)."""
    paths = [path] if isinstance(path, str) else list(path)
    return normalise_pings(spark.read.parquet(*paths))


def _to_double(c: Column) -> Column:
    d = c.try_cast("double")
    # NaN is turned into null at ingest (it would pass no range test and sort last).
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def normalise_pings(df: DataFrame, with_errors: bool = True) -> DataFrame:
    """Cast every field of a raw ping to its typed column.

    * numbers: ``try_cast`` to double (text that is not a number -> null), NaN -> null
    * battery and signal: truncated to whole units (Python ``int(float(x))``)
    * id: bigint through double so '12.0' is accepted
    * timestamp: strings parsed once with ``try_to_timestamp``; typed timestamps kept
    * ``_errors``: names of fields whose raw value was present but did not parse
    """
    cols = set(df.columns)
    out: dict[str, Column] = {}
    errors: list[Column] = []
    for name in S.PING_COLUMNS:
        if name not in cols:
            out[name] = F.lit(None).cast(S.PING_SCHEMA[name].dataType)
            continue
        raw = F.col(name)
        dtype = df.schema[name].dataType
        parsed = None
        if name in _DOUBLE_COLS:
            parsed = raw.try_cast("double")
            typed = _to_double(raw)
            if name in _WHOLE_UNIT_COLS:
                typed = F.when(typed.isNull(), typed).otherwise(
                    F.when(typed < 0, F.ceil(typed)).otherwise(F.floor(typed)).cast("double"))
            out[name] = typed
        elif name == "id":
            out[name] = raw.try_cast("double").try_cast("bigint") if isinstance(dtype, T.StringType) \
                else raw.cast("bigint")
        elif name == "timestamp":
            if isinstance(dtype, T.StringType):
                out[name] = F.try_to_timestamp(raw)
            else:
                out[name] = raw
        else:
            out[name] = raw.cast("string")
        if with_errors and isinstance(dtype, T.StringType) and name not in ("device_id", "device_name",
                                                                               "sim_operator", "network_type"):
            # a parse failure, not a NaN (which parses and is then nulled on purpose)
            result = parsed if parsed is not None else out[name]
            bad = raw.isNotNull() & (F.trim(raw) != "") & result.isNull()
            errors.append(F.when(bad, F.lit(f"unparsable_{name}")))
    result = df.select(*[out[n].alias(n) for n in S.PING_COLUMNS],
                       *([] if not with_errors else
                         [F.array_compact(F.array(*errors)).alias("_errors") if errors
                          else F.array().cast("array<string>").alias("_errors")]))
    return result


def validation_reasons(df: DataFrame) -> Column:
    """P03 rules as an array of reason tags (empty array = valid)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    checks = [
        F.when(lat.isNull(), F.lit("latitude_missing")),
        F.when(lat.isNotNull() & ~lat.between(-90, 90), F.lit("latitude_out_of_range")),
        F.when(lon.isNull(), F.lit("longitude_missing")),
        F.when(lon.isNotNull() & ~lon.between(-180, 180), F.lit("longitude_out_of_range")),
        F.when(F.col("speed") < 0, F.lit("speed_negative")),
        F.when(~F.col("battery").between(0, 100), F.lit("battery_out_of_range")),
    ]
    reasons = F.array_compact(F.array(*checks))
    if "_errors" in df.columns:
        reasons = F.concat(F.col("_errors"), reasons)
    return reasons


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine). Quarantine rows carry ``reasons`` (array) and ``reason`` (joined text).

    Both frames come from one lazily evaluated plan; write them in one job with
    ``persist`` on the caller side if both are materialised.
    """
    tagged = df.withColumn("reasons", validation_reasons(df))
    valid = tagged.filter(F.size("reasons") == 0).drop("reasons", "_errors")
    bad = (tagged.filter(F.size("reasons") > 0)
           .withColumn("reason", F.array_join(F.col("reasons"), ","))
           .drop("_errors"))
    return valid, bad


def page_scan(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A stable page (ordered by id) of ``limit`` rows after ``offset``."""
    out = df.orderBy("id")
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def _equality_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    for k, v in (filters or {}).items():
        df = df.filter(F.col(k).isNull() if v is None else (F.col(k) == F.lit(v)))
    return df


def filtered_scan(df: DataFrame, filters: dict | None = None, start=None, end=None,
                  limit: int | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Equality filters + inclusive timestamp bounds (both kept, Q16) + limit.

    Filters are plain predicates, so Catalyst pushes them into the parquet scan.
    """
    out = _equality_filters(df, filters)
    if start is not None:
        out = out.filter(F.col(ts_col) >= F.lit(start).cast(df.schema[ts_col].dataType))
    if end is not None:
        out = out.filter(F.col(ts_col) <= F.lit(end).cast(df.schema[ts_col].dataType))
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return out


def incremental_scan(df: DataFrame, last_id: int | None = None, start=None, end=None,
                     ts_col: str = "timestamp") -> DataFrame:
    """Rows above the high-water mark (``id > last_id``), optional inclusive date range.

    No page loop: the predicate is pushed to the files and every task reads its split.
    A mark of 0 or None reads everything above 0 / everything.
    """
    out = df
    if last_id:
        out = out.filter(F.col("id") > F.lit(int(last_id)))
    return filtered_scan(out, None, start, end, None, ts_col)


def count_records(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """Exact row count under equality filters, as a one-row frame (``total``)."""
    return _equality_filters(df, filters).agg(F.count(F.lit(1)).alias("total"))


def only_new(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose id is not yet in ``existing`` (left anti join on id)."""
    return batch.join(existing.select("id"), on="id", how="left_anti")


def high_water_mark(df: DataFrame) -> DataFrame:
    """Max id of a batch (the next mark), one-row frame."""
    return df.agg(F.max("id").alias("last_processed_id"))
