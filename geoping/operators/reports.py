"""Study reports over all raw pings.

The reference computes these in Python loops over every fetched record; here
each is a grouped aggregate (partial aggregation before the shuffle), with
shares by a window over the *aggregated* rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import classify as C
from ..functions.numeric import exact_mean, percent
from ..session import ensure_checkpoint_dir
from .dimensions import shuffle_partitions


def _materialise(grouped: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint aggregated rows once; return them with their record total."""
    ensure_checkpoint_dir(grouped.sparkSession)
    grouped = grouped.checkpoint(eager=True)
    row = grouped.agg(F.sum("records").alias("t")).collect()[0]
    return grouped, int(row["t"] or 0)


def _with_share(grouped: DataFrame, key: str | None = None) -> DataFrame:
    """W04 (+ W03 when ``key`` is given): percentage of the grand total, and rank by records desc.

    The grouped rows are aggregates: they are materialised once, the total is
    applied as a scalar literal (no window over all groups, no join), and the
    rank is the range-partitioned numbering of ``dense_keys``.
    """
    from .dimensions import dense_keys
    grouped, total = _materialise(grouped)
    out = grouped.withColumn("percentage", percent(F.col("records"), F.lit(total)))
    if key is None:
        return out
    ranked = dense_keys(out, [F.desc("records"), F.asc_nulls_last(key)], key="rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def operator_groups(pings: DataFrame) -> DataFrame:
    """Strict-normalised operator groups: records, % of all, number of raw variants, sample row.

    The sample is the row with the lowest id (deterministic ``min_by``).
    """
    keyed = pings.select("id", "device_name", "network_type",
                         C.normalize_operator("sim_operator", strict=True).alias("operator"),
                         F.when(F.col("sim_operator").isNull() | (F.col("sim_operator") == ""), F.lit("NULL"))
                         .otherwise(F.col("sim_operator")).alias("variant"))
    groups = (keyed.groupBy("operator")
              .agg(F.count(F.lit(1)).alias("records"), F.count_distinct("variant").alias("variants"),
                   F.min_by(F.struct("device_name", "network_type"), F.col("id")).alias("__s")))
    groups = groups.select("operator", "records", "variants", F.col("__s.device_name").alias("sample_device"),
                           F.col("__s.network_type").alias("sample_network"))
    return _with_share(groups, "operator")


def operator_variants(pings: DataFrame) -> DataFrame:
    """The raw variants merged into each normalised operator, with their record counts (flat rows)."""
    return (pings.select(C.normalize_operator("sim_operator", strict=True).alias("operator"),
                         F.when(F.col("sim_operator").isNull() | (F.col("sim_operator") == ""), F.lit("NULL"))
                         .otherwise(F.col("sim_operator")).alias("variant"))
            .groupBy("operator", "variant").agg(F.count(F.lit(1)).alias("records")))


def network_key(raw: str = "network_type"):
    """A15 key: null or '' -> 'NULL', otherwise the trimmed text."""
    c = F.col(raw)
    return F.when(c.isNull() | (c == ""), F.lit("NULL")).otherwise(F.trim(c))


def network_groups(pings: DataFrame) -> DataFrame:
    """Raw network-type groups with % and rank (the report's top 10 are rank <= 10)."""
    groups = pings.groupBy(network_key().alias("network")).agg(F.count(F.lit(1)).alias("records"))
    return _with_share(groups, "network")


def network_generations(pings: DataFrame) -> DataFrame:
    """Generation groups by the strict rule applied to the A15 keys; empty generations omitted."""
    keyed = pings.select(network_key().alias("network"))
    gen = C.network_generation(F.col("network"), strict=True)
    groups = keyed.groupBy(gen.alias("generation")).agg(F.count(F.lit(1)).alias("records"))
    return _with_share(groups.filter(F.col("records") > 0))


def speed_groups(pings: DataFrame) -> DataFrame:
    """Speed-range groups (text that is not a number counts as DETENIDO), %, fixed order."""
    groups = pings.groupBy(C.speed_range("speed").alias("speed_range")).agg(F.count(F.lit(1)).alias("records"))
    return _with_share(groups).withColumn("position", C.ordinal("speed_range", S.SPEED_ORDER))


def network_group_samples(pings: DataFrame) -> DataFrame:
    """A32 for networks: each raw network group with its row of the lowest id (device, operator)."""
    return _group_samples(pings, network_key().alias("network"), "device_name", "sim_operator")


def speed_group_samples(pings: DataFrame) -> DataFrame:
    """A32 for speed ranges: each group with its row of the lowest id (device, speed)."""
    return _group_samples(pings, C.speed_range("speed").alias("speed_range"), "device_name", "speed")


def _group_samples(pings: DataFrame, group, *shown: str) -> DataFrame:
    keyed = pings.select("id", group, *[F.col(c).alias(f"sample_{c}") for c in shown])
    name = keyed.columns[1]
    first = F.min_by(F.struct("id", *[f"sample_{c}" for c in shown]), F.col("id"))
    return (keyed.groupBy(name).agg(F.count(F.lit(1)).alias("records"), first.alias("__s"))
            .select(name, "records", F.col("__s.id").alias("sample_id"), *[F.col(f"__s.sample_{c}") for c in shown]))


def speed_motion_share(pings: DataFrame) -> DataFrame:
    """Stationary vs moving records and shares."""
    sr = C.speed_range("speed")
    out = pings.agg(F.count(F.lit(1)).alias("total"), F.count_if(sr == S.SPEED_STOPPED).alias("stationary"))
    out = out.withColumn("moving", F.col("total") - F.col("stationary"))
    return (out.withColumn("pct_stationary", percent("stationary", "total"))
            .withColumn("pct_moving", percent("moving", "total")))


def value_histogram(pings: DataFrame, col: str = "speed") -> DataFrame:
    """(v, n): record count per distinct value (null included), distributed with partial aggregation."""
    return pings.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def exact_ranks(hist: DataFrame, ps: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Exact ``sorted[int(n * p)]`` for each ``p`` from a value histogram ``(v, n)``; one row.

    Distributed selection: the non-null histogram is range-partitioned by value
    and materialised; only one total per range partition reaches the driver, which
    finds the partition and local rank of each target; the cumulative count then
    runs inside those partitions only (each holds ~1/partitions of the distinct
    values), never over all values in one task.
    """
    spark = hist.sparkSession
    h = hist.filter(F.col("v").isNotNull())
    ranged = h.repartitionByRange(partitions or shuffle_partitions(spark), "v").withColumn("__pid", F.spark_partition_id())
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    sums = sorted((r["__pid"], int(r["s"])) for r in
                  ranged.groupBy("__pid").agg(F.sum("n").alias("s")).collect())
    total = sum(s for _, s in sums)
    names = list(ps)
    if total == 0:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    targets, offset = [], 0
    bounds = []
    for pid, cnt in sums:
        bounds.append((pid, offset, cnt))
        offset += cnt
    for name, p in ps.items():
        k = min(int(total * p), total - 1)
        for pid, off, cnt in bounds:
            if off <= k < off + cnt:
                targets.append((name, pid, k - off))
                break
    t = spark.createDataFrame(targets, "name string, __pid int, local_k long")
    part = ranged.join(F.broadcast(t.select("__pid").distinct()), "__pid", "left_semi")
    w = Window.partitionBy("__pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = part.withColumn("cum", F.sum("n").over(w))
    picked = (cum.join(F.broadcast(t), "__pid").filter(F.col("cum") > F.col("local_k"))
              .groupBy("name").agg(F.min("v").alias("v")))
    return picked.groupBy().pivot("name", names).agg(F.first("v"))


def speed_profile(pings: DataFrame) -> DataFrame:
    """null/invalid, valid and zero counts with %, min, max, mean and the median (sorted[n // 2]).

    Counts, extrema and the exact decimal mean come from one value histogram;
    the median from the same histogram by distributed selection.
    """
    hist = value_histogram(pings, "speed")
    ensure_checkpoint_dir(pings.sparkSession)
    hist = hist.checkpoint(eager=True)       # distinct values only; read for the counts and for the median
    counts = hist.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("n"))), F.lit(0)).alias("zero"),
        F.min("v").alias("min_speed"), F.max("v").alias("max_speed"),
        F.try_divide(F.sum(F.col("v").cast("decimal(18,6)") * F.col("n")).cast("double"),
                     F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).cast("double")).alias("mean_speed"))
    median = exact_ranks(hist, {"median_speed": 0.5}).collect()[0]["median_speed"]
    out = counts.withColumn("median_speed", F.lit(median).cast("double"))
    return (out.withColumn("null_or_invalid", F.col("total") - F.coalesce(F.col("valid"), F.lit(0)))
            .withColumn("pct_null_or_invalid", percent("null_or_invalid", "total"))
            .withColumn("pct_valid", percent("valid", "total"))
            .withColumn("pct_zero", percent("zero", "total")))


def speed_percentiles(pings: DataFrame, ps: list[float] | None = None, approx: bool = False) -> DataFrame:
    """Percentiles by the index rule ``sorted[int(n * p)]`` over the valid speeds, one row.

    Exact by default (``exact_ranks``); ``approx=True`` uses ``percentile_approx``.
    """
    ps = ps or S.SPEED_PERCENTILES
    names = {f"p{int(round(p * 100))}": p for p in ps}
    if approx:
        valid = pings.select("speed").filter(F.col("speed").isNotNull())
        return valid.agg(*[F.percentile_approx("speed", p, 100000).alias(n) for n, p in names.items()])
    return exact_ranks(value_histogram(pings, "speed"), names)


def speed_histogram(pings: DataFrame) -> DataFrame:
    """7 buckets in m/s over the valid speeds, % of valid, fixed order."""
    valid = pings.filter(F.col("speed").isNotNull())
    groups = valid.groupBy(C.speed_histogram_bucket("speed").alias("bucket")).agg(F.count(F.lit(1)).alias("records"))
    return _with_share(groups).withColumn(
        "position", C.ordinal("bucket", [lbl for lbl, _ in S.SPEED_HISTOGRAM]))


def top_speeds(pings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest speeds > 0 with km/h, device, network, timestamp (ties by id)."""
    return (pings.filter(F.col("speed") > 0)
            .select("id", "speed", C.speed_kmh("speed").alias("speed_kmh"), "device_name", "network_type",
                    "timestamp")
            .orderBy(F.desc("speed"), "id").limit(n))


def period_report(locations: DataFrame, digits: int | None = None) -> DataFrame:
    """Total locations, average battery and signal per time period (optionally rounded)."""
    def avg(c):
        m = exact_mean(c)
        return F.round(m, digits) if digits is not None else m
    return (locations.groupBy(C.period_of_day("timestamp").alias("time_period"))
            .agg(F.count(F.lit(1)).alias("total_locations"), avg("battery").alias("avg_battery"),
                 avg("signal").alias("avg_signal")))


def hour_report(locations: DataFrame) -> DataFrame:
    """Records and distinct devices per (hour, period)."""
    return (locations.groupBy(F.hour("timestamp").alias("hour_value"),
                              C.period_of_day("timestamp").alias("time_period"))
            .agg(F.count(F.lit(1)).alias("records"), F.countDistinct("device_id").alias("devices")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table, as a union of one-row aggregates."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def required_columns_audit(df: DataFrame, required: list[str]) -> DataFrame:
    """Which required columns the frame lacks (schema check, no data read)."""
    spark = df.sparkSession
    present = set(df.columns)
    return spark.createDataFrame([(c, c in present) for c in required], "column_name string, present boolean")


def in_period(locations: DataFrame, period: str, hour_from: int | None = None, hour_to: int | None = None) -> DataFrame:
    """Locations of one time period, optionally within an hour range (inclusive)."""
    out = locations.filter(C.period_of_day("timestamp") == F.lit(period))
    if hour_from is not None:
        out = out.filter(F.hour("timestamp") >= hour_from)
    if hour_to is not None:
        out = out.filter(F.hour("timestamp") <= hour_to)
    return out
