"""Mergeable summaries kept per date: distinct devices (A01, ST05) and ranks of a measure.

**Distinct devices.** HyperLogLog registers as a sorted array of ``register * 64 + rank``, empty registers left
out: one row per cell and date instead of one per device. A register is a maximum, so parts merge to the
same bytes in any order and split (a serialised sketch with running estimators does not), and an
array holds at most ``2**PRECISION`` numbers. Relative standard error 1.04 / sqrt(2**PRECISION), 1.6 %; below about
10,000 devices linear counting does better. The hash is the first 52 bits of MD5, which other engines have.

**Ranks.** Per date the values fall into buckets of fixed, logarithmic borders (``PER_OCTAVE`` a doubling); a
bucket keeps its count, least and greatest value. Counts add over any range of dates and bound the rank of
every bucket exactly, so a percentile lies in one known bucket. Where that bucket's least and greatest value agree,
as in one of zeros, that is the answer; otherwise one pass over the values of that bucket alone (a range
pushed to the files) cuts it into equal parts, and so on until the value is alone. No sort, no full histogram.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import classify as C
from ..functions.numeric import DECIMAL_TYPE, mean_from
from .grid import MEASURES

PRECISION = 12
_HASH_BITS = 52
PER_OCTAVE = 32          # buckets for a doubling of the value
_SPLIT = 4096            # equal parts of a bucket that is looked into


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- distinct

def _register(value: Column, precision: int) -> tuple[Column, Column]:
    """Register and rank of a value (text)."""
    bits = F.conv(F.substring(F.md5(value), 1, _HASH_BITS // 4), 16, 10).cast("bigint")
    m = F.lit(1 << precision)
    rest = F.floor(bits / m)
    width = _HASH_BITS - precision
    return bits % m, F.when(rest == 0, F.lit(width + 1)).otherwise(F.lit(width + 1) - F.length(F.bin(rest)))


def distinct_registers(df: DataFrame, by: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """``by`` columns and ``registers`` of the distinct values; nulls do not count.

    Two map-side combined aggregations: the greatest rank of each register, then a row per group of at most
    2**precision registers.
    """
    register, rank = _register(F.col(value).cast("string"), precision)
    ranks = (df.filter(F.col(value).isNotNull()).groupBy(*by, register.alias("__register")).agg(F.max(rank).alias("__rank")))
    return _gathered(ranks, by)


def _gathered(ranks: DataFrame, by: list[str]) -> DataFrame:
    return ranks.groupBy(*by).agg(F.array_sort(F.collect_list((F.col("__register") * 64 + F.col("__rank")).cast("int"))).alias("registers"))


def merge_registers(states: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` from rows of several batches or dates."""
    entry = states.select(*by, F.explode("registers").alias("__e"))
    ranks = entry.groupBy(*by, F.floor(F.col("__e") / 64).alias("__register")).agg(F.max(F.col("__e") % 64).alias("__rank"))
    return _gathered(ranks, by)


def distinct_estimate(registers: Column | str, precision: int = PRECISION) -> Column:
    """Estimated number of distinct values (double); 0 for null."""
    m = float(1 << precision)
    r = F.coalesce(_c(registers), F.array().cast("array<int>"))
    zeros = F.lit(m) - F.size(r)
    harmonic = F.aggregate(r, zeros.cast("double"), lambda acc, e: acc + F.pow(F.lit(2.0), -(e % 64).cast("double")))
    raw = F.lit(0.7213 / (1.0 + 1.079 / m) * m * m) / harmonic
    return F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / F.when(zeros > 0, zeros))).otherwise(raw)


def grid_sketch_state(locations: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE, by: list[str] | None = None) -> DataFrame:
    """State of A01 per (cell, ``by``): n, decimal sums and counts of the measures, registers of the devices."""
    g, by = float(grid_size), by or []
    keyed = locations.withColumn("cell_y", C.grid_index("latitude", g)).withColumn("cell_x", C.grid_index("longitude", g))
    keys = ["cell_y", "cell_x", *by]
    register, rank = _register(F.col("device_id"), PRECISION)
    # one scan: sums per (cell, register), a register row carries the sums of its devices' pings
    level = keyed.groupBy(*keys, F.when(F.col("device_id").isNotNull(), register).alias("__register")).agg(
        F.max(rank).alias("__rank"), F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m).cast(DECIMAL_TYPE)).alias(f"sum_{m}") for m in MEASURES],
        *[F.count(m).alias(f"cnt_{m}") for m in MEASURES])
    entry = F.when(F.col("__register").isNotNull(), (F.col("__register") * 64 + F.col("__rank")).cast("int"))
    return level.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES],
                                    *[F.sum(f"cnt_{m}").alias(f"cnt_{m}") for m in MEASURES], F.array_sort(F.collect_list(entry)).alias("registers"))


def merge_grid_sketches(*states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """State of all batches, dates merged unless named in ``by``."""
    keys = ["cell_y", "cell_x", *(by or [])]
    u = reduce(DataFrame.unionByName, states)
    sums = u.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES],
                                *[F.sum(f"cnt_{m}").alias(f"cnt_{m}") for m in MEASURES])
    return sums.join(merge_registers(u, keys), keys, "left").withColumn("registers", F.coalesce("registers", F.array().cast("array<int>")))


def grid_from_sketches(state: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE, digits: int = 2) -> DataFrame:
    """A01's cells with ``unique_devices`` estimated (rounded)."""
    g = F.lit(float(grid_size))
    return state.select((F.col("cell_y") * g).alias("lat_grid"), (F.col("cell_x") * g).alias("lon_grid"), "cell_y", "cell_x", F.col("n").alias("point_count"),
                        F.round(distinct_estimate("registers")).cast("bigint").alias("unique_devices"),
                        *[F.round(mean_from(F.col(f"sum_{m}"), F.col(f"cnt_{m}")), digits).alias(f"avg_{m}") for m in MEASURES])


# ---------------------------------------------------------------- ranks

def _bucket(v: Column) -> Column:
    """Bucket number, rising with the value; 0 holds 0 alone. Magnitudes below 2**-100 share the innermost bucket of their sign."""
    size = F.greatest(F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + F.lit(100 * PER_OCTAVE), F.lit(0)) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def rank_state(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(``by``, bucket, n, low, high): counts per bucket; mergeable by sum, min and max. Nulls do not count."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*(by or []), _bucket(v).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def _holding(counts: list, rank: int):
    """The bucket (n, low, high) that holds a rank, in order, and the rank inside it."""
    for c in sorted(counts, key=lambda c: c["low"]):
        if rank < c["n"]:
            return c, rank
        rank -= c["n"]
    raise ValueError("rank beyond the values")


def select_rank(df: DataFrame, value: str, bucket, rank: int) -> tuple[float, int]:
    """The value of a rank inside a bucket (n, low, high), and the passes it took over the bucket's values."""
    passes = 0
    low, high = bucket["low"], bucket["high"]
    v = F.col(value)
    while low < high:
        passes += 1
        inside = df.filter((v >= low) & (v <= high)).select(v.alias("v"))
        width = (high - low) / _SPLIT
        part = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(_SPLIT - 1)) if width > 0 and math.isfinite(width) else F.col("v") > low
        rows = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()   # at most _SPLIT rows
        held, rank = _holding(rows, rank)
        if (held["low"], held["high"]) == (low, high):   # neighbours in floating point
            rows = inside.groupBy((F.col("v") > low).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            held, rank = _holding(rows, rank)
        low, high = held["low"], held["high"]
    return low, passes


def percentiles_from_state(state: DataFrame, df: DataFrame, value: str, fractions: list[float]) -> tuple[list[float | None], int]:
    """``sorted(values)[int(n * p)]`` for each fraction, and the rows of buckets that were looked into.

    ``state``: rank states of the same rows as ``df``, over any dates. A few thousand bucket counts reach the driver
    (bounded by the buckets of a double's range, not by the data).
    """
    counts = state.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    total = sum(c["n"] for c in counts)
    out, looked = [], {}
    for p in fractions:
        k = int(total * p)
        if not 0 <= k < total:
            out.append(None)
            continue
        held, rank = _holding(counts, k)
        got, passes = select_rank(df, value, held, rank)
        if passes:
            looked[held["bucket"]] = held["n"]
        out.append(got)
    return out, sum(looked.values())


def percentiles_over_days(state: DataFrame, df: DataFrame, value: str, names: dict[str, float], start=None, end=None) -> DataFrame:
    """A19 over the dates from ``start`` to ``end`` (inclusive; None: open) from per-date states: one row, a column per name."""
    for frame_bound, op in ((start, "ge"), (end, "le")):
        if frame_bound is not None:
            keep = F.col("date") >= F.lit(frame_bound).cast("date") if op == "ge" else F.col("date") <= F.lit(frame_bound).cast("date")
            state, df = state.filter(keep), df.filter(keep)
    values, _ = percentiles_from_state(state, df, value, list(names.values()))
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in zip(names, values, strict=True)])
