"""Dataset statistics and label distributions.

The reference runs six separate actions (one global aggregate and five
group-bys). Here the five distributions are one scan with GROUPING SETS
(an Expand node feeding one partial aggregation), labelled by ``grouping_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import classify as C
from ..functions.numeric import exact_mean, percent, zero_if_falsy

# dimension name -> (column, fixed order or None for count-desc, drop null label)
DISTRIBUTIONS = {
    "period": ("period", S.PERIOD_ORDER, False),
    "altitude_range": ("altitude_range", S.ALTITUDE_ORDER, True),
    "battery_level": ("battery_level", S.BATTERY_ORDER, True),
    "network_generation": ("network_generation", None, False),
    "sim_operator": ("sim_operator", None, False),
}


def dataset_statistics(locations: DataFrame, digits: int = 2) -> DataFrame:
    """Total, distinct devices, 2-dp averages (null/0 -> 0) and the timestamp range, one row."""
    aggs = [F.count(F.lit(1)).alias("total_points"), F.countDistinct("device_id").alias("unique_devices")]
    for m in ("battery", "signal", "speed", "altitude"):
        aggs.append(zero_if_falsy(F.round(exact_mean(m), digits)).alias(f"avg_{m}"))
    aggs += [F.min("timestamp").alias("min_date"), F.max("timestamp").alias("max_date")]
    return locations.agg(*aggs)


def label_distributions(locations: DataFrame) -> DataFrame:
    """(dimension, label, count, position) for the five label columns in one scan.

    Fixed-order dimensions are positioned by their label order; network and
    operator by count descending, ties broken by label. Null altitude and
    battery labels are dropped, as in the reference's output.
    """
    cols = [spec[0] for spec in DISTRIBUTIONS.values()]
    grouped = (locations.select(*cols)
               .groupingSets([[c] for c in cols], *cols)
               .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid")))
    n = len(cols)
    dim = None
    label = None
    for i, (name, (col, _, _)) in enumerate(DISTRIBUTIONS.items()):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))     # only column i grouped
        dim = F.when(F.col("gid") == gid, F.lit(name)) if dim is None else dim.when(F.col("gid") == gid, F.lit(name))
        label = (F.when(F.col("gid") == gid, F.col(col)) if label is None
                 else label.when(F.col("gid") == gid, F.col(col)))
    long = grouped.select(dim.alias("dimension"), label.alias("label"), "count")
    drop_null = [name for name, (_, _, d) in DISTRIBUTIONS.items() if d]
    long = long.filter(~(F.col("dimension").isin(*drop_null) & F.col("label").isNull()))
    by_count = Window.partitionBy("dimension").orderBy(F.desc("count"), F.asc_nulls_last("label"))
    position = None
    for name, (_, order, _) in DISTRIBUTIONS.items():
        expr = C.ordinal("label", order) if order else F.row_number().over(by_count)
        position = (F.when(F.col("dimension") == name, expr) if position is None
                    else position.when(F.col("dimension") == name, expr))
    return long.withColumn("position", position.cast("int"))


def distribution_shares(distributions: DataFrame) -> DataFrame:
    """Percentage of each label within its dimension (count / sum over the dimension)."""
    total = F.sum("count").over(Window.partitionBy("dimension"))
    return distributions.withColumn("percentage", percent(F.col("count"), total))


def one_distribution(locations: DataFrame, dimension: str) -> DataFrame:
    """A03..A07 individually: (label, count) in the reference's order."""
    col, order, drop_null = DISTRIBUTIONS[dimension]
    out = locations.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    if drop_null:
        out = out.filter(F.col("label").isNotNull())
    if order:
        return out.orderBy(C.ordinal("label", order))
    return out.orderBy(F.desc("count"), "label")
