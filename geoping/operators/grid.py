"""Grid heatmap (A01, A24, P08) with a mergeable state (ST05).

Cells are keyed by integer indexes ``floor(lat/g), floor(lon/g)``; the double
corner coordinates are derived after the aggregation only (grouping on
``floor(x/g)*g`` doubles carries float noise).

Exact distinct devices are not mergeable from per-cell counts, so the state is
one row per (cell, device) with decimal sums and counts. The heatmap is always
``grid_from_state(grid_state(...))``: a full recompute and an incremental merge
of new batches into the stored state give identical cells. Both aggregations
combine map-side before their shuffle, so a hot cell costs one partial row per
task, not its raw pings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import classify as C
from ..functions.numeric import DECIMAL_TYPE, mean_from
from ..session import ensure_checkpoint_dir

MEASURES = ["battery", "signal", "altitude", "speed"]


def grid_state(locations: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE, by: list[str] | None = None) -> DataFrame:
    """Per (cell_y, cell_x, device_id) and the columns ``by``: n, decimal sums and non-null counts of the measures."""
    g = float(grid_size)
    return (locations
            .groupBy(C.grid_index("latitude", g).alias("cell_y"), C.grid_index("longitude", g).alias("cell_x"),
                     F.col("device_id"), *(by or []))
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(F.col(m).cast(DECIMAL_TYPE)).alias(f"sum_{m}") for m in MEASURES],
                 *[F.count(m).alias(f"cnt_{m}") for m in MEASURES]))


def merge_grid_state(*states: DataFrame) -> DataFrame:
    """ST05: merge state tables (e.g. stored state + a new batch's state)."""
    u = states[0]
    for s in states[1:]:
        u = u.unionByName(s)
    return (u.groupBy("cell_y", "cell_x", "device_id")
            .agg(F.sum("n").alias("n"),
                 *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES],
                 *[F.sum(f"cnt_{m}").alias(f"cnt_{m}") for m in MEASURES]))


def grid_from_state(state: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE, digits: int | None = 2,
                    with_geometry: bool = True) -> DataFrame:
    """Cells from a state table: point_count, unique_devices, 2-dp averages, cell polygon, grid_size."""
    g = float(grid_size)
    cells = (state.groupBy("cell_y", "cell_x")
             .agg(F.sum("n").alias("point_count"), F.count("device_id").alias("unique_devices"),
                  *[F.sum(f"sum_{m}").alias(f"sum_{m}") for m in MEASURES],
                  *[F.sum(f"cnt_{m}").alias(f"cnt_{m}") for m in MEASURES]))
    lat_grid = F.col("cell_y") * F.lit(g)
    lon_grid = F.col("cell_x") * F.lit(g)

    def avg(m):
        v = mean_from(F.col(f"sum_{m}"), F.col(f"cnt_{m}"))
        return F.round(v, digits) if digits is not None else v

    cols = [lat_grid.alias("lat_grid"), lon_grid.alias("lon_grid"), "cell_y", "cell_x",
            "point_count", "unique_devices", *[avg(m).alias(f"avg_{m}") for m in MEASURES]]
    if with_geometry:
        cols.append(C.ewkt_cell(lon_grid, lat_grid, g).alias("cell_geom"))
    cols.append(F.lit(g).alias("grid_size"))
    return cells.select(*cols)


def grid_heatmap(locations: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE, digits: int | None = 2,
                 approx_devices: bool = False) -> DataFrame:
    """Per cell count, distinct devices, averages of battery/signal/altitude/speed.

    ``approx_devices=True`` uses one aggregation with ``approx_count_distinct``
    (HyperLogLog++) instead of the exact two-level plan.
    """
    if not approx_devices:
        return grid_from_state(grid_state(locations, grid_size), grid_size, digits)
    g = float(grid_size)
    cells = (locations.groupBy(C.grid_index("latitude", g).alias("cell_y"),
                               C.grid_index("longitude", g).alias("cell_x"))
             .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("device_id").alias("unique_devices"),
                  *[F.sum(F.col(m).cast(DECIMAL_TYPE)).alias(f"sum_{m}") for m in MEASURES],
                  *[F.count(m).alias(f"cnt_{m}") for m in MEASURES]))
    lat_grid, lon_grid = F.col("cell_y") * F.lit(g), F.col("cell_x") * F.lit(g)
    return cells.select(
        lat_grid.alias("lat_grid"), lon_grid.alias("lon_grid"), "cell_y", "cell_x",
        F.col("n").alias("point_count"), "unique_devices",
        *[(F.round(mean_from(F.col(f"sum_{m}"), F.col(f"cnt_{m}")), digits) if digits is not None
           else mean_from(F.col(f"sum_{m}"), F.col(f"cnt_{m}"))).alias(f"avg_{m}") for m in MEASURES],
        C.ewkt_cell(lon_grid, lat_grid, g).alias("cell_geom"), F.lit(g).alias("grid_size"))


def heatmap_request(locations: DataFrame, min_lat: float | None = None, max_lat: float | None = None,
                    min_lon: float | None = None, max_lon: float | None = None,
                    network_type: str | None = None, sim_operator: str | None = None,
                    grid_size: float = S.DEFAULT_GRID_SIZE, digits: int | None = 2) -> DataFrame:
    """P08 + A01: optional bbox / network / operator predicates, then the heatmap.

    ``grid_size`` must lie in [0.001, 0.1] as in the request model.
    """
    if not 0.001 <= grid_size <= 0.1:
        raise ValueError("grid_size must be between 0.001 and 0.1")
    df = locations
    if min_lat is not None:
        df = df.filter(F.col("latitude") >= min_lat)
    if max_lat is not None:
        df = df.filter(F.col("latitude") <= max_lat)
    if min_lon is not None:
        df = df.filter(F.col("longitude") >= min_lon)
    if max_lon is not None:
        df = df.filter(F.col("longitude") <= max_lon)
    if network_type is not None:
        df = df.filter(F.col("network_type") == network_type)
    if sim_operator is not None:
        df = df.filter(F.col("sim_operator") == sim_operator)
    return grid_heatmap(df, grid_size, digits)


def grid_label_maps(locations: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE) -> DataFrame:
    """Per cell, network and operator count maps (label -> count)."""
    g = float(grid_size)
    # one aggregate per (cell, network, operator), materialised once; both maps read it
    level = (locations.groupBy(C.grid_index("latitude", g).alias("cell_y"),
                               C.grid_index("longitude", g).alias("cell_x"), "network_type", "sim_operator")
             .agg(F.count(F.lit(1)).alias("n")))
    ensure_checkpoint_dir(locations.sparkSession)
    level = level.checkpoint(eager=True)

    def label_map(col, out):
        return (level.groupBy("cell_y", "cell_x", col).agg(F.sum("n").alias("count"))
                .groupBy("cell_y", "cell_x")
                .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, "count")))).alias(out)))

    return label_map("network_type", "network_distribution").join(
        label_map("sim_operator", "operator_distribution"), ["cell_y", "cell_x"], "full")


def grid_cells_with_labels(locations: DataFrame, grid_size: float = S.DEFAULT_GRID_SIZE,
                           digits: int | None = 2) -> DataFrame:
    """The grid cell response -- A01 cell measures plus network and operator count maps."""
    cells = grid_heatmap(locations, grid_size, digits).select(
        "cell_y", "cell_x", "lat_grid", "lon_grid", "point_count", "unique_devices", "avg_battery", "avg_signal")
    return cells.join(grid_label_maps(locations, grid_size), ["cell_y", "cell_x"], "left")
