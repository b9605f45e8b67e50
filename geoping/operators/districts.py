"""District / province statistics over the spatial join.

The reference answers "statistics of all districts" with 1 + 2N queries; here
it is one spatial join, one aggregation (map-side partial, so a hot district
costs one partial row per task) and a LEFT join from the small polygon table so
districts without points keep a row with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import geometry as G
from ..functions.numeric import DECIMAL_TYPE, mean_from, null_if_falsy, percent, safe_divide
from . import spatial as SP
from ..session import ensure_checkpoint_dir


def polygon_measures(polys: DataFrame, id_col: str) -> DataFrame:
    """F21, F22, F28, F29 per polygon."""
    return polys.select(
        F.col(id_col), G.area_deg2("geom").alias("area_deg2"), G.area_km2("geom").alias("area_km2"),
        G.perimeter_km("geom").alias("perimeter_km"),
        G.centroid("geom")["x"].alias("centroid_x"), G.centroid("geom")["y"].alias("centroid_y"))


def polygon_totals(polys: DataFrame) -> DataFrame:
    """Number of polygons and the sum of their areas (km², 2 dp each)."""
    return polys.agg(F.count(F.lit(1)).alias("polygons"),
                     F.sum(G.area_km2("geom").cast(DECIMAL_TYPE)).cast("double").alias("total_area_km2"))


def _per_polygon(locations: DataFrame, index: SP.SpatialIndex, layer: str) -> DataFrame:
    m = SP.match_all(locations.select("id", "device_id", "battery", "signal", "speed", "latitude", "longitude"),
                     index, layer, id_name="__pid")
    return (m.groupBy("__pid")
            .agg(F.count(F.lit(1)).alias("total_locations"), F.countDistinct("device_id").alias("unique_devices"),
                 *[F.sum(F.col(c).cast(DECIMAL_TYPE)).alias(f"sum_{c}") for c in ("battery", "signal", "speed")],
                 *[F.count(c).alias(f"cnt_{c}") for c in ("battery", "signal", "speed")]))


def _small_side(per_polygon: DataFrame, polygons: DataFrame) -> DataFrame:
    """A per-polygon aggregate has at most one row per polygon: broadcast it when the polygon table is small."""
    return F.broadcast(per_polygon) if polygons.count() <= SP.DEFAULT_BROADCAST_MAX_ROWS else per_polygon


def district_statistics(locations: DataFrame, districts: DataFrame, index: SP.SpatialIndex | None = None,
                        layer: str = "district", digits: int = 2) -> DataFrame:
    """Every district with its point statistics (districts without points -> 0 / null).

    Uses the live geometry (a point in two overlapping districts counts in both).
    Averages are rounded HALF_UP to 2 dp; 0 or null -> null as in the reference.
    """
    index = index or SP.build_index([(layer, districts, "district_id")])
    agg = _per_polygon(locations, index, layer)
    base = districts.select("district_id", "district_number", "district_name",
                            G.area_km2("geom").alias("area_km2"), G.perimeter_km("geom").alias("perimeter_km"))
    out = base.join(_small_side(agg, districts), base["district_id"] == agg["__pid"], "left")

    def avg(c):
        return null_if_falsy(F.round(mean_from(F.col(f"sum_{c}"), F.col(f"cnt_{c}")), digits))

    return out.select(
        "district_id", "district_number", "district_name", "area_km2", "perimeter_km",
        F.coalesce("total_locations", F.lit(0)).alias("total_locations"),
        F.coalesce("unique_devices", F.lit(0)).alias("unique_devices"),
        avg("battery").alias("avg_battery"), avg("signal").alias("avg_signal"), avg("speed").alias("avg_speed"))


def district_statistics_for(locations: DataFrame, districts: DataFrame, index: SP.SpatialIndex,
                            district_number: int, layer: str = "district", digits: int = 2) -> DataFrame:
    """Statistics of one district, reading only the points in its cells (bbox pushed to the scan).

    Unknown district number -> no row.
    """
    ids = [r["district_id"] for r in districts.filter(F.col("district_number") == F.lit(district_number))
           .select("district_id").limit(1).collect()]
    if not ids:
        return district_statistics(locations.limit(0), districts.limit(0), index, layer, digits)
    inside = SP.points_in_polygon(locations, index, layer, ids[0])
    agg = inside.agg(F.count(F.lit(1)).alias("total_locations"), F.countDistinct("device_id").alias("unique_devices"),
                     *[F.sum(F.col(c).cast(DECIMAL_TYPE)).alias(f"sum_{c}") for c in ("battery", "signal", "speed")],
                     *[F.count(c).alias(f"cnt_{c}") for c in ("battery", "signal", "speed")])
    d = (districts.filter(F.col("district_id") == F.lit(ids[0]))
         .select(F.col("district_id").cast("long").alias("district_id"), "district_number", "district_name",
                 G.area_km2("geom").alias("area_km2"), G.perimeter_km("geom").alias("perimeter_km"))
         .collect()[0])

    def avg(c):
        return null_if_falsy(F.round(mean_from(F.col(f"sum_{c}"), F.col(f"cnt_{c}")), digits))

    # the district's attributes are one row: carried as literals next to the one-row aggregate
    return agg.select(
        F.lit(d["district_id"]).cast("long").alias("district_id"),
        F.lit(d["district_number"]).cast(districts.schema["district_number"].dataType).alias("district_number"),
        F.lit(d["district_name"]).cast("string").alias("district_name"),
        F.lit(d["area_km2"]).cast("double").alias("area_km2"), F.lit(d["perimeter_km"]).cast("double").alias("perimeter_km"),
        "total_locations", "unique_devices", avg("battery").alias("avg_battery"),
        avg("signal").alias("avg_signal"), avg("speed").alias("avg_speed"))


def district_density(stats: DataFrame) -> DataFrame:
    """Locations per km² for districts with area > 0, densest first."""
    return (stats.filter(F.col("area_km2") > 0)
            .select("district_number", "district_name", "total_locations", "area_km2",
                    safe_divide("total_locations", "area_km2").alias("density"))
            .orderBy(F.desc("density"), "district_number"))


def density_summary(stats: DataFrame, expected_districts: int | None = None) -> DataFrame:
    """Totals, overall density and the number of districts with data."""
    out = stats.agg(
        F.sum("total_locations").alias("total_locations"),
        F.sum(F.col("area_km2").cast(DECIMAL_TYPE)).cast("double").alias("total_area_km2"),
        F.count_if(F.col("total_locations") > 0).alias("districts_with_data"),
        F.count(F.lit(1)).alias("districts"))
    out = out.withColumn("mean_density", F.coalesce(safe_divide("total_locations", "total_area_km2"), F.lit(0.0)))
    if expected_districts is not None:
        out = out.withColumn("expected_districts", F.lit(expected_districts))
    return out


def assignment_coverage(assigned: DataFrame) -> DataFrame:
    """Total, with district / province (count and %), outside every district."""
    return (assigned.agg(F.count(F.lit(1)).alias("total"),
                         F.count("district_id").alias("with_district"),
                         F.count("province_id").alias("with_province"))
            .withColumn("pct_district", percent("with_district", "total"))
            .withColumn("pct_province", percent("with_province", "total"))
            .withColumn("outside", F.col("total") - F.col("with_district")))


def top_polygons(assigned: DataFrame, name_col: str = "district_name", n: int = 10, digits: int = 2) -> DataFrame:
    """Points per district (or province) name with average battery and signal, top ``n`` by count."""
    out = (assigned.filter(F.col(name_col).isNotNull())
           .groupBy(name_col)
           .agg(F.count(F.lit(1)).alias("points"),
                F.round(mean_from(F.sum(F.col("battery").cast(DECIMAL_TYPE)), F.count("battery")), digits)
                .alias("avg_battery"),
                F.round(mean_from(F.sum(F.col("signal").cast(DECIMAL_TYPE)), F.count("signal")), digits)
                .alias("avg_signal")))
    return out.orderBy(F.desc("points"), name_col).limit(n)


def points_by_district(points: DataFrame, index: SP.SpatialIndex, districts: DataFrame,
                       layer: str = "district", name_col: str = "name") -> DataFrame:
    """Each point with its district name or 'Fuera de distritos', plus the per-district count.

    Flat rows (no list of names collected per district, whose size grows with
    the data); the per-district count comes from a partial aggregation joined back.
    """
    located = SP.locate(points, index)
    names = districts.select(F.col("district_id").cast("long").alias(f"{layer}_id"),
                             F.col("district_name").alias("__dn"))
    located = SP._attach(located, names, f"{layer}_id")
    labelled = located.withColumn("district_label", F.coalesce("__dn", F.lit(S.OUTSIDE_DISTRICTS))).drop("__dn")
    counts = labelled.groupBy("district_label").agg(F.count(F.lit(1)).alias("points_in_district"))
    # one row per district label: bounded by the (measured) polygon table size
    small = districts.count() + 1 <= SP.DEFAULT_BROADCAST_MAX_ROWS
    return labelled.join(F.broadcast(counts) if small else counts, "district_label")


def district_profile(locations: DataFrame, districts: DataFrame, index: SP.SpatialIndex, layer: str = "district",
                     digits: int = 2) -> DataFrame:
    """District statistics with density, average altitude and network / operator count maps.

    One spatial join feeds one pre-aggregate per (district, device, network,
    operator), checkpointed; totals, distinct devices and both label maps come
    from it, so the points are joined and shuffled once.
    """
    m = SP.match_all(locations.select("id", "device_id", "battery", "signal", "speed", "altitude", "network_type",
                                      "sim_operator", "latitude", "longitude"), index, layer, id_name="__pid")
    measures = ("battery", "signal", "speed", "altitude")
    level = (m.groupBy("__pid", "device_id", "network_type", "sim_operator")
             .agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(F.col(c).cast(DECIMAL_TYPE)).alias(f"sum_{c}") for c in measures],
                  *[F.count(c).alias(f"cnt_{c}") for c in measures]))
    # aggregated and read three times: materialise once so the spatial join runs once
    ensure_checkpoint_dir(locations.sparkSession)
    level = level.checkpoint(eager=True)
    agg = (level.groupBy("__pid")
           .agg(F.sum("__n").alias("total_locations"), F.countDistinct("device_id").alias("unique_devices"),
                *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in measures],
                *[F.sum(f"cnt_{c}").alias(f"cnt_{c}") for c in measures]))

    def label_map(col, out):
        return (level.groupBy("__pid", col).agg(F.sum("__n").alias("__v"))
                .groupBy("__pid")
                .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(col), F.col("__v"))))).alias(out)))

    base = districts.select("district_id", "district_number", "district_name", G.area_km2("geom").alias("area_km2"))
    out = (base.join(_small_side(agg, districts), base["district_id"] == agg["__pid"], "left").drop("__pid")
           .join(_small_side(label_map("network_type", "network_distribution"), districts),
                 F.col("district_id") == F.col("__pid"), "left").drop("__pid")
           .join(_small_side(label_map("sim_operator", "operator_distribution"), districts),
                 F.col("district_id") == F.col("__pid"), "left").drop("__pid"))

    def avg(c):
        return F.round(mean_from(F.col(f"sum_{c}"), F.col(f"cnt_{c}")), digits)

    return out.select(
        "district_id", "district_number", "district_name", "area_km2",
        F.coalesce("total_locations", F.lit(0)).alias("total_locations"),
        F.coalesce("unique_devices", F.lit(0)).alias("unique_devices"),
        avg("battery").alias("avg_battery"), avg("signal").alias("avg_signal"), avg("speed").alias("avg_speed"),
        avg("altitude").alias("avg_altitude"),
        F.when(F.col("area_km2") > 0, safe_divide(F.coalesce("total_locations", F.lit(0)), "area_km2"))
        .alias("density"),
        "network_distribution", "operator_distribution")


def repeatable_sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows chosen by the MD5 of key and seed (repeatable in any engine, no driver-side sampling)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def sample_by_district(points: DataFrame, index: SP.SpatialIndex, districts: DataFrame, n: int = 500,
                       seed: int = 42) -> DataFrame:
    """Found / not-found and points per district over a repeatable sample of points."""
    sample = repeatable_sample(points.select("id", "latitude", "longitude"), n, seed)
    located = SP.locate(sample, index)
    names = districts.select(F.col("district_id").cast("long").alias("district_id"), "district_name")
    located = SP._attach(located, names, "district_id")
    return (located.groupBy(F.coalesce("district_name", F.lit(S.OUTSIDE_DISTRICTS)).alias("district_label"))
            .agg(F.count(F.lit(1)).alias("points")))
