"""Point-in-polygon joins (J01-J05, J08, J10, J11) as a cell-cover equi-join.

Catalyst sees ``contains(polygon, point)`` as an opaque theta condition and
would plan a nested-loop join over (points x polygons). Instead:

1. **Cell cover** (built once from the polygon tables, which are
   dimension-sized): every polygon's bounding box is cut into square cells keyed
   by integer indexes ``floor(y/c), floor(x/c)``. Each polygon gets its own level
   ``c = cell_size * 2**k``: the finest whose cover has at most
   ``max_cells_per_polygon`` cells, so one huge polygon does not coarsen the small
   ones; a total guard (``max_cells``) coarsens the base size when needed. There
   is one cover per level in use (usually one or two).
2. Cells that no edge touches are classified once (inside -> ``full``, outside ->
   dropped) from the row's crossing list at the cell centre; only boundary
   cells carry edges, and only the edges of their row band that are not
   entirely left of the cell (the +x ray can cross no other edge).
   All band/cell filters use the same integer floor indexes as the points,
   so no float epsilon is needed.
3. The cover is grouped to **one row per cell** holding an array of candidate
   polygons of every layer (e.g. districts and provinces together).
4. Points join each level's cover on ``(cell_y, cell_x)`` -- a broadcast hash
   join when the measured cover size is under ``broadcast_max_edges``, otherwise
   a shuffle join with hot cells salted (and AQE skew handling); the candidate
   arrays of the levels are concatenated. The exact test is an
   even-odd ``aggregate`` over the candidate's edges plus an on-edge exclusion
   (boundary points are outside, like ST_Contains); overlap resolves to the
   lowest polygon id with ``array_min``. No explode and no re-grouping of points:
   one output row per input point, in the point's own partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import geometry as G
from ..session import ensure_checkpoint_dir

DEFAULT_CELL_SIZE = 0.01
DEFAULT_MAX_CELLS = 4_000_000                 # all levels together
DEFAULT_MAX_CELLS_PER_POLYGON = 65_536        # finest level per polygon: at most 256 x 256 cells
BROADCAST_MAX_BYTES = 64 << 20
DEFAULT_BROADCAST_MAX_EDGES = 1_000_000      # edge references in a broadcast cover (~32 B each: ~50 MB)
DEFAULT_BROADCAST_MAX_ROWS = 1_000_000        # polygon attribute rows broadcast for name lookups
DEFAULT_HOT_ROWS = 5_000_000                  # shuffle mode: points per cell handled by one task before salting
HOT_CELLS_BROADCAST_MAX = 1_000_000
_CELL_LEVELS = 24                              # cell_size * 2**k, k < 24
_CAND = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("pid", T.LongType()),
                      T.StructField("full", T.BooleanType()), T.StructField("edges", T.ArrayType(S.EDGE))])


@dataclass
class CoverLevel:
    """The cover of the polygons assigned to one cell size."""
    cell_size: float
    cover: DataFrame            # cell_y, cell_x, cands: array<struct<layer,pid,full,edges>>
    n_cells: int
    n_edge_refs: int
    broadcast: bool


@dataclass
class SpatialIndex:
    """Cell covers (one per level in use) over one or more polygon layers."""
    levels: list[CoverLevel]
    layers: list[str]
    hot_rows: int = DEFAULT_HOT_ROWS     # shuffle mode: cells with more points are salted

    @property
    def cell_size(self) -> float:
        return min(lv.cell_size for lv in self.levels) if self.levels else DEFAULT_CELL_SIZE

    @property
    def n_cells(self) -> int:
        return sum(lv.n_cells for lv in self.levels)

    @property
    def n_edge_refs(self) -> int:
        return sum(lv.n_edge_refs for lv in self.levels)

    @property
    def broadcast(self) -> bool:
        return all(lv.broadcast for lv in self.levels)


def _polygon_layer(polys: DataFrame, id_col: str, layer: int) -> DataFrame:
    return polys.select(F.lit(layer).alias("layer"), F.col(id_col).cast("long").alias("pid"), "geom")


def _cells_at(k: Column, base: float) -> Column:
    c = F.lit(float(base)) * F.pow(F.lit(2.0), k.cast("double"))
    return ((F.floor(F.col("b.maxy") / c) - F.floor(F.col("b.miny") / c) + 1)
            * (F.floor(F.col("b.maxx") / c) - F.floor(F.col("b.minx") / c) + 1)).cast("double")


def _assign_levels(boxed: DataFrame, cell_size: float, per_polygon: int,
                   max_cells: int) -> tuple[float, DataFrame, list[int]]:
    """Per polygon the finest level ``k`` whose bbox cover has at most ``per_polygon`` cells.

    One small aggregate returns the total cover size and the distinct levels; if
    the total exceeds ``max_cells`` the base cell size doubles and it is tried
    again. Returns (base cell size, polygons with ``k``, levels in use).
    """
    base = float(cell_size)
    for _ in range(_CELL_LEVELS):
        ks = F.sequence(F.lit(0), F.lit(_CELL_LEVELS - 1))
        k = F.coalesce(F.array_min(F.filter(ks, lambda kk: _cells_at(kk, base) <= F.lit(float(per_polygon)))),
                       F.lit(_CELL_LEVELS - 1))
        leveled = boxed.withColumn("k", k)
        row = leveled.agg(F.sum(_cells_at(F.col("k"), base)).alias("t"),
                          F.collect_set("k").alias("ks")).collect()[0]      # at most 24 levels
        if (row["t"] or 0.0) <= max_cells or base >= 360.0:
            return base, leveled, sorted(row["ks"] or [])
        base *= 2
    return base, leveled, sorted(row["ks"] or [])


def build_index(layers: list[tuple[str, DataFrame, str]], cell_size: float = DEFAULT_CELL_SIZE,
                max_cells: int = DEFAULT_MAX_CELLS, broadcast_max_edges: int = DEFAULT_BROADCAST_MAX_EDGES,
                force_broadcast: bool | None = None, hot_rows: int = DEFAULT_HOT_ROWS,
                max_cells_per_polygon: int = DEFAULT_MAX_CELLS_PER_POLYGON) -> SpatialIndex:
    """Build the cell cover for ``layers``: list of (name, polygon frame, id column with a ``geom`` column).

    The cover is built from what the polygon tables hold now; callers that join several
    times keep the index.
    """
    return _build_index(layers, cell_size, max_cells, broadcast_max_edges, force_broadcast,
                        min(max_cells_per_polygon, max_cells), hot_rows)


def _build_index(layers, cell_size, max_cells, broadcast_max_edges, force_broadcast,
                 per_polygon, hot_rows) -> SpatialIndex:
    names = [n for n, _, _ in layers]
    polys = None
    for i, (_, df, id_col) in enumerate(layers):
        p = _polygon_layer(df, id_col, i)
        polys = p if polys is None else polys.unionByName(p)
    polys = polys.filter(F.col("geom").isNotNull() & (F.size("geom") > 0))
    boxed = polys.select("layer", "pid", G.bbox("geom").alias("b"), G.edges("geom").alias("edges"))
    # polygon prep is read by every branch below: materialise it once (small, polygon-sized)
    ensure_checkpoint_dir(boxed.sparkSession)
    boxed = boxed.checkpoint(eager=True)
    base, boxed, ks = _assign_levels(boxed, cell_size, per_polygon, max_cells)
    levels = []
    for k in ks:
        c = base * (2 ** k)
        cover = _build_cover(boxed.filter(F.col("k") == k).drop("k"), c)
        stats = cover.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.aggregate("cands", F.lit(0), lambda a, x: a + F.size(x["edges"]))).alias("m")
                          ).collect()[0]
        n_cells, n_refs = int(stats["n"] or 0), int(stats["m"] or 0)
        # a cover row is about 80 bytes, an edge in it 48
        small = n_refs <= broadcast_max_edges and 80 * n_cells + 48 * n_refs <= BROADCAST_MAX_BYTES
        bc = small if force_broadcast is None else force_broadcast
        levels.append(CoverLevel(cell_size=c, cover=cover, n_cells=n_cells, n_edge_refs=n_refs, broadcast=bc))
    return SpatialIndex(levels=levels, layers=names, hot_rows=hot_rows)


def _build_cover(boxed: DataFrame, c: float) -> DataFrame:
    """Cover rows (cell_y, cell_x, cands) of the polygons in ``boxed`` at cell size ``c``; checkpointed."""
    lit_c = F.lit(c)

    def idx(v: Column) -> Column:
        return F.floor(v / lit_c)

    # One row per (polygon, row band of cells). Everything per band is computed with
    # higher-order functions on the polygon's own edge array, so the whole build is one
    # explode pass and a single shuffle (the final group by cell).
    rows = boxed.select("layer", "pid", "edges", idx(F.col("b.minx")).alias("cx0"), idx(F.col("b.maxx")).alias("cx1"),
                        F.explode(F.sequence(idx(F.col("b.miny")), idx(F.col("b.maxy")))).alias("cell_y"))
    cy = F.col("cell_y")
    y_lo, y_hi, yc = cy * lit_c, (cy + F.lit(1)) * lit_c, (cy + F.lit(0.5)) * lit_c

    def ymin(e):
        return F.least(e["y1"], e["y2"])

    def ymax(e):
        return F.greatest(e["y1"], e["y2"])

    # edges whose y-span reaches this row (same floor index as the points use)
    band = F.filter("edges", lambda e: (idx(ymin(e)) <= cy) & (idx(ymax(e)) >= cy))

    def x_at(e, yv):
        t = F.least(F.greatest(F.try_divide(yv - e["y1"], e["y2"] - e["y1"]), F.lit(0.0)), F.lit(1.0))
        return e["x1"] + t * (e["x2"] - e["x1"])

    def x_cells(e):
        # x cells the edge occupies inside this row band, clipped, with a one-cell safety margin
        horizontal = e["y1"] == e["y2"]
        xa, xb = x_at(e, y_lo), x_at(e, y_hi)
        lo = F.when(horizontal, idx(F.least(e["x1"], e["x2"]))).otherwise(
            F.greatest(idx(F.least(e["x1"], e["x2"])), idx(F.least(xa, xb)) - 1))
        hi = F.when(horizontal, idx(F.greatest(e["x1"], e["x2"]))).otherwise(
            F.least(idx(F.greatest(e["x1"], e["x2"])), idx(F.greatest(xa, xb)) + 1))
        return F.sequence(lo, F.greatest(lo, hi))

    crossings = F.transform(
        F.filter(band, lambda e: (e["y1"] != e["y2"]) & ((e["y1"] > yc) != (e["y2"] > yc))),
        lambda e: F.try_divide((e["x2"] - e["x1"]) * (yc - e["y1"]), e["y2"] - e["y1"]) + e["x1"])
    bands = rows.select("layer", "pid", "cell_y", "cx0", "cx1", band.alias("band"), crossings.alias("xs"))
    bands = bands.withColumn("touched", F.array_distinct(F.flatten(F.transform("band", x_cells))))

    cells = bands.select("layer", "pid", "cell_y", "band", "xs", "touched",
                         F.explode(F.sequence("cx0", "cx1")).alias("cell_x"))
    cx = F.col("cell_x")
    xc = (cx + F.lit(0.5)) * lit_c
    is_boundary = F.array_contains("touched", cx)
    inside = (F.size(F.filter("xs", lambda v: v > xc)) % 2) == 1
    cand = F.when(is_boundary, F.struct(
        F.col("layer"), F.col("pid"), F.lit(False).alias("full"),
        # the +x ray from a point of this cell can only cross edges not entirely left of it
        F.filter("band", lambda e: idx(F.greatest(e["x1"], e["x2"])) >= cx).alias("edges"))).when(
        inside, F.struct(F.col("layer"), F.col("pid"), F.lit(True).alias("full"),
                         F.array().cast(T.ArrayType(S.EDGE)).alias("edges")))
    located_cells = cells.select("cell_y", "cell_x", cand.alias("cand")).filter(F.col("cand").isNotNull())

    cover = (located_cells
             .groupBy("cell_y", "cell_x")
             .agg(F.collect_list("cand").alias("cands")))
    # The cover is reused (size check, then every join): materialise it once in the
    # shared checkpoint folder so its lineage is cut and it survives executor loss.
    return cover.checkpoint(eager=True)


def _candidates(points: DataFrame, index: SpatialIndex, x: str, y: str) -> DataFrame:
    """Points with ``cands``: the candidate arrays of every level's cover, concatenated.

    One join per level in use (broadcast joins stay narrow: one row per point, no shuffle).
    """
    out = points
    cols = []
    for i, lv in enumerate(index.levels):
        c = F.lit(lv.cell_size)
        cy, cx, cn = f"__cy{i}", f"__cx{i}", f"__cands{i}"
        keyed = out.withColumn(cy, F.floor(F.col(y) / c)).withColumn(cx, F.floor(F.col(x) / c))
        cover = lv.cover.select(F.col("cell_y").alias(cy), F.col("cell_x").alias(cx), F.col("cands").alias(cn))
        if lv.broadcast:
            out = keyed.join(F.broadcast(cover), [cy, cx], "left")
        else:
            out = _salted_join(keyed, cover, index.hot_rows, x, y, cy, cx)
        out = out.drop(cy, cx)
        cols.append(cn)
    if not cols:
        return out.withColumn("cands", F.lit(None).cast(T.ArrayType(_CAND)))
    merged = F.col(cols[0]) if len(cols) == 1 else F.flatten(F.array_compact(F.array(*[F.col(c) for c in cols])))
    return out.withColumn("cands", merged).drop(*cols)


def _salted_join(keyed: DataFrame, cover: DataFrame, hot_rows: int, x: str, y: str,
                 cy: str = "__cy", cx: str = "__cx") -> DataFrame:
    """Shuffle join on the cell with hot cells split over several tasks.

    A cell holding more than ``hot_rows`` points (a city centre, a parked device)
    is found by a pre-aggregated count of points per cell; its points get a salt
    ``row number % ceil(n / hot_rows)`` (so equal points are split as well) and only that
    cell's cover row is replicated once per salt. The hot-cell table has at most ``N / hot_rows``
    rows; it is broadcast only when its measured size is under a limit.
    """
    counts = keyed.groupBy(cy, cx).agg(F.count(F.lit(1)).alias("__n"))
    hot = (counts.filter(F.col("__n") > F.lit(hot_rows))
           .select(cy, cx, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__salts")))
    hot = hot.checkpoint(eager=True)
    n_hot = hot.count()
    if n_hot == 0:
        return keyed.join(cover, [cy, cx], "left")
    hot_side = F.broadcast(hot) if n_hot <= HOT_CELLS_BROADCAST_MAX else hot
    salted = (keyed.join(hot_side, [cy, cx], "left")
              .withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0))
                          .otherwise(F.pmod(F.monotonically_increasing_id(), F.col("__salts")).cast("int")))
              .drop("__salts"))
    cover_salted = (cover.join(hot_side, [cy, cx], "left")
                    .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
                    .drop("__salts"))
    return salted.join(cover_salted, [cy, cx, "__salt"], "left").drop("__salt")


def _hits(x: str, y: str) -> Column:
    px, py = F.col(x), F.col(y)
    return F.filter(F.col("cands"),
                    lambda cd: cd["full"] | G.point_in_edges(cd["edges"], px, py))


def locate(points: DataFrame, index: SpatialIndex, x: str = "longitude", y: str = "latitude",
           suffix: str = "_id") -> DataFrame:
    """Lowest containing polygon id per layer (``{layer}{suffix}``); null when none. One row per point."""
    joined = _candidates(points, index, x, y)
    hits = _hits(x, y)
    out = joined.withColumn("__hits", hits)
    for i, name in enumerate(index.layers):
        out = out.withColumn(f"{name}{suffix}", F.array_min(F.transform(
            F.filter("__hits", lambda h: h["layer"] == i), lambda h: h["pid"])))
    return out.drop("cands", "__hits")


def match_all(points: DataFrame, index: SpatialIndex, layer: str, x: str = "longitude", y: str = "latitude",
              id_name: str = "polygon_id") -> DataFrame:
    """Every (point, containing polygon) pair of one layer -- a point in two overlapping polygons counts in both."""
    li = index.layers.index(layer)
    joined = _candidates(points, index, x, y)
    hits = F.filter(_hits(x, y), lambda h: h["layer"] == li)
    return (joined.withColumn("__hit", F.explode(F.transform(hits, lambda h: h["pid"])))
            .drop("cands").withColumnRenamed("__hit", id_name))


def _attach(df: DataFrame, attrs: DataFrame, key: str, max_rows: int = DEFAULT_BROADCAST_MAX_ROWS) -> DataFrame:
    """Left join polygon attributes by id; broadcast only when the attribute table is measured small."""
    n = attrs.count()
    side = F.broadcast(attrs) if n <= max_rows else attrs
    return df.join(side, key, "left")


def assign_locations(locations: DataFrame, districts: DataFrame, provinces: DataFrame, mode: str = "both",
                     cell_size: float = DEFAULT_CELL_SIZE, index: SpatialIndex | None = None,
                     only_missing: bool = True) -> DataFrame:
    """J01 (mode 'both') / J02 (mode 'independent'): fill district and province of each location.

    'both' (the bulk UPDATE rule): a row gets a district *and* a province only when
    both polygons contain it; otherwise its values stay as they were.
    'independent': district and province are looked up separately.
    ``only_missing``: rows that already have both ids are kept unchanged (K05).
    """
    index = index or build_index([("district", districts, "district_id"), ("province", provinces, "province_id")],
                                 cell_size)
    base = locations
    for c in ("district_id", "district_name", "province_id", "province_name"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("long" if c.endswith("_id") else "string"))
    located = locate(base, index, suffix="__new")
    d_new, p_new = F.col("district__new"), F.col("province__new")
    if mode == "both":
        ok = d_new.isNotNull() & p_new.isNotNull()
        d_val, p_val = F.when(ok, d_new), F.when(ok, p_new)
    elif mode == "independent":
        d_val, p_val = d_new, p_new
    else:
        raise ValueError("mode must be 'both' or 'independent'")
    needs = (F.col("district_id").isNull() | F.col("province_id").isNull()) if only_missing else F.lit(True)
    located = (located.withColumn("__upd", needs & (d_val.isNotNull() | p_val.isNotNull()))
               .withColumn("__d", d_val).withColumn("__p", p_val))
    d_names = districts.select(F.col("district_id").cast("long").alias("__d"), F.col("district_name").alias("__dn"))
    p_names = provinces.select(F.col("province_id").cast("long").alias("__p"), F.col("province_name").alias("__pn"))
    located = _attach(_attach(located, d_names, "__d"), p_names, "__p")
    upd = F.col("__upd")
    cols = []
    for c in base.columns:
        if c == "district_id":
            cols.append(F.when(upd & F.col("__d").isNotNull(), F.col("__d")).otherwise(F.col(c)).alias(c))
        elif c == "district_name":
            cols.append(F.when(upd & F.col("__d").isNotNull(), F.col("__dn")).otherwise(F.col(c)).alias(c))
        elif c == "province_id":
            cols.append(F.when(upd & F.col("__p").isNotNull(), F.col("__p")).otherwise(F.col(c)).alias(c))
        elif c == "province_name":
            cols.append(F.when(upd & F.col("__p").isNotNull(), F.col("__pn")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return located.select(*cols)


def points_in_polygon(points: DataFrame, index: SpatialIndex, layer: str, polygon_id: int,
                      x: str = "longitude", y: str = "latitude") -> DataFrame:
    """J04/J05 base: the points contained in one polygon.

    Only that polygon's cells of the cover are kept, and the polygon's cell
    bounding box becomes plain range predicates on the point columns, which
    Catalyst pushes into the parquet scan (row groups outside are skipped).
    """
    li = index.layers.index(layer)
    mine = F.filter("cands", lambda cd: (cd["layer"] == li) & (cd["pid"] == F.lit(polygon_id)))
    for lv in index.levels:                    # a polygon lives in exactly one level
        sub = lv.cover.select("cell_y", "cell_x", mine.alias("cands")).filter(F.size("cands") > 0)
        box = sub.agg(F.min("cell_y").alias("y0"), F.max("cell_y").alias("y1"), F.min("cell_x").alias("x0"),
                      F.max("cell_x").alias("x1"), F.count(F.lit(1)).alias("n"),
                      F.sum(F.aggregate("cands", F.lit(0), lambda a, cd: a + F.size(cd["edges"]))).alias("m")
                      ).collect()[0]
        if not box["n"]:
            continue
        c = lv.cell_size
        # cell index floor(v / c) in [lo, hi]  <=>  lo*c <= v < (hi+1)*c up to rounding: widen by one cell
        pruned = points.filter((F.col(y) >= (box["y0"] - 1) * c) & (F.col(y) < (box["y1"] + 2) * c)
                               & (F.col(x) >= (box["x0"] - 1) * c) & (F.col(x) < (box["x1"] + 2) * c))
        small = box["n"] <= DEFAULT_MAX_CELLS and (box["m"] or 0) <= DEFAULT_BROADCAST_MAX_EDGES
        sub_index = SpatialIndex(levels=[CoverLevel(cell_size=c, cover=sub, n_cells=int(box["n"]),
                                                    n_edge_refs=int(box["m"] or 0), broadcast=small)],
                                 layers=index.layers, hot_rows=index.hot_rows)
        joined = _candidates(pruned, sub_index, x, y)
        return joined.filter(F.exists(_hits(x, y), lambda h: F.lit(True))).drop("cands")
    return points.limit(0)


def count_in_polygon(points: DataFrame, index: SpatialIndex, layer: str, polygon_id: int,
                     x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Number of points in one polygon (0 when the id is unknown), one-row frame."""
    return points_in_polygon(points, index, layer, polygon_id, x, y).agg(F.count(F.lit(1)).alias("total"))


def page_in_polygon(points: DataFrame, index: SpatialIndex, layer: str, polygon_id: int, limit: int = 1000,
                    offset: int = 0, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """A limit/offset page of the points in one polygon, ordered by id (1 <= limit <= 1000)."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be in 1..1000 and offset >= 0")
    df = points_in_polygon(points, index, layer, polygon_id, x, y).orderBy("id")
    if offset:
        df = df.offset(offset)
    return df.limit(limit)


def null_orphans(locations: DataFrame, polygons: DataFrame, fk: str, name_col: str | None = None) -> DataFrame:
    """Foreign keys that point to no polygon become null (ON DELETE SET NULL)."""
    ids = polygons.select(F.col(fk).cast("long").alias("__k")).distinct().withColumn("__ok", F.lit(True))
    out = _attach(locations.withColumn("__k", F.col(fk)), ids, "__k")
    out = out.withColumn(fk, F.when(F.col("__ok"), F.col(fk)))
    if name_col:
        out = out.withColumn(name_col, F.when(F.col("__ok"), F.col(name_col)))
    return out.drop("__k", "__ok")


def assign_nested_loop(points: DataFrame, polygons: DataFrame, id_col: str, x: str = "longitude",
                       y: str = "latitude", out_col: str = "polygon_id") -> DataFrame:
    """Simple mode (few polygons): broadcast polygon table, bbox range + exact test, lowest id.

    Used to cross-check the cell-cover join; plans a BroadcastNestedLoopJoin, so it
    is only for polygon tables of a handful of rows.
    """
    n = polygons.count()
    if n > 10_000:
        raise ValueError("nested-loop mode is for small polygon tables only")
    p = polygons.select(F.col(id_col).cast("long").alias("__pid"), G.bbox("geom").alias("__b"),
                        G.edges("geom").alias("__e"))
    cond = ((F.col(x) >= F.col("__b.minx")) & (F.col(x) <= F.col("__b.maxx"))
            & (F.col(y) >= F.col("__b.miny")) & (F.col(y) <= F.col("__b.maxy"))
            & G.point_in_edges(F.col("__e"), F.col(x), F.col(y)))
    hits = points.select("id", x, y).join(F.broadcast(p), cond, "inner").groupBy("id").agg(
        F.min("__pid").alias(out_col))
    return points.join(hits, "id", "left")


def lookup_point(spark, index: SpatialIndex, latitude: float, longitude: float,
                 names: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """The polygons of every layer containing one point (nulls when none), one row.

    ``names`` optionally maps a layer to (polygon frame, id column, name column) to
    add ``{layer}_name``. Runs the same ``locate`` as the bulk join.
    """
    point = spark.createDataFrame([(float(latitude), float(longitude))], "latitude double, longitude double")
    out = locate(point, index)
    for layer, (polys, id_col, name_col) in (names or {}).items():
        attrs = polys.select(F.col(id_col).cast("long").alias(f"{layer}_id"), F.col(name_col).alias(f"{layer}_name"))
        out = _attach(out, attrs, f"{layer}_id")
    return out
