"""Nearest polygon for points outside all polygons (J09): ring search over the cells of polygon edges.

A round looks at the 3 x 3 cells around each point that has no answer yet: an equi-join of the point's cell
with the edges of its neighbourhood. The best distance found is final if it is below the distance from the
point to the rim of those nine cells, since whatever is nearer lies inside them; other points go on to cells of four
times the side. So a point that is d away is compared with edges at most about 12 d away, there is no
cross join, and each round carries only the points that are left. Distances are planar, in degrees;
of polygons equally near the lowest id wins. A point on an edge is outside (as ST_Contains says) and 0 away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import ensure_checkpoint_dir

DEFAULT_CELL_SIZE = 0.01
_STEP = 2            # a round's cells have 2**_STEP times the side of the last round's
_WORLD = 1440.0      # cells of this side: nine of them hold every edge around every point
_EPS = 1.0e-9


def edge_cells(polygons: DataFrame, id_col: str, cell_size: float) -> DataFrame:
    """(pid, x1, y1, x2, y2, cell_y, cell_x): every edge in each cell that it passes."""
    c = F.lit(float(cell_size))
    edges = polygons.filter(F.col("geom").isNotNull()).select(F.col(id_col).cast("long").alias("pid"), F.explode(G.edges("geom")).alias("e")).select("pid", "e.*")
    rows = edges.withColumn("cell_y", F.explode(F.sequence(F.floor(F.least("y1", "y2") / c), F.floor(F.greatest("y1", "y2") / c))))

    def x_at(y: Column) -> Column:
        t = F.least(F.greatest(F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")), F.lit(0.0)), F.lit(1.0))
        return F.col("x1") + t * (F.col("x2") - F.col("x1"))

    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(x_at(F.col("cell_y") * c))
    b = F.when(flat, F.col("x2")).otherwise(x_at((F.col("cell_y") + 1) * c))
    return rows.withColumn("cell_x", F.explode(F.sequence(F.floor((F.least(a, b) - _EPS) / c), F.floor((F.greatest(a, b) + _EPS) / c))))


def squared_distance(px: Column, py: Column) -> Column:
    """Squared distance from (px, py) to the edge of the row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.coalesce(F.try_divide((px - F.col("x1")) * dx + (py - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (F.col("x1") + t * dx), py - (F.col("y1") + t * dy)
    return ex * ex + ey * ey


def nearest_polygon(points: DataFrame, polygons: DataFrame, id_col: str, key: str = "id", x: str = "longitude", y: str = "latitude",
                    cell_size: float = DEFAULT_CELL_SIZE) -> DataFrame:
    """(key, nearest_id, distance) of every point with coordinates; no rows without polygons. ``key`` names a point."""
    ensure_checkpoint_dir(points.sparkSession)
    cells = edge_cells(polygons, id_col, cell_size).checkpoint(eager=True)     # polygon-derived
    left = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("px"), F.col(y).alias("py"))
    left = left.checkpoint(eager=True)
    done, k = [], 0
    some = not cells.isEmpty()
    while some and not left.isEmpty():
        side = cell_size * 2 ** k
        last = side >= _WORLD
        c = F.lit(float(side))
        near = (cells.select("pid", "x1", "y1", "x2", "y2", F.shiftright("cell_y", k).alias("cy"), F.shiftright("cell_x", k).alias("cx")).distinct()
                .withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))))
        placed = left.withColumn("cy", F.floor(F.col("py") / c)).withColumn("cx", F.floor(F.col("px") / c))
        met = placed.join(near, ["cy", "cx"]).withColumn("d", squared_distance(F.col("px"), F.col("py")))
        best = met.groupBy("key", "px", "py").agg(F.min(F.struct("d", "pid")).alias("best"))
        found = left.join(best, ["key", "px", "py"], "left")
        rim = F.least(*[F.abs(v - (F.floor(v / c) + s) * c) for v in (F.col("px"), F.col("py")) for s in (-1, 2)]) - _EPS
        proven = F.col("best").isNotNull() & (F.lit(last) | (F.sqrt("best.d") < rim))
        found = found.withColumn("proven", proven).checkpoint(eager=True)
        done.append(found.filter("proven").select("key", F.col("best.pid").alias("nearest_id"), F.sqrt("best.d").alias("distance")))
        left = found.filter("not proven").select("key", "px", "py")
        if last:
            break
        k += _STEP
    if not done:
        return left.limit(0).select(F.col("key").alias(key), F.lit(None).cast("long").alias("nearest_id"), F.lit(None).cast("double").alias("distance"))
    return reduce(DataFrame.unionByName, done).withColumnRenamed("key", key)
