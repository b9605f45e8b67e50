"""Faults of polygon rings (F23): edges that cross or touch, holes outside their shell.

Edges meet only where they pass the same cell: an equi-join of (polygon, cell), not all pairs. Cells are cut for each
polygon so that its edges spread over about as many cells as there are edges. Inside a cell the signs of
orientations decide: a proper crossing has both ends of each edge on different sides of the other; a touch is
an end that lies on another edge. Neighbours in a ring share their vertex, which is no touch; going back
over one's neighbour is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import ensure_checkpoint_dir

_EPS = 1.0e-9


def ring_edges(polygons: DataFrame, id_col: str) -> DataFrame:
    """(pid, part, ring, seq, last, x1, y1, x2, y2): numbered edges of every ring; ``last`` is the ring's last number."""
    v = (polygons.select(F.col(id_col).alias("pid"), F.posexplode("geom").alias("part", "rings"))
         .select("pid", "part", F.posexplode("rings").alias("ring", "points")).filter(F.size("points") > 1))
    v = v.withColumn("last", F.size("points") - 2)
    edges = F.transform(F.slice("points", F.lit(1), F.size("points") - 1), lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    nexts = F.slice("points", F.lit(2), F.size("points") - 1)
    e = F.zip_with(edges, nexts, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return v.select("pid", "part", "ring", "last", F.posexplode(e).alias("seq", "e")).select("pid", "part", "ring", "seq", "last", "e.*")


def _in_cells(edges: DataFrame) -> DataFrame:
    """Edges with the cells they pass; the cell side belongs to the polygon."""
    whole = edges.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"),
                                     F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    side = F.greatest((F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c")) / F.sqrt("n")), F.lit(1.0e-7))
    sized = edges.join(whole.select("pid", side.alias("side")), "pid")
    s = F.col("side")
    rows = sized.withColumn("cy", F.explode(F.sequence(F.floor((F.least("y1", "y2") - _EPS) / s), F.floor((F.greatest("y1", "y2") + _EPS) / s))))

    def x_at(y: Column) -> Column:
        t = F.least(F.greatest(F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")), F.lit(0.0)), F.lit(1.0))
        return F.col("x1") + t * (F.col("x2") - F.col("x1"))

    flat = F.abs(F.col("y1") - F.col("y2")) <= _EPS
    a = F.when(flat, F.col("x1")).otherwise(x_at(F.col("cy") * s - _EPS))
    b = F.when(flat, F.col("x2")).otherwise(x_at((F.col("cy") + 1) * s + _EPS))
    return rows.withColumn("cx", F.explode(F.sequence(F.floor((F.least(a, b) - _EPS) / s), F.floor((F.greatest(a, b) + _EPS) / s))))


def _side(e: str, px: Column, py: Column) -> Column:
    """Sign of the side of edge ``e`` that a point lies on."""
    x1, y1, x2, y2 = (F.col(f"{e}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))


def _on(e: str, px: Column, py: Column) -> Column:
    x1, y1, x2, y2 = (F.col(f"{e}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return ((_side(e, px, py) == 0) & (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2)) & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2)))


def edge_meetings(polygons: DataFrame, id_col: str) -> DataFrame:
    """(pid, crossing): a row for every pair of edges of a polygon that cross (true) or touch (false)."""
    ensure_checkpoint_dir(polygons.sparkSession)
    cells = _in_cells(ring_edges(polygons, id_col)).checkpoint(eager=True)
    a, b = cells.alias("a"), cells.alias("b")
    number = lambda e: F.struct(F.col(f"{e}.part"), F.col(f"{e}.ring"), F.col(f"{e}.seq"))
    ends = {f"{e}{k}": (F.col(f"{e}.x{k}"), F.col(f"{e}.y{k}")) for e in "ab" for k in (1, 2)}
    crossing = (_side("a", *ends["b1"]) * _side("a", *ends["b2"]) < 0) & (_side("b", *ends["a1"]) * _side("b", *ends["a2"]) < 0)
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.ring") == F.col("b.ring"))
    following = same & (F.col("b.seq") == F.col("a.seq") + 1)          # share b1
    closing = same & (F.col("a.seq") == 0) & (F.col("b.seq") == F.col("b.last"))   # share a1
    touch = ((_on("a", *ends["b1"]) & ~following) | (_on("a", *ends["b2"]) & ~closing) | (_on("b", *ends["a1"]) & ~closing) | (_on("b", *ends["a2"]) & ~following))
    meet = (F.col("a.pid") == F.col("b.pid")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cx") == F.col("b.cx")) & (number("a") < number("b"))
    pairs = a.join(b, meet & (crossing | touch)).select(F.col("a.pid").alias("pid"), crossing.alias("crossing"), number("a").alias("first"), number("b").alias("second"))
    return pairs.distinct().select("pid", "crossing")


def polygon_faults(polygons: DataFrame, id_col: str) -> DataFrame:
    """Per polygon: crossings, touches (pairs of edges) and holes_outside (holes whose first vertex is not in their shell)."""
    met = edge_meetings(polygons, id_col).groupBy("pid").agg(F.count_if("crossing").alias("crossings"), F.count_if(~F.col("crossing")).alias("touches"))

    def strays(part):
        shell = G.ring_edges(F.get(part, 0))
        return F.size(F.filter(part, lambda r, i: (i > 0) & (F.size(r) > 0) & ~(G.point_in_edges(shell, r[0]["x"], r[0]["y"]) | G.on_boundary(shell, r[0]["x"], r[0]["y"]))))

    outside = F.aggregate(F.transform(F.coalesce("geom", F.array().cast(polygons.schema["geom"].dataType)), strays), F.lit(0), lambda acc, n: acc + n)
    base = polygons.select(F.col(id_col), outside.alias("holes_outside"))
    out = base.join(met, base[id_col] == met["pid"], "left")
    return out.select(id_col, F.coalesce("crossings", F.lit(0)).alias("crossings"), F.coalesce("touches", F.lit(0)).alias("touches"), "holes_outside")


def split_faulty(polygons: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(usable, faulty with ``faults``): what a loader keeps and what it reports.

    Faults: those of ``validity_issues``, ``self_crossing`` and ``hole_outside``. Rings that only touch are usable.
    """
    found = polygon_faults(polygons, id_col).withColumnRenamed(id_col, "__id")
    tagged = polygons.join(found, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("faults", F.concat(
        G.validity_issues("geom"), F.array_compact(F.array(F.when(F.col("crossings") > 0, F.lit("self_crossing")), F.when(F.col("holes_outside") > 0, F.lit("hole_outside"))))))
    tagged = tagged.drop("__id", "crossings", "touches", "holes_outside")
    return tagged.filter(F.size("faults") == 0).drop("faults"), tagged.filter(F.size("faults") > 0)
