"""Assignment after a polygon reload (K04, K05): only points of changed cells are looked at again.

The old and the new polygons have a quadtree cover each, on the same grid. A cell whose candidates (polygon, inside or
edges, attributes) are the same in both answers every point as before, so the rows that may change are those in
cells of the difference of the two sets. Only the date partitions that hold such rows are written; the files of other
dates stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..sinks import writers as W
from . import quadtree as Q
from . import spatial as SP

_GEO = {"district_id": "long", "district_name": "string", "province_id": "long", "province_name": "string"}


def _described(cover: Q.QuadCover, layers: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Nodes by what they say: polygon, inside or edges, and the polygon's attributes."""
    told = None
    for i, (_, polys, id_col) in enumerate(layers):
        attrs = [c for c in polys.columns if c not in (id_col, "geom")]
        one = polys.select(F.lit(i).alias("layer"), F.col(id_col).cast("long").alias("pid"), F.to_json(F.struct(*sorted(attrs)) if attrs else F.struct(F.lit(0))).alias("attrs"))
        told = one if told is None else told.unionByName(one)
    nodes = cover.nodes.join(told, ["layer", "pid"], "left")
    edges = F.array_sort(F.transform("edges", lambda e: F.struct(e["x1"], e["y1"], e["x2"], e["y2"])))
    return nodes.select("layer", "pid", "level", "cell_y", "cell_x", F.md5(F.to_json(F.struct("full", edges.alias("edges"), "attrs"))).alias("said"))


def changed_cells(old: Q.QuadCover, new: Q.QuadCover, old_layers, new_layers) -> DataFrame:
    """(level, cell_y, cell_x) of nodes that are in one cover only."""
    a, b = _described(old, old_layers).checkpoint(eager=True), _described(new, new_layers).checkpoint(eager=True)
    keys = ["layer", "pid", "level", "cell_y", "cell_x", "said"]
    only = a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti"))
    return only.select("level", "cell_y", "cell_x").distinct()


def _as_cells(cells: DataFrame, cell_size: float) -> SP.SpatialIndex:
    none = F.array().cast(T.ArrayType(S.EDGE))
    nodes = cells.select(F.lit(0).alias("layer"), F.lit(0).cast("long").alias("pid"), "level", "cell_y", "cell_x", F.lit(True).alias("full"), none.alias("edges"))
    return Q.as_index(Q.QuadCover(cell_size, ["changed"], nodes))


def reassign_changed(spark: SparkSession, path: str, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame],
                     cell_size: float = Q.DEFAULT_CELL_SIZE, mode: str = "both") -> dict:
    """Bring the stored locations from the ``old`` (districts, provinces) to the ``new`` ones.

    Returns the rows looked at, the dates written and the changed cells. Equal to a full assignment over the new polygons.
    """
    def layers(pair):
        return [("district", pair[0], "district_id"), ("province", pair[1], "province_id")]

    covers = [Q.build_cover(layers(p), cell_size) for p in (old, new)]
    cells = changed_cells(*covers, layers(old), layers(new)).checkpoint(eager=True)
    n = cells.count()
    if not n:
        return {"rows": 0, "dates": [], "cells": 0}
    index = _as_cells(cells, cell_size)
    stored = spark.read.parquet(path)
    places = SP._candidates(stored.select("date", "longitude", "latitude"), index, "longitude", "latitude").filter(F.size("cands") > 0)
    found = places.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()        # a row per day
    if not found:
        return {"rows": 0, "dates": [], "cells": n}
    days = [r["date"] for r in found if r["date"] is not None]
    here = F.col("date").isin(days) if days else F.lit(False)
    here = here | F.col("date").isNull() if len(days) < len(found) else here
    rows = SP._candidates(stored.filter(here), index, "longitude", "latitude")
    touched = F.coalesce(F.size("cands") > 0, F.lit(False))
    for c, kind in _GEO.items():
        rows = rows.withColumn(c, F.when(~touched, F.col(c)).otherwise(F.lit(None).cast(kind)))
    rows = rows.withColumn("__touched", touched).drop("cands")
    fresh = SP.assign_locations(rows.filter("__touched").drop("__touched"), *new, mode=mode, index=Q.as_index(covers[1]), only_missing=False)
    out = rows.filter(~F.col("__touched")).select(*stored.columns).unionByName(fresh.select(*stored.columns)).checkpoint(eager=True)
    W.replace_partitions(out.hint("rebalance", "date"), path, ["date"])
    return {"rows": sum(r["n"] for r in found), "dates": sorted(r["date"] for r in found if r["date"] is not None), "cells": n}
