import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from geoping.session import local_session
    s = local_session(4, shuffle_partitions=4, app="geoping-tests")
    yield s
    s.stop()


def square(x0, y0, size):
    """Closed counter-clockwise square ring."""
    return [(x0, y0), (x0 + size, y0), (x0 + size, y0 + size), (x0, y0 + size), (x0, y0)]


def geom_rows(polys):
    """[(id, [[ring, ...], ...])] -> rows for a polygon frame (parts -> rings -> points)."""
    return [(pid, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts])
            for pid, parts in polys]


POLY_SCHEMA = "polygon_id long, geom array<array<array<struct<x:double,y:double>>>>"
