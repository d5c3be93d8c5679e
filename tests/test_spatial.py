import numpy as np
import pytest

from shutterstack.functions.vptree import VPTree, angle, unit_vectors
from shutterstack.operators.spatial import EARTH_M, in_ring, spatial_join

POINT = "id string, exif_gps_lat double, exif_gps_lon double, cell int, kind string"
PLACE = "place_id long, ring_lat array<double>, ring_lon array<double>, id string"


def join(spark, points, places=(), radius=60.0, **more):
    rows = spark.createDataFrame([(*p, 1, "x") for p in points], POINT)
    regions = spark.createDataFrame([(*p, "x") for p in places], PLACE)
    return sorted(map(tuple, spatial_join(rows, regions, radius, **more).collect()))


def test_tree_finds_all():
    rng = np.random.default_rng(1)
    p = unit_vectors(rng.normal(0, 0.01, 3000), rng.normal(0, 0.01, 3000))
    q, r = p[:200], np.full(200, 2e-5)
    found = set(zip(*(x.tolist() for x in VPTree(p).within(q, r))))
    brute = {(i, j) for i in range(200) for j in np.nonzero(angle(q[i][None], p) <= 2e-5)[0].tolist()}
    assert found == brute and len(brute) > 400


def test_tree_of_copies_and_none():
    p = np.repeat(unit_vectors([1.0], [2.0]), 500, axis=0)
    assert len(VPTree(p).within(p[:1], np.zeros(1))[0]) == 500
    assert len(VPTree(p[:0]).within(p[:1], np.ones(1))[0]) == 0


@pytest.mark.parametrize("more", [{}, {"per_cell": 20}, {"per_cell": 20, "most": 2, "cell_most": 60}], ids=["one cell", "cells", "cells split again"])
def test_near_like_brute_force(spark, more):
    rng = np.random.default_rng(2)
    lat, lon = np.concatenate([rng.normal(50, 0.002, 150), rng.normal(-89.999, 0.0008, 50), rng.normal(0, 0.001, 100)]), np.concatenate([rng.normal(8, 0.002, 150), rng.uniform(-180, 180, 50), 180 - rng.normal(0, 0.0006, 100)])
    lat, lon = np.maximum(lat, -90), np.where(lon > 180, lon - 360, lon)
    points = [(f"p{i:03}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    v = unit_vectors(lat, lon)
    d = angle(v[:, None], v[None]) * EARTH_M
    expected = sorted(("near", points[i][0], points[j][0]) for i, j in zip(*np.nonzero(np.triu(d <= 60, 1))))
    assert join(spark, points, **more) == expected and len(expected) > 300


def test_cases(spark):
    nan = float("nan")
    points = [
        ("b", 10.0, 20.0), ("a", 10.0, 20.0), ("a", 10.0, 20.0), ("c", 10.0005, 20.0), ("far", 11.0, 20.0), ("zero", 0.0, 0.0), ("n1", nan, 1.0), ("n2", 1.0, None), ("n3", 91.0, 1.0), ("n4", 1.0, -999.0), (None, 10.0, 20.0),
        ("w", 0.5, -180.0), ("e", 0.5, 180.0), ("equator", 0.0, 20.0),
    ]
    square = ([9.0, 9.0, 10.4, 10.4], [19.0, 21.0, 21.0, 19.0])
    places = [
        (1, *square), (2, [*reversed(square[0]), square[0][-1]], [*reversed(square[1]), square[1][-1]]), (3, [0.0, 1.0, 1.0, 0.0], [179.0, 179.0, 181.0, 181.0]), (4, [9.0, 9.0], [1.0, 2.0]), (5, None, None),
        (6, [9.0, 9.0, None], [1.0, 2.0, 3.0]), (7, [9.0, 9.0, 9.5], [1.0, 2.0]), (None, *square),
    ]
    assert join(spark, points, places) == sorted(
        [("inside", p, q) for p in "abc" for q in "12"] + [("inside", "w", "3"), ("inside", "e", "3"), ("near", "a", "b"), ("near", "a", "c"), ("near", "b", "c"), ("near", "e", "w")]
    )


def test_hot_spot(spark):
    """A third of all rows at one location is one search, and all its pairs come back."""
    points = [(f"h{i}", 1.0, 1.0) for i in range(40)] + [(f"p{i}", 2.0 + i, 3.0) for i in range(80)]
    assert len(join(spark, points)) == 40 * 39 // 2


def test_members(spark):
    """Copies as members of a representative: one row each, and near rows between representatives only."""
    points = [(f"h{i:02}", 1.0, 1.0) for i in range(40)] + [("x", 1.0, 1.0003), ("w", -0.5, -180.0), ("v", -0.5, 180.0)]
    square = [(7, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0])]
    assert join(spark, points, square, copies="members") == sorted(
        [("same", "h00", f"h{i:02}") for i in range(1, 40)] + [("same", "v", "w"), ("near", "h00", "x"), ("inside", "h00", "7"), ("inside", "x", "7")]
    )


def test_regions_in_cells_split_again(spark):
    rng = np.random.default_rng(3)
    lat, lon = rng.normal(10, 0.5, 400), rng.normal(20, 0.5, 400)
    places = [(i, [9.0 + i / 10, 9.0 + i / 10, 10.5, 10.5], [19.0, 20.5, 20.5, 19.0]) for i in range(5)]
    points = [(f"p{i:03}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    expected = sorted(("inside", f"p{i:03}", str(p[0])) for p in places for i in np.nonzero(in_ring(lat, lon, np.array(p[1]), np.array(p[2])))[0])
    assert [r for r in join(spark, points, places, per_cell=30, most=3, cell_most=80) if r[0] == "inside"] == expected and expected


def test_empty(spark):
    assert join(spark, []) == []
    assert join(spark, [], [(1, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]) == []
    assert join(spark, [("a", 0.5, 0.2)], []) == []


def test_ring_like_a_concave_shape():
    lat, lon = np.array([0.5, 0.5, 1.5]), np.array([0.5, 2.5, 1.5])
    ring = np.array([0.0, 0.0, 2.0, 1.0, 2.0]), np.array([0.0, 3.0, 3.0, 1.5, 0.0])
    assert in_ring(lat, lon, *ring).tolist() == [True, True, False]
