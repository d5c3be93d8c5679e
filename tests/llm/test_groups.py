import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterstack.llm.groups import local_representatives, match_groups, visual_match_groups

MATCH = "match_id long, id_a string, id_b string, similarity float, id string, group_id string"


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((v, find(v)) for v in parent)


def groups(spark, edges, **more):
    return sorted(map(tuple, match_groups(spark.createDataFrame(edges, "a string, b string"), **more).collect()))


def shapes():
    rng = np.random.default_rng(3)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(150)]
    star = [("hub", f"s{i:03}") for i in range(90)]
    loose = [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 150, (110, 2)).tolist()]
    return chain[::-1] + star + loose + star[:50] + [(b, a) for a, b in chain[:20]]


@pytest.mark.parametrize("block_edges", [1_000_000, 80, 25])
def test_like_union_find(spark, block_edges):
    """One block, a grid, and a grid so fine that the hub's blocks are salted."""
    edges = shapes()
    assert groups(spark, edges, block_edges=block_edges) == brute(edges)


@pytest.mark.parametrize("bits", [3, 8])
def test_colliding_labels(spark, bits):
    """Hashes so short that most or all ids collide: those get labels of their own."""
    edges = shapes()[::3]
    assert groups(spark, edges, block_edges=80, labels=lambda c: F.pmod(F.xxhash64(c), F.lit(2**bits))) == brute(edges)


def test_local():
    vertex, representative = local_representatives(np.array([4, 2, 9]), np.array([3, 4, 8]))
    assert dict(zip(vertex.tolist(), representative.tolist())) == {2: 2, 3: 2, 4: 2, 8: 8, 9: 8}


def test_what_links(spark):
    nan = float("nan")
    rows = [
        (1, " A ", "b", 0.92, "", ""), (1, " A ", "b", 0.92, "", ""), (2, "B", "C", 1.0, "", ""), (3, "d", "e", 0.9199, "", ""), (4, "d", "e", 1.0001, "", ""), (5, "d", "e", nan, "", ""), (6, "d", "e", None, "", ""), (7, "f", "F ", 1.0, "", ""),
        (8, None, "g", 1.0, "", ""), (9, "g", None, 1.0, "", ""), (10, "x", "y", 0.95, "", ""),
    ]
    found = visual_match_groups(spark.createDataFrame(rows, MATCH)).collect()
    assert sorted(map(tuple, found)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_empty(spark):
    assert groups(spark, []) == []
    assert groups(spark, [("a", "a"), (None, "b")]) == []
    assert visual_match_groups(spark.createDataFrame([], MATCH)).columns == ["id", "group_id"]
