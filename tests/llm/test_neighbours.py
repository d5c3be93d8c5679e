import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterstack.llm import neighbours
from shutterstack.llm.graph import RobustGraph
from shutterstack.llm.neighbours import fit_centres, most_similar, search_shard, shards_of, similar_media
from shutterstack.llm.queries import P3_SQL
from shutterstack.operators.current import live_rows
from shutterstack.session import read_table


def clustered(n, dim=64, seed=0, size=8):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(-(-n // size), dim)), size, axis=0)[:n] + rng.normal(size=(n, dim)) * 0.35
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(x, found, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :k]
    return np.mean([[b in found.get(i, ()) for b in row] for i, row in enumerate(best.tolist())])


def test_graph_recall_and_degree():
    x = clustered(3000)
    graph = RobustGraph(x, 16, 16, entries=256, room=20)
    assert (graph.edges >= 0).sum(axis=1).max() <= 20 and ((graph.edges >= 0).sum(axis=1) == graph.count).all()
    assert all(len(set(row[row >= 0].tolist())) == n and i not in row for i, (row, n) in enumerate(zip(graph.edges, graph.count)))
    found = {}
    for q, p, _ in search_shard(x, np.ones(len(x), bool), 5):
        for a, b in zip(q.tolist(), p.tolist()):
            found.setdefault(a, set()).add(b)
    assert recall(x, found, 5) >= 0.95


def test_pruned_edges_are_diverse():
    """No edge is kept to a point that a nearer neighbour already leads to."""
    x = clustered(400)
    graph = RobustGraph(x, 12, 24, alpha=1.1)
    nodes = np.arange(0, 400, 37)
    for i, row in zip(nodes, graph._prune(nodes, np.tile(np.arange(400), (len(nodes), 1)))):
        kept = row[row >= 0]
        d = 1 - x[kept] @ x[i]
        for a in range(len(kept)):
            for b in range(a + 1, len(kept)):
                assert 1.1**2 * (1 - x[kept[a]] @ x[kept[b]]) > d[b] - 1e-5


def test_parts_of_a_shard_find_the_same(monkeypatch):
    x = clustered(600)
    whole = {(a, b) for q, p, _ in search_shard(x, np.ones(600, bool), 5) for a, b in zip(q.tolist(), p.tolist())}
    halves = set()
    for part in (0, 1):
        halves |= {(a, b) for q, p, _ in search_shard(x, np.arange(600) % 2 == part, 5) for a, b in zip(q.tolist(), p.tolist())}
    assert len(whole & halves) >= 0.95 * len(whole)


def test_every_vector_gets_shards():
    x = clustered(2000)
    row, shard = shards_of(x, fit_centres(x[:500], 6))
    assert set(row.tolist()) == set(range(2000)) and shard.max() < 6


def vectors(spark, x, ids=None):
    rows = [(ids[i] if ids else f"v{i:05}", v.tolist(), "x", 1.0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, other string, cosine double")


@pytest.mark.parametrize("shard, most, centres", [(8000, 10_000, 100), (150, 10_000, 100), (100, 130, 2)], ids=["one shard", "shards", "shards split again"])
def test_recall_of_the_operator(spark, monkeypatch, shard, most, centres):
    for name, value in (("SHARD", shard), ("SHARD_MOST", most), ("CENTRES_MOST", centres)):
        monkeypatch.setattr(neighbours, name, value)
    x = clustered(900, seed=4)
    found = {}
    for r in most_similar(vectors(spark, x), 5).collect():
        found.setdefault(int(r["id"][1:]), set()).add(int(r["other"][1:]))
    assert all(len(v) == 5 for v in found.values()) and recall(x, found, 5) >= 0.9


def test_copies_and_ties(spark):
    """Of a vector with many copies every row gets its five smallest other ids; nothing is expanded into all pairs."""
    x = np.concatenate([np.repeat(clustered(1, seed=7), 30, axis=0), clustered(1, seed=8)])
    rows = most_similar(vectors(spark, x), 5, 0.5).collect()
    assert len(rows) == 30 * 5
    assert {r["other"] for r in rows if r["id"] == "v00002"} == {"v00000", "v00001", "v00003", "v00004", "v00005"}


def test_few_copies_leave_room_for_others(spark):
    a = clustered(1, seed=7)
    b = a + np.float32(0.02)
    x = np.concatenate([a, a, a, b / np.linalg.norm(b), b / np.linalg.norm(b)])
    rows = {(r["id"], r["other"]) for r in most_similar(vectors(spark, x), 3, 0.5).collect()}
    assert rows == {("v00000", "v00001"), ("v00000", "v00002"), ("v00000", "v00003"), ("v00001", "v00000"), ("v00001", "v00002"), ("v00001", "v00003"), ("v00002", "v00000"), ("v00002", "v00001"), ("v00002", "v00003"),
                    ("v00003", "v00004"), ("v00003", "v00000"), ("v00003", "v00001"), ("v00004", "v00003"), ("v00004", "v00000"), ("v00004", "v00001")}


def test_unusable_vectors(spark):
    ok = clustered(1)[0].tolist()
    rows = [("a", ok), ("b", [2 * v for v in ok]), ("c", None), ("d", []), ("e", [0.0] * 64), ("f", [float("nan"), *ok[1:]]), ("g", [float("inf"), *ok[1:]]), ("h", [None, *ok[1:]]), ("i", ok[:32]), (None, ok)]
    found = most_similar(spark.createDataFrame(rows, "id string, embedding array<float>"), 5, 0.5).collect()
    assert sorted((r["id"], r["other"]) for r in found) == [("a", "b"), ("b", "a")]


def test_empty(spark):
    assert most_similar(spark.createDataFrame([], "id string, embedding array<float>")).count() == 0


def test_found_against_brute_force(spark, sample):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW media AS SELECT * FROM '{sample}/media.parquet'")
    expected = set(con.execute(P3_SQL).fetchall())
    found = {(r["id_a"], r["id_b"]) for r in similar_media(read_table(spark, sample, "media")).collect()}
    assert len(found & expected) >= 0.95 * len(expected) and len(found - expected) <= 0.05 * len(found)


def test_recall_without_a_least_cosine(spark):
    """The five most similar of whole tables, however dissimilar those are."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = live_rows(read_table(spark, folder, "media"), "embedding")
    found = {}
    for r in most_similar(rows, 5).toLocalIterator():
        found.setdefault(r["id"], []).append(r["cosine"])
    held = {r["id"]: np.array(r["embedding"]) for r in rows.where(F.size("embedding") == 64).toLocalIterator() if r["id"] in found}
    ids = sorted(held)
    x = np.array([held[i] / np.linalg.norm(held[i]) for i in ids])
    asked = range(0, len(ids), 25)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    fifth = -np.partition(-s, 4, axis=1)[:, 4]
    assert np.mean([np.sum(np.array(found[ids[i]]) >= fifth[n] - 1e-6) / 5 for n, i in enumerate(asked)]) >= 0.9
