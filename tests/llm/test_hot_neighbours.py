"""A third of all vectors in one tight cluster of distinct vectors, which k-means gives a third of all centres."""

import numpy as np

from shutterstack.llm import neighbours
from shutterstack.llm.neighbours import fit_centres, most_similar, shards_of


def tight(n, cosine=0.94, dim=64, seed=0):
    """Unit vectors; the first third of them have this cosine to each other on average."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, apart = x[0].copy(), rng.normal(size=(n // 3, dim))
    apart -= (apart @ centre)[:, None] * centre
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    x[: n // 3] = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * apart
    return x.astype(np.float32)


def best_of(x, rows, k=5):
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -2
    return np.argsort(-s, axis=1)[:, :k]


def test_neighbours_in_a_tight_cluster_share_a_shard():
    x = tight(20_000)
    at = [set() for _ in x]
    for row, shard in zip(*(a.tolist() for a in shards_of(x, fit_centres(x[np.random.default_rng(1).permutation(len(x))], 250)))):
        at[row].add(shard)
    rows = np.arange(0, len(x) // 3, 20)
    assert np.mean([[bool(at[a] & at[b]) for b in near] for a, near in zip(rows.tolist(), best_of(x, rows).tolist())]) >= 0.99


def test_tight_cluster_in_parts_and_slices(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("SHARD_MOST", 150), ("SEARCHED_MOST", 300)):
        monkeypatch.setattr(neighbours, name, value)
    x = tight(1500)
    found = {}
    for r in most_similar(spark.createDataFrame([(f"v{i:05}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>"), 5, 0.88).collect():
        found.setdefault(int(r["id"][1:]), []).append(int(r["other"][1:]))
    assert all(len(v) == len(set(v)) == 5 for i, v in found.items() if i < 500)
    rows = np.arange(500)
    assert np.mean([[b in found.get(a, ()) for b in near] for a, near in zip(rows.tolist(), best_of(x, rows).tolist())]) >= 0.9
