import numpy as np
import pytest

from shutterstack.llm.mixing import Source, block_tokens, blocks_of, drawn_counts, group_counts, mixture, mixture_shares, permuted, plan_slots
from shutterstack.llm.tokens import count_tokens, encoding

DOC, TARGET = "doc_id long, source string, text string, block_no long", "source string, target_share double, max_repeats int, tokens long"


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4097])
def test_permutation(n):
    a, b = permuted(np.arange(n), n, 3), permuted(np.arange(n), n, 4)
    assert sorted(a.tolist()) == list(range(n))
    if n > 5:
        assert (a != b).any() and (a != np.arange(n)).any()


def test_draws():
    shares = np.array([0.25, 0.2, 0.1, 0.45])
    counts = drawn_counts(0, 500, 256, shares, 1)
    assert (counts.sum(axis=1) == 256).all() and np.abs(counts.mean(axis=0) / 256 - shares).max() < 0.002
    assert (counts == drawn_counts(0, 500, 256, shares, 1)).all() and (counts != drawn_counts(1, 500, 256, shares, 1)).any()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(6)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, ["A ", "b", "c", "other", None][i % 5] if i % 2 else "a", " ".join(rng.choice(words, rng.integers(5, 120))), 0) for i in range(600)]
    rows += [(1000, "b", "", 0), (1001, "b", None, 0), (None, "b", "alpha beta", 0), rows[1], (1002, "c", "alpha " * 3000, 0)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1, 0), ("B", 0.3, 4, 0), ("c", 0.15, 2, 0), ("absent", 0.05, 2, 0), (None, 0.1, 1, 0), ("bad", -1.0, 1, 0), ("worse", float("nan"), 1, 0)], TARGET)


def test_blocks_cover_the_stream(spark):
    sizes = spark.createDataFrame([(("s", "t")[i % 3 == 0], i, 1 + i * 7 % 50) for i in range(300)], "source string, doc_id long, n_tokens long")
    rows = blocks_of(sizes, block=32, bucket=40).collect()
    used = {}
    for r in rows:
        assert r["n_tokens"] == 32 == sum(p["n_tokens"] for p in r["pieces"])
        for p in r["pieces"]:
            for t in range(p["first_token"], p["first_token"] + p["n_tokens"]):
                assert (p["doc_id"], t) not in used
                used[p["doc_id"], t] = r["source"]
    for source in "st":
        total = sum(1 + i * 7 % 50 for i in range(300) if (i % 3 == 0) == (source == "t"))
        assert 0 <= total - sum(v == source for v in used.values()) < 32
        assert sorted(r["block_no"] for r in rows if r["source"] == source) == list(range(sum(r["source"] == source for r in rows)))


def test_mixture(spark, docs, targets):
    mixed = mixture(docs, targets, block=16, shard=64)
    rows = mixed.collect()
    places = [(r["shard_no"], r["slot_no"]) for r in rows]
    assert len(places) == len(set(places)) > 200
    used, caps = {}, {"a": 1, "b": 4, "c": 2}
    for r in rows:
        assert r["repeat_no"] < caps[r["source"]]
        for p in r["pieces"]:
            for t in range(p["first_token"], p["first_token"] + p["n_tokens"]):
                used[r["source"], p["doc_id"], t] = used.get((r["source"], p["doc_id"], t), 0) + 1
    assert all(n <= caps[s] for (s, _, _), n in used.items())
    shares = {r["source"]: r for r in mixture_shares(mixed, targets).collect()}
    assert set(shares) == {"a", "b", "c", "absent"} and shares["absent"]["actual_share"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s]["actual_share"] - share / 0.95) < 0.02
    assert sorted(rows) == sorted(mixture(docs, targets, block=16, shard=64).collect())


def test_tokens_come_back(spark, docs, targets):
    mixed = mixture(docs, targets, block=16, shard=64)
    tokens = {(r["shard_no"], r["slot_no"]): r["tokens"] for r in block_tokens(mixed, docs).collect()}
    texts = {r["doc_id"]: encoding().encode_ordinary(r["text"]) for r in docs.where("doc_id is not null and text <> ''").collect()}
    for r in mixed.collect():
        assert tokens[r["shard_no"], r["slot_no"]] == [t for p in r["pieces"] for t in texts[p["doc_id"]][p["first_token"] : p["first_token"] + p["n_tokens"]]]


def test_no_draw_passes_a_cap():
    """Sources run out one after the other; the others fill their slots, until nothing is left."""
    sources = [Source("a", 0.5, 1, 900), Source("b", 0.3, 2, 150), Source("c", 0.2, 3, 500)]
    caps = np.array([900, 300, 1500])
    assert plan_slots(sources) == 1000
    for total in (1000, 2000, 2700, 5000):
        counts = group_counts(0, np.zeros(3, np.int64), sources, min(total, 2700), 64, 1)
        used = counts.sum(axis=0)
        assert (used <= caps).all() and used.sum() == min(total, 2700)
        assert (counts.sum(axis=1)[:-1] == 64).all()
        if total == 1000:
            assert np.abs(used / 1000 - [0.5, 0.3, 0.2]).max() < 0.02
    assert (used == caps).all()


def test_a_cap_that_binds(spark, docs, targets):
    """With more tokens wanted than the source of the largest share has, it falls behind and is reported."""
    plain = mixture(docs, targets, block=16, shard=64)
    longest = mixture(docs, targets, block=16, shard=64, tokens=10**9)
    n = plain.count()
    rows = mixture(docs, targets, block=16, shard=64, tokens=(n + 300) * 16).collect()
    assert len(rows) == n + 300 < longest.count()
    for mixed in (rows, longest.collect()):
        places = {}
        for r in mixed:
            places.setdefault(r["shard_no"], []).append(r["slot_no"])
        last = max(places)
        assert all(sorted(v) == list(range(64)) for k, v in places.items() if k != last) and sorted(places[last]) == list(range(len(places[last])))
        assert len({(r["source"], r["block_no"], r["repeat_no"]) for r in mixed}) == len(mixed)
    shares = {r["source"]: r for r in mixture_shares(longest, targets).collect()}
    usual = {r["source"]: r["share_gap"] for r in mixture_shares(plain, targets).collect()}
    assert shares["a"]["share_gap"] < usual["a"] - 0.05 and shares["b"]["share_gap"] > 0 and shares["b"]["most_repeats"] == 4


def test_nothing_to_mix(spark, docs, targets):
    assert mixture(docs.limit(0), targets).count() == 0
    assert mixture(docs, targets.limit(0)).count() == 0
    shares = mixture_shares(mixture(docs.limit(0), targets), targets).collect()
    assert len(shares) == 4 and all(r["tokens"] == 0 for r in shares)


def test_sizes():
    assert count_tokens("") == count_tokens(None) == 0 and count_tokens("hello world") == 2
