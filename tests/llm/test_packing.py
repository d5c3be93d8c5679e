import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterstack.llm.packing import fullest, minimum_bin_slack, pack, pack_documents, packing_report
from shutterstack.llm.tokens import count_tokens

ITEM, CAPACITY = "doc_id long, n_tokens long, bin string", "capacity_id long, capacity_tokens int, n_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=10), st.integers(1, 90))
def test_fullest_is_optimal(lengths, room):
    lengths = sorted(lengths, reverse=True)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    chosen = fullest(lengths, room)
    assert sum(chosen) == max(sums) and all(chosen.count(n) <= lengths.count(n) for n in chosen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_every_item_once(lengths):
    bins = list(minimum_bin_slack(np.array(lengths, np.int64), 50))
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)


def check(spark, sizes, capacities, **more):
    items = spark.createDataFrame([(i, n, "x") for i, n in sizes], ITEM)
    rows = pack(items, spark.createDataFrame([(c, n, 1) for c, n in capacities], CAPACITY), **more).collect()
    for cid, cap in capacities:
        own = [r for r in rows if r["capacity_id"] == cid]
        filled, pieces = {}, {}
        for r in own:
            filled[r["bin"]] = filled.get(r["bin"], 0) + r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        assert max(filled.values(), default=0) <= cap
        assert set(pieces) == {i for i, _ in sizes}
        for i, n in sizes:
            parts = sorted(pieces[i])
            assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts[:-1])]).tolist()
            assert len(parts) == max(1, -(-n // cap))  # split only if longer than a container, and then as little as possible
    return rows


@pytest.mark.parametrize("shard_items", [4096, 40])
def test_whole_and_full(spark, shard_items):
    rng = np.random.default_rng(5)
    sizes = list(enumerate(np.concatenate([rng.integers(1, 90, 500), rng.integers(100, 1000, 30), [0, 0]]).tolist()))
    rows = check(spark, sizes, [(1, 100), (2, 257)], shard_items=shard_items)
    for cid, cap in ((1, 100), (2, 257)):
        bins = {r["bin"] for r in rows if r["capacity_id"] == cid}
        assert len(bins) <= 1.02 * sum(n for _, n in sizes) / cap + 1


def test_odd_tables(spark):
    assert check(spark, [], [(1, 10)]) == []
    assert len(check(spark, [(1, 0), (2, 0)], [(1, 10)])) == 2
    check(spark, [(i, 7) for i in range(25)], [(1, 7), (2, 7)])  # all equal, twice the same capacity
    items = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 3, "x"), (None, 4, "x")], ITEM)
    sizes = spark.createDataFrame([(1, 10, 0), (None, 10, 0), (2, 0, 0), (3, None, 0)], CAPACITY)
    assert [(r["capacity_id"], r["doc_id"], r["n_tokens"]) for r in pack(items, sizes).collect()] == [(1, 1, 5)]
    assert pack(items, sizes.limit(0)).count() == 0


def test_documents(spark):
    texts = [(1, "Some words, then some more. " * 40), (2, ""), (3, None), (4, "<|endoftext|> is ordinary text"), (5, "a" * 5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pack_documents(docs, spark.createDataFrame([(1, 64)], "capacity_id long, capacity_tokens int")).collect()
    assert {i: sum(r["n_tokens"] for r in rows if r["doc_id"] == i) for i, _ in texts} == {i: count_tokens(t) for i, t in texts}
    report = packing_report(spark.createDataFrame(rows)).first()
    assert report["tokens"] == sum(count_tokens(t) for _, t in texts)
