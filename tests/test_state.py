"""Changes, queue and catalog merges."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterstack.errors import NotFoundError
from shutterstack.operators import catalog, changes, jobs

FILE, SCAN = "file_hash string, file_path string, status string", "file_hash string, file_path string"


def found(spark, files, scanned, **more):
    rows = changes.detect_changes(spark.createDataFrame(files, FILE), spark.createDataFrame(scanned, SCAN), **more).collect()
    return sorted((r["kind"], r["file_hash"], r["file_path"], r["old_path"]) for r in rows)


def test_all_kinds(spark):
    files = [("a", "/a", "active"), ("b", "/b", "active"), ("c", "/c", "active"), ("d", "/d", "active"), ("gone", "/e", "deleted")]
    scanned = [("a", "/a"), ("b2", "/b"), ("c", "/moved"), ("e", "/e"), ("e", "/e"), (None, "/x")]
    assert found(spark, files, scanned) == [("deleted", "b", "/b", None), ("deleted", "d", "/d", None), ("modified", "b2", "/b", None), ("moved", "c", "/moved", "/c"), ("new", "e", "/e", None), ("unchanged", "a", "/a", None)]


def test_copies_and_root(spark):
    files = [("a", "/x/1", "active"), ("a", "/x/2", "active"), ("z", "/other/3", "active"), ("y", "/x/4", "active")]
    assert found(spark, files, [("a", "/x/2"), ("a", "/x/9")], root="/x") == [("deleted", "y", "/x/4", None), ("moved", "a", "/x/9", "/x/1"), ("unchanged", "a", "/x/2", None)]
    assert found(spark, [], []) == []


def test_apply_and_rescan(spark):
    files = [("a", "/a", "active"), ("b", "/b", "active"), ("c", "/c", "active"), ("old", "/o", "deleted")]
    scan = spark.createDataFrame([("a", "/a"), ("b2", "/b"), ("c", "/m"), ("old", "/o")], SCAN)
    after = changes.apply_changes(spark.createDataFrame(files, FILE), changes.detect_changes(spark.createDataFrame(files, FILE), scan))
    assert sorted(map(tuple, after.collect())) == [("a", "/a", "active"), ("b", "/b", "deleted"), ("b2", "/b", "active"), ("c", "/m", "active"), ("old", "/o", "active")]
    assert {r["kind"] for r in changes.detect_changes(after, scan).collect()} == {"unchanged"}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["/1", "/2", "/3"]), st.sampled_from(["active", "deleted"])), max_size=6, unique_by=lambda f: f[:2]), st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["/1", "/2", "/3", "/4"])), max_size=6, unique=True))
def test_like_dictionaries(spark, files, scanned):
    active = [(h, p) for h, p, s in files if s == "active"]
    expected = []
    for h, p in scanned:
        olds = [q for g, q in active if g == h]
        kind = "unchanged" if (h, p) in active else "moved" if olds else "modified" if p in [q for _, q in active] else "new"
        expected.append((kind, h, p, min(olds) if kind == "moved" else None))
    expected += [("deleted", h, p, None) for h, p in active if h not in [g for g, _ in scanned]]
    assert found(spark, files, scanned) == sorted(expected)


JOB = "id long, file_hash string, file_path string, stage string, status string, attempts int, created_at timestamp_ntz, worker_id string, started_at timestamp_ntz, error_message string"


@pytest.fixture(scope="module")
def queue(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, "h1", "/1", "embed", "pending", 0, at, None, None, None), (2, "h2", "/2", "embed", "pending", 3, at, None, None, None), (3, "h3", "/3", "embed", "failed", 1, at, None, None, "x"), (4, "h4", "/4", "index", "running", 1, at, "w", at, None), (5, "h5", "/5", "index", "completed", 1, at, None, None, None)]
    return spark.createDataFrame(rows, JOB)


def test_enqueue_is_idempotent_but_retries_failures(spark, queue):
    hashes = spark.createDataFrame([("h1",), ("h3",), ("new",), ("new",), (None,)], "file_hash string")
    fresh = jobs.enqueue(hashes, queue, ("embed",))
    assert sorted(r["file_hash"] for r in fresh.collect()) == ["h3", "new"]
    assert jobs.enqueue(hashes, queue.unionByName(fresh, allowMissingColumns=True), ("embed",)).count() == 0


def test_claim(queue):
    assert [(r["id"], r["status"], r["attempts"], r["worker_id"]) for r in jobs.claim(queue, "me").collect()] == [(1, "running", 1, "me")]
    assert sorted(r["id"] for r in jobs.claim(queue, "me", 5).collect()) == [1, 2]
    assert [r["id"] for r in jobs.claim(queue, "me", 5, max_attempts=3).collect()] == [1]
    assert jobs.claim(queue.where("status <> 'pending'"), "me").count() == 0


def test_transition_and_reset(spark, queue):
    out = jobs.transition(queue, spark.createDataFrame([(4, "failed", "bad"), (1, "nonsense", None)], "id long, outcome string, message string"))
    assert {r["id"]: (r["status"], r["error_message"]) for r in out.collect()} == {1: ("pending", None), 2: ("pending", None), 3: ("failed", "x"), 4: ("failed", "bad"), 5: ("completed", None)}
    reset = {r["id"]: r for r in jobs.reset_running(queue).collect()}
    assert (reset[4]["status"], reset[4]["worker_id"], reset[4]["started_at"], reset[4]["attempts"]) == ("pending", None, None, 1) and reset[5]["status"] == "completed"


def test_stats(queue):
    assert {r["status"]: r["n"] for r in jobs.queue_stats(queue).collect()} == {"pending": 2, "running": 1, "completed": 1, "failed": 1, "skipped": 0}
    assert jobs.queue_progress(queue).first().asDict() == {"done": 2, "total": 5}
    assert {r["stage"]: r["pending"] for r in jobs.queue_stats_by_stage(queue).collect()} == {"embed": 2, "index": 0}
    assert jobs.queue_progress(queue.limit(0)).first().asDict() == {"done": 0, "total": 0}


def test_upsert_and_models(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sorted(map(tuple, catalog.upsert(base, spark.createDataFrame([("b", 9), ("c", 3)], base.schema)).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert catalog.upsert(base, base.limit(0)).count() == 2
    models = spark.createDataFrame([("x", True), ("y", False)], "model_id string, is_current boolean")
    assert {r["model_id"]: r["is_current"] for r in catalog.activate(models, "y").collect()} == {"x": False, "y": True}
    with pytest.raises(NotFoundError):
        catalog.activate(models, "z")
