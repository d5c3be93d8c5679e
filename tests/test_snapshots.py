from hypothesis import given, settings
from hypothesis import strategies as st

from shutterstack.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, file_hash string, file_path string, last_seen string, status string, change string, v int"


def changes(spark, rows):
    return sorted(map(tuple, snapshot_changes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()))


def test_cases(spark):
    rows = [
        (1, "A", "/a", "1", "active"), (1, "B", "/b", "1", "active"), (1, "C", "/c", "1", "active"), (1, None, "/n", "1", "active"), (1, None, "/m", "1", None), (1, "", "/e", "1", "x"),
        # a gap in the numbers; an earlier reading and repeated rows
        (4, " a ", "/a", "2", "ACTIVE "), (4, "z", "/a", "1", "active"), (4, " a ", "/a", "2", "ACTIVE "), (4, "b", "/b", "1", "deleted"), (4, "x", "/new", "1", "active"), (4, None, "/n", "1", "active"),
        (4, "h", "/m", "1", None), (4, None, "/e", "1", "x"), (4, "k", None, "1", "active"), (None, "k", "/k", "1", "active"),
    ]
    assert changes(spark, rows) == [(4, "/b", "changed"), (4, "/c", "removed"), (4, "/e", "changed"), (4, "/m", "changed"), (4, "/new", "added")]


def test_empty_and_single(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "a", "/a", "1", "active")]) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["a", "A ", "b", None]), st.sampled_from(["/1", "/2", "/3"]), st.sampled_from(["1", "2"]), st.sampled_from(["x", "y"])), max_size=25, unique_by=lambda r: (r[0], r[2], r[3])))
def test_against_dictionaries(spark, rows):
    at = {}
    for no, h, path, seen, status in rows:
        old = at.setdefault(no, {}).get(path)
        if old is None or seen > old[0]:
            at[no][path] = (seen, None if h is None else h.strip().lower(), status)
    expected, numbers = [], sorted(at)
    for p, n in zip(numbers, numbers[1:]):
        for path in at[p].keys() | at[n].keys():
            a, b = at[p].get(path), at[n].get(path)
            if a is None or b is None or a[1:] != b[1:]:
                expected.append((n, path, "added" if a is None else "removed" if b is None else "changed"))
    assert changes(spark, rows) == sorted(expected)
