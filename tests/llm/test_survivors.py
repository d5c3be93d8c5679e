import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterstack.llm.survivors import surviving_records, survivors

SCHEMA = "record_id long, file_hash string, path string, size long, modified string, origin string, scanned_at timestamp, trust int, path_from long"
AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def origins(spark):
    return spark.createDataFrame([("NAS ", 1), ("usb", 2), ("usb", 5), (None, 9)], "origin string, trust int")


def chosen(spark, origins, rows):
    df = spark.createDataFrame([(*r, AT, 0, 0) for r in rows], SCHEMA)
    return sorted(map(tuple, survivors(df, origins).collect()))


def test_fields_from_different_records(spark, origins):
    rows = [
        (1, " AB ", "/one", 0, "2023-01-01T00:00:00Z", "nas"),
        (2, "ab", " ", 5, "2023-06-01 00:00:00+02:00", "usb"),
        (3, "ab", "/three", 7, "2025-01-01T00:00:00Z", " NAS"),  # a clock ahead doesn't count
        (3, "ab", "/three", 7, "2025-01-01T00:00:00Z", " NAS"),
        (4, "ab", "/four", 9, "2023-01-01T00:00:00.001Z", "unlisted"),
    ]
    assert chosen(spark, origins, rows) == [("ab", 1, 2, 2)]


def test_ties_go_to_the_smallest_id(spark, origins):
    rows = [(i, "h", "/p", 1, None, "usb") for i in (9, 4, 7)]
    assert chosen(spark, origins, rows) == [("h", 4, 4, 0)]


def test_nothing_to_choose(spark, origins):
    rows = [(1, "h", None, None, "unknown", None), (2, "h", "", -1, "2023-01-01 00:00:00", ""), (3, None, "/p", 1, None, "nas"), (4, " ", "/p", 1, None, "nas"), (5, " ", "/p", 1, None, "nas"), (6, "one", "/p", 1, None, "nas"), (None, "one", "/p", 1, None, "nas")]
    assert chosen(spark, origins, rows) == [("h", 0, 0, 0)]
    assert chosen(spark, origins, []) == []


def test_built_record(spark, origins):
    rows = [(1, "h", "/a", 0, "2023-01-01T00:00:00Z", "nas", AT, 0, 0), (2, "h", "/b", 5, None, "usb", AT, 0, 0), (3, "g", None, 0, None, None, AT, 0, 0), (4, "g", None, 0, None, None, AT, 0, 0)]
    found = surviving_records(spark.createDataFrame(rows, SCHEMA), origins).orderBy("file_hash").collect()
    assert [tuple(r) for r in found] == [("g", None, None, None), ("h", "/a", 5, "2023-01-01T00:00:00Z")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([None, "", "/p"]), st.sampled_from([None, 0, 3]), st.sampled_from([None, "2023-01-01T00:00:00Z", "2023-02-01T00:00:00Z", "2030-01-01T00:00:00Z"]), st.sampled_from(["nas", "usb", "?", None])), max_size=12))
def test_like_sorting(spark, origins, values):
    rows = [(i + 1, *v) for i, v in enumerate(values)]
    expected, trust = [], {"nas": 1, "usb": 2}
    for h in "ab":
        own = [r for r in rows if r[1] == h]
        if len(own) < 2:
            continue
        when = lambda r: r[4] if r[4] and r[4] < "2024" else ""
        late = lambda r: tuple(-ord(c) for c in when(r)) or (1,)
        rank = lambda r: trust.get(r[5], 99)
        first = lambda rs, key: min(rs, key=key)[0] if rs else 0
        expected.append((h, first([r for r in own if r[2]], lambda r: (rank(r), late(r), r[0])), first([r for r in own if (r[3] or 0) > 0], lambda r: (late(r), rank(r), r[0])), first([r for r in own if when(r)], lambda r: (late(r), rank(r), r[0]))))
    assert chosen(spark, origins, rows) == expected
