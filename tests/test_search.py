import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shutterstack.errors import QueryError
from shutterstack.functions.vectors import dot, norm, normalised, register_functions
from shutterstack.operators import search
from shutterstack.operators.search import Filters, parse_queries, parse_query

CASES = {
    "sunset beach": ("sunset beach", None, None, None),
    "type:VIDEO clouds": ("clouds", "video", None, None),
    "TYPE:video clouds": ("TYPE:video clouds", None, None, None),
    "type:audio music": ("type:audio music", None, None, None),
    "after:not-a-date spring": ("after:not-a-date spring", None, None, None),
    "type:video after:2026-01-01 before:2026-06-30 sunset": ("sunset", "video", dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 30, 23, 59, 59)),
    "a  type:image   b": ("a b", "image", None, None),
    "type:image type:video": ("", "video", None, None),
    "": ("", None, None, None),
    "after:2024-02-30 x": ("after:2024-02-30 x", None, None, None),
    "type: before:": ("type: before:", None, None, None),
}


@pytest.mark.parametrize("text", CASES)
def test_parser(text):
    q = parse_query(text)
    assert (q.text, q.filters.media_type, q.filters.after, q.filters.before) == CASES[text]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["type:image", "type:Video", "type:x", "after:2024-1-5", "after:2024-13-01", "before:2023-12-31", "cat", "dog:after:2024-01-01", "type:"]), max_size=6), min_size=1, max_size=12))
def test_set_based_parser_is_the_same(spark, queries):
    texts = [" ".join(q) for q in queries]
    rows = parse_queries(spark.createDataFrame(list(enumerate(texts)), "i int, query string")).orderBy("i").collect()
    for text, r in zip(texts, rows):
        q = parse_query(text)
        assert (r["text"], r["media_type"], r["after_ts"], r["before_ts"]) == (q.text, q.filters.media_type, q.filters.after, q.filters.before)


def test_given_conditions():
    assert parse_query("x", media_type="image", after="2024-01-01").filters == Filters(media_type="image", after=dt.datetime(2024, 1, 1))
    assert parse_query("type:video x", media_type="image").filters.media_type == "video"


MEDIA = "id string, file_path string, file_name string, media_type string, embedding array<float>, width int, height int, file_ext string, exif_camera_model string, exif_date_taken string, file_modified string, exif_gps_lat double, exif_gps_lon double, source_video_path string, frame_index int, frame_timestamp_ms long"


@pytest.fixture(scope="module")
def media(spark):
    rows = [(f"m{i:02}", f"/m{i}.jpg", f"m{i}.jpg", ["image", "video", "video_frame", "odd"][i % 4], [float(i), 0.0], 100 * i, None if i == 3 else 50, "jpg", "K7" if i % 2 else None, f"2020-01-{i + 1:02}T00:00:00Z" if i % 3 else None, "2021-05-05 00:00:00+02:00" if i % 2 else "2019-01-01T00:00:00.5Z", 1.0, 2.0 if i % 5 else None, "/v.mp4" if i % 4 == 2 else None, None, None) for i in range(20)]
    return spark.createDataFrame(rows, MEDIA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_rank_then_filter(media):
    """Filters after ranking may leave fewer results than asked for; filters before don't."""
    only = Filters(media_type="video")
    assert ids(search.search(media, [0.0, 0.0], only, 2)) == ["m01", "m05"]
    assert ids(search.search(media, [0.0, 0.0], only, 4)) == ["m01", "m05", "m09", "m13"]
    far = Filters(min_width=1500)
    assert ids(search.search(media, [0.0, 0.0], far, 2)) == [] and ids(search.search(media, [0.0, 0.0], far, 2, prefilter=True)) == ["m15", "m16"]


def test_dates(media):
    """Null and unreadable dates pass; a readable EXIF date hides the file's."""
    after = ids(search.search(media, [0.0, 0.0], Filters(after=dt.datetime(2020, 1, 5)), 20, prefilter=True))
    assert "m03" in after and "m06" not in after and "m04" in after and "m02" not in after and "m09" in after


def test_other_filters(media):
    assert set(ids(search.search(media, [0.0, 0.0], Filters(camera_model="K7", has_gps=False), 20, prefilter=True))) == {"m05", "m15"}
    assert "m03" not in ids(search.search(media, [0.0, 0.0], Filters(min_height=1), 20, prefilter=True))
    assert set(ids(search.search(media, [0.0, 0.0], Filters(media_type="image"), 20, prefilter=True))) == {f"m{i:02}" for i in range(20) if i % 4 in (0, 3)}


def test_text(media):
    class Encoder:
        def encode_text(self, text):
            return [float(len(text)), 0.0]

    assert ids(search.search_text(media, Encoder(), "abc", 1)) == ["m03"]
    assert search.search_text(media, Encoder(), "after:2024-01-01").count() == 0
    with pytest.raises(QueryError):
        search.search_text(media, Encoder(), "type:image")


def test_display(media):
    rows = search.display_table(search.search(media, [0.0, 0.0], limit=4)).orderBy("rank").collect()
    assert [(r["rank"], r["score_text"], r["type_label"], r["dims"]) for r in rows] == [(1, "1.000", "image", "0x50"), (2, "0.500", "video", "100x50"), (3, "0.200", "frame", "200x50"), (4, "0.100", "odd", "-")]
    assert search.result_columns(search.search(media, [0.0, 0.0], limit=3)).where("frame is not null").first()["frame"]["frame_index"] == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0, 0.0], [2.0, 3.0])], "a array<float>, b array<float>")
    rows = df.select(normalised(F.col("a")).alias("n"), norm(F.col("a")).alias("l"), dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[1]["n"] == [0, 0] and (rows[0]["l"], rows[0]["d"]) == (5, 3)


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT l2sq(array(1D, 2D), array(4D, 6D)) AS l, cosine(array(1D, 0D), array(1D, 1D)) AS c, l2_normalize(array(3D, 4D)) AS n, l2_normalize(array(0D)) AS z, cosine(array(0D), array(1D)) AS none, dot_product(array(1D, 2D), array(3D, 4D)) AS d").first()
    assert (row["l"], row["n"], row["z"], row["none"], row["d"]) == (25, [0.6, 0.8], [0], None, 11) and row["c"] == pytest.approx(2**-0.5)
