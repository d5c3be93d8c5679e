import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterstack.operators.instants import instant_us, media_instants, with_parts
from pyspark.sql import functions as F

MEDIA = "id string, updated_at string, exif_date_taken string, file_modified string, exif_camera_model string, file_path string, extra int, scope string"
HINTS = "scope string, hint_name string, zone_name string"


def us(*parts, zone="UTC", micro=0):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000 + micro


def read(spark, values, zone="UTC"):
    rows = with_parts(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string"), "v")
    return [r[0] for r in rows.orderBy("i").select(instant_us(F.lit(zone))).collect()]


FORMS = {
    "2020-03-04T05:06:07.123456789Z": us(2020, 3, 4, 5, 6, 7, micro=123456),
    "2020-03-04T05:06:07,5+05:45": us(2020, 3, 4, 5, 6, 7, micro=500000) - 345 * 60_000_000,
    '"2020:03:04 05:06:07"': us(2020, 3, 4, 5, 6, 7),
    " 2020/03/04 05:06\t": us(2020, 3, 4, 5, 6),
    "04.03.2020 05:06:07": us(2020, 3, 4, 5, 6, 7),
    "03/04/2020 12:06:07 AM": us(2020, 3, 4, 0, 6, 7),
    "03/04/2020 12:06:07 PM": us(2020, 3, 4, 12, 6, 7),
    "Wed, 04 Mar 2020 05:06:07 -0500": us(2020, 3, 4, 10, 6, 7),
    "4 Mar 2020 05:06:07": us(2020, 3, 4, 5, 6, 7),
    "Mar 4, 2020 05:06:07 pm": us(2020, 3, 4, 17, 6, 7),
    "20200304_050607": us(2020, 3, 4, 5, 6, 7),
    "20200304T050607Z": us(2020, 3, 4, 5, 6, 7),
    "1583298367": 1583298367000000,
    "1583298367123": 1583298367123000,
    "1583298367123456": 1583298367123456,
    "2020-03-04 05:06:07 EST": us(2020, 3, 4, 10, 6, 7),
    "2020-03-04 05:06:07+02": us(2020, 3, 4, 3, 6, 7),
    "2020-03-04T05:06:07+01:00[Europe/Lisbon]": us(2020, 3, 4, 4, 6, 7),
    "2020-02-29 00:00:00": us(2020, 2, 29),
}
NONE = ["", "unknown", "2020-13-04 05:06:07", "2021-02-29 05:06:07", "2020:03:04 24:06:07", "2020:03:04 05:61:07", "04.03.2020", "05:06:07", "    :  :     :  :  ", "0000:00:00 00:00:00", "20200304", "12345678901", "2020-03-04 05:06:07 XYZ", "13/13/2020 1:00:00 PM", "03/04/2020 13:00:00 PM", None, "9" * 10_000, "a|b|c|d|e|f|g|h|i|j|k"]


def test_forms(spark):
    assert read(spark, list(FORMS)) == list(FORMS.values())


def test_unusable(spark):
    assert read(spark, NONE) == [None] * len(NONE)


@pytest.mark.parametrize("zone, wall, instant", [
    ("Europe/Berlin", "2021-10-31 02:30:00", us(2021, 10, 31, 0, 30)),  # twice: the earlier
    ("Europe/Berlin", "2021-03-28 02:30:00", us(2021, 3, 28, 1, 30)),  # skipped: an hour on
    ("Australia/Lord_Howe", "2021-10-03 02:10:00", us(2021, 10, 2, 15, 40)),  # skipped: half an hour on
    ("Australia/Lord_Howe", "2021-04-04 01:45:00", us(2021, 4, 3, 14, 45)),
])
def test_daylight_saving(spark, zone, wall, instant):
    assert read(spark, [wall], zone) == [instant]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)), min_size=1, max_size=20))
def test_days_count_right(spark, times):
    expected = [int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]
    assert read(spark, [t.strftime("%Y-%m-%dT%H:%M:%S.%fZ") for t in times]) == expected


def test_zone_of_camera_then_root(spark):
    rows = [
        ("a", "1", "2020:01:01 00:00:00", "2020-01-01 00:00:00", " cam ", "/root/x.jpg", 1, "x"),
        ("a", "0", "2019:01:01 00:00:00", None, "CAM", "/root/x.jpg", 1, "x"),
        ("a", "1", "2020:01:01 00:00:00", "2020-01-01 00:00:00", " cam ", "/root/x.jpg", 1, "x"),
        ("b", "1", "2020:01:01 00:00:00", None, None, "/elsewhere/x.jpg", None, None),
        ("c", "1", None, None, None, None, None, None),
        (None, "1", "2020:01:01 00:00:00", None, "cam", "/root/x", 1, "x"),
    ]
    hints = [("camera_model", "Cam", "Asia/Tokyo"), ("library_root", "root", "Europe/Berlin"), ("library_root", "elsewhere", "No/Where"), ("library_root", None, "UTC")]
    found = media_instants(spark.createDataFrame(rows, MEDIA), spark.createDataFrame(hints, HINTS)).collect()
    assert sorted(map(tuple, found)) == [("a", "exif_date_taken", us(2020, 1, 1, zone="Asia/Tokyo")), ("a", "file_modified", us(2020, 1, 1, zone="Europe/Berlin"))]


def test_empty(spark):
    assert media_instants(spark.createDataFrame([], MEDIA), spark.createDataFrame([], HINTS)).count() == 0
