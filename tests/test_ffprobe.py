"""Probe output of every video of the tables, not only of those with whole seconds and no missing field."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from shutterstack.plans import catalogue


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_video_is_probed(spark, sample, size):
    folder = sample.replace("sf0.001", size)
    con = connect(folder)
    columns, rows = rows_of(catalogue.QUERIES["metadata_ffprobe"](spark, folder))
    assert (columns, rows) == rows_of_sql(con, catalogue.SQL["metadata_ffprobe"])
    videos, whole = con.execute(catalogue.BASE + "SELECT count(*), count(*) FILTER (duration_ms % 1000 = 0) FROM meta WHERE media_type = 'video'").fetchone()
    at = columns.index("duration_ms")
    missing = con.execute(catalogue.BASE + "SELECT count(*) FROM meta WHERE media_type = 'video' AND duration_ms IS NULL").fetchone()[0]
    probed = sum(n for row, n in rows.items() if row[at] is not None)
    assert probed == videos - missing > whole
