"""Long videos in chunks: the same frames stay, at the same positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterstack.operators.frames import frame_index, keep_changed, reduce_frames

FRAME = "video string, frame_index int, id string, embedding array<float>, chunk int"


def drifting(n, step, seed):
    """Unit vectors that turn a little from each to the next."""
    rng = np.random.default_rng(seed)
    turn = np.cumsum(rng.uniform(0, step, n))
    return np.stack([np.cos(turn), np.sin(turn)], axis=1)


def videos(n):
    parts = {"long": drifting(n, 0.2, 1), "still": np.tile([1.0, 0.0], (n // 3, 1)), "short": drifting(4, 0.5, 2), "one": drifting(1, 0.1, 3), "slow": drifting(n // 2, 0.03, 4)}
    return [(v, i // 2, f"{v}-{i:04}", x.tolist(), 7) for v, rows in parts.items() for i, x in enumerate(rows)] + [(None, 1, "none", [1.0, 0.0], 7)]


@pytest.mark.parametrize("most, n", [(3, 30), (60, 300), (100_000, 300)])
def test_fold_in_chunks_like_the_whole_fold(spark, most, n):
    rows, expected = videos(n), []
    for video in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == video), key=lambda r: (r[1], r[2]))
        expected += [own[i][2] for i in keep_changed(None, [np.asarray(np.float32(r[3]), np.float64) for r in own], 0.95)[1]]
    found = [r["id"] for r in reduce_frames(spark.createDataFrame(rows, FRAME).repartition(5), 0.95, most).collect()]
    assert sorted(found) == sorted(expected) and len(found) < len(rows)


def test_index_in_chunks(spark):
    rows = [(v, f"/f/{v}/{i * 37 % n:05}.jpg") for v, n in (("a", 101), ("b", 3), ("c", 50)) for i in range(n)] + [("a", "/f/a/x.png"), (None, "/f/z.jpg"), (None, "/f/y.jpg"), ("b", "/f/b/00001.jpg")]
    frames = spark.createDataFrame(rows, "source_video_path string, file_path string")
    small, whole = (sorted(map(str, frame_index(frames, most).collect())) for most in (25, 10_000))
    assert small == whole and len(whole) == 156
    assert [r[0] for r in frame_index(frames, 25).where("video = 'a'").orderBy("file_path").select("idx").collect()] == list(range(101))


def test_nothing_to_reduce(spark):
    empty = spark.createDataFrame([], FRAME)
    assert reduce_frames(empty).count() == 0 and frame_index(empty.select(F.col("video").alias("source_video_path"), F.col("id").alias("file_path"))).count() == 0
