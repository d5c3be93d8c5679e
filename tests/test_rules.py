"""Scalar rules, frames, duplicates and transcodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterstack.functions import media as rules
from shutterstack.functions.paths import extension, media_type, stem
from shutterstack.operators import dedup, frames, transcode
from shutterstack.operators.knn import fit_centroids, ivf_assign, ivf_search, knn
from shutterstack.operators.transcode import TranscodeConfig


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("w, h, expected", [(1920, 1080, (300, 169)), (1080, 1920, (169, 300)), (1000, 1000, (300, 300)), (200, 150, (200, 150)), (9000, 1, (300, 1))])
def test_fit(spark, w, h, expected):
    assert tuple(one(spark, rules.fit_dimensions(F.lit(w), F.lit(h), 300))) == expected


def test_crop(spark):
    assert tuple(one(spark, rules.crop_geometry(F.lit(1920), F.lit(1080)))) == (398, 224, 87, 0)


@pytest.mark.parametrize("text, rate", [("30/1", 30.0), ("30000/1001", 29.97003), ("24", 24.0), ("0/0", None), (None, None), ("x/y", None)])
def test_rate(spark, text, rate):
    got = one(spark, rules.frame_rate(F.lit(text).cast("string")))
    assert got == (pytest.approx(rate) if rate else None)


def test_probe(spark):
    whole = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30000/1001","x":1}],"format":{"duration":"120.120000","bit_rate":"4600000"}}'
    assert tuple(one(spark, rules.probe_fields(F.lit(whole)))) == (1920, 1080, "h264", pytest.approx(29.97003), 120120, 4600)
    assert tuple(one(spark, rules.probe_fields(F.lit('{"streams":[{"codec_type":"audio"}],"format":{"duration":"300"}}')))) == (None, None, None, None, 300000, None)
    assert tuple(one(spark, rules.probe_fields(F.lit("{}")))) == (None,) * 6 and one(spark, rules.probe_fields(F.lit("not json"))) is None


@pytest.mark.parametrize("name, idx, total, fps, duration, expected", [("frame_000750.jpg", 0, 1, 25.0, None, 30000), ("/d/frame_001000.jpg", 0, 1, None, None, 1000), ("x.jpg", 3, 10, 25.0, 9000, 3000), ("x.jpg", 0, 1, None, 9000, 0), ("x.jpg", 3, 10, None, None, 0)])
def test_frame_time(spark, name, idx, total, fps, duration, expected):
    lit = lambda v, t: F.lit(v).cast(t)
    assert one(spark, rules.frame_time(F.lit(name), F.lit(idx), F.lit(total), lit(fps, "float"), lit(duration, "long"))) == expected


def test_paths(spark):
    values = {"/a/photo.tar.JPG": ("jpg", "image", "photo.tar"), "/a.b/.jpg": ("", None, ".jpg"), "/x/noext": ("", None, "noext"), "clip.MkV": ("mkv", "video", "clip"), "/a/x.txt": ("txt", None, "x")}
    for path, expected in values.items():
        p = F.lit(path)
        assert (one(spark, extension(p)), one(spark, media_type(p)), one(spark, stem(p))) == expected


def test_gps_and_text(spark):
    assert one(spark, rules.gps_decimal(F.lit(40), F.lit(26), F.lit(46.0), F.lit("S"))) == pytest.approx(-40.446111, abs=1e-6)
    assert one(spark, rules.exif_text(F.lit(' "Cam" '))) == "Cam" and one(spark, rules.exif_text(F.lit('""'))) is None


def test_padding(spark):
    for n, last, size in ((3, 0, 77), (77, 77, 77), (90, 49407, 77)):
        got = one(spark, rules.padded_tokens(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
        assert len(got) == size and got[-1] == last


def folded(spark, vectors, threshold=0.95):
    rows = [("v", i, f"f{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "video string, frame_index int, id string, embedding array<float>")
    return [r["frame_index"] for r in frames.reduce_frames(df, threshold).orderBy("frame_index").collect()]


def test_fold(spark):
    e0, e1, e2 = np.eye(3)
    assert folded(spark, [e0] * 4) == [0] and folded(spark, [e0, e1, e2]) == [0, 1, 2] and folded(spark, [e0, e0 * 0.99, e1, e1]) == [0, 2] and folded(spark, []) == []
    # compared with the last kept frame, not with the one before
    turn = [(np.cos(a), np.sin(a), 0) for a in np.radians([0, 12, 24, 36, 48])]
    assert folded(spark, turn) == [0, 2, 4]


def test_pool(spark):
    df = spark.createDataFrame([("v", 0, "a", [1.0, 0.0]), ("v", 1, "b", [0.0, 1.0]), ("w", 0, "c", [0.0, 2.0])], "video string, frame_index int, id string, embedding array<float>")
    rows = {r["video"]: r for r in frames.video_embeddings(df).collect()}
    assert rows["v"]["embedding"] == pytest.approx([0.7071068, 0.7071068]) and rows["v"]["n_kept"] == 2 and rows["w"]["embedding"] == [0, 1]


def test_names_and_samples(spark):
    df = spark.createDataFrame([("/f/my_clip_f0003_90s.jpg",), ("/f/still.jpg",)], "file_path string")
    assert [(r["source"], r["timestamp_sec"]) for r in frames.parse_frame_name(df).collect()] == [("my_clip", 90.0), ("", -1.0)]
    videos = spark.createDataFrame([("/a/clip.mp4", 25.0, 2000), ("/b.mp4", 0.0, 100), ("/c.mp4", 25.0, 0)], "video string, fps double, frames long")
    assert [(r["frame"], r["timestamp_sec"], r["name"]) for r in frames.interval_frames(videos).orderBy("k").collect()] == [(0, 0.0, "clip_f0000_0s.jpg"), (750, 30.0, "clip_f0001_30s.jpg"), (1500, 60.0, "clip_f0002_60s.jpg")]
    assert "fps=0.033333" in frames.extraction_arguments("v", "p", "interval", 30)[3] and "scene" in frames.extraction_arguments("v", "p")[3]


MEDIA = "id string, file_path string, media_type string, embedding array<float>, source_video_path string"


def unit(*pairs):
    v = np.zeros(64)
    for i, x in pairs:
        v[i] = x
    return (v / np.linalg.norm(v)).tolist()


def test_visual(spark):
    rows = [("s1", "/1", "image", unit((0, 1), (1, 0.5)), None), ("s2", "/2", "video", unit((0, 1), (1, 0.51)), None), ("d", "/3", "image", unit((50, 1), (51, 0.5)), None), ("f", "/4", "video_frame", unit((0, 1), (1, 0.5)), "/v")]
    got = dedup.visual_clusters(spark.createDataFrame(rows, MEDIA), 0.9).collect()
    assert sorted((r["cluster_id"], r["id"]) for r in got) == [("s1", "s1"), ("s1", "s2")] and all(r["similarity"] > 0.99 for r in got)
    assert dedup.visual_clusters(spark.createDataFrame(rows[1:3], MEDIA)).count() == 0


def test_cross_video(spark):
    rows = [("a0", "/a0", "video_frame", unit((0, 1), (1, 0.5)), "/a.mp4"), ("a1", "/a1", "video_frame", unit((40, 1)), "/a.mp4"), ("b0", "/b0", "video_frame", unit((0, 1), (1, 0.51)), "/b.mp4"), ("b1", "/b1", "video_frame", unit((60, 1)), "/b.mp4"), ("i", "/i", "image", unit((0, 1), (1, 0.5)), None)]
    got = dedup.cross_video_pairs(spark.createDataFrame(rows, MEDIA), 0.9).collect()
    assert [tuple(r) for r in got] == [("/a.mp4", "/b.mp4", 1, 2, 2, 0.5)]
    assert dedup.cross_video_pairs(spark.createDataFrame(rows[:2], MEDIA), 0.9).count() == 0


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z2", "z1"), ("z3", "z1"), ("q", "q")]
    got = {r["id"]: r["cluster_id"] for r in dedup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"z1": "z1", "z2": "z1", "z3": "z1"}
    assert dedup.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_exact(spark):
    rows = [("h", f"/{i}", 10, "t", "active") for i in range(3)] + [("u", "/u", 1, "t", "active"), ("g", "/g1", 1, "t", "deleted"), ("g", "/g2", 1, "t", "deleted"), (None, "/n1", 1, "t", "active"), (None, "/n2", 1, "t", "active")]
    files = spark.createDataFrame(rows, "file_hash string, file_path string, file_size long, file_modified string, status string")
    assert dedup.exact_duplicate_summary(files).first().asDict() == {"sets": 1, "files": 3, "wasted": 2}
    assert "h: 3 files, 30 bytes" in dedup.duplicate_report("exact", dedup.exact_duplicate_sets(files)) and "No exact" in dedup.duplicate_report("exact", dedup.exact_duplicate_sets(files.limit(0)))
    with pytest.raises(Exception):
        dedup.duplicates("nonsense", files, files)


@pytest.mark.parametrize("block", [8192, 30])
def test_knn_like_brute_force(spark, block):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(100, 8)), 1)  # with ties
    x[50] = x[7]
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    d = np.square(x[:, None] - x[None]).sum(-1)
    got = {(int(r["q"]), r["rank"]): int(r["n"]) for r in knn(df.where("id < '020'"), df, 5, block).collect()}
    assert got == {(i, k + 1): int(j) for i in range(20) for k, j in enumerate(np.lexsort((np.arange(100), d[i]))[:5])}
    assert knn(df.limit(0), df, 5).count() == 0 and knn(df, df.limit(0), 5).count() == 0


def test_inverted_file(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    centres = fit_centroids(df)
    index = ivf_assign(df, centres)
    best = [f"{i:03}" for i in np.argsort(np.square(x - x[0]).sum(1))[:5]]
    assert [r["id"] for r in ivf_search(index, centres, x[0], 5, probes=len(centres)).collect()] == best
    assert len({r["id"] for r in ivf_search(index, centres, x[0], 5, probes=6).collect()} & set(best)) >= 3


VIDEO = "file_path string, width int, height int, codec string, bitrate_kbps int"


@pytest.mark.parametrize("row, config, expected", [
    (("/v", 3840, 2160, "h264", None), {}, ("transcode", None, 1920, 1080)),
    (("/v", 1280, 720, "HEVC", None), {}, ("skip", "h265 at 1280x720 needs no change", None, None)),
    (("/v", 1280, 720, "h264", 900), {}, ("transcode", None, 1280, 720)),
    (("/v", 1000, 1081, "hevc", None), {}, ("transcode", None, 998, 1080)),
    (("/v", None, 720, "h264", None), {}, ("skip", "width or height unknown", None, None)),
    (("/v", 1280, 720, None, None), {"max_resolution": "8k"}, ("skip", "no such resolution: 8k", None, None)),
    (("/v", 1280, 720, None, None), {"enabled": False}, ("skip", "transcoding is switched off", None, None)),
])
def test_decisions(spark, row, config, expected):
    got = transcode.decide(spark.createDataFrame([row], VIDEO), TranscodeConfig(**{"enabled": True} | config)).first()
    assert (got["decision"], got["reason"], got["target_w"], got["target_h"]) == expected


def test_transcode_helpers(tmp_path):
    assert [transcode.encoder_quality(c) for c in (18, 23, 28, 51, 0)] == [40, 55, 70, 85, 20]
    args = transcode.transcode_arguments("a", "b", TranscodeConfig(use_hw_encoder=False))
    assert args[:6] == ["-i", "a", "-c:v", "libx265", "-crf", "23"] and args[-2:] == ["-y", "b"] and "scale=-2:'min(1080,ih)'" in args
    assert "-q:v" in transcode.transcode_arguments("a", "b", TranscodeConfig())
    for policy, left in (("keep", {"o", "n"}), ("archive", {"n", "kept"}), ("replace", {"o"})):
        folder = tmp_path / policy
        folder.mkdir()
        (folder / "o").write_text("old")
        (folder / "n").write_text("new")
        transcode.apply_policy(str(folder / "o"), str(folder / "n"), policy, str(folder / "kept"))
        assert {p.name for p in folder.iterdir()} == left
    with pytest.raises(Exception):
        transcode.apply_policy("a", "b", "burn")


def test_verify(spark):
    rows = [(1, 100, None, 1.0, 1.0, 1, 1), (2, 100, 0, 1.0, 1.0, 1, 1), (3, 100, 100, 1.0, 1.0, 1, 1), (4, 100, 50, 1.0, 1.5, 1, 1), (5, 100, 50, 1.0, 1.6, 1, 2), (6, 100, 50, None, 1.6, None, 2)]
    df = spark.createDataFrame(rows, "id int, original_bytes long, output_bytes long, original_sec double, output_sec double, original_audio int, output_audio int")
    assert {r["id"]: r["issues"] for r in transcode.verify(df).collect()} == {1: "missing", 2: "empty", 3: "not smaller", 4: "", 5: "duration,audio streams", 6: ""}
