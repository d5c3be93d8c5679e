"""The application's workers: what is claimed is written down, every file is encoded once, and a bad one fails alone."""

import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shutterstack import app
from shutterstack.app import Catalog
from shutterstack.encoders import HashingEncoder
from shutterstack.operators import jobs
from shutterstack.operators.transcode import TranscodeConfig

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting(HashingEncoder):
    """Writes a line for each image that is encoded, and fails on those that say so."""

    def __init__(self, log, dim=16):
        super().__init__(dim)
        self.log = str(log)

    def encode_images(self, images):
        if any(b"broken" in data for data in images):
            raise ValueError("can't decode")
        with open(self.log, "a") as file:
            file.write("x\n" * len(images))
        return super().encode_images(images)


def gif(n):
    return b"GIF89a" + struct.pack("<HH", n, n) + bytes(range(n, n + 90))


@pytest.fixture
def library(tmp_path):
    (tmp_path / "library").mkdir()
    for i in range(3):
        (tmp_path / "library" / f"{i}.gif").write_bytes(gif(i + 1))
    return tmp_path / "library"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"), Counting(tmp_path / "log"), clock=lambda: "2024-01-01T00:00:00Z")


def program(tmp_path, monkeypatch, name, text):
    """A stand-in for a program, which is the only one found."""
    tool = tmp_path / name
    tool.write_text("#!/bin/sh\nfor last; do :; done\n" + text)
    tool.chmod(0o755)
    monkeypatch.setattr(app.shutil, "which", lambda wanted: str(tool) if wanted == name else None)


def test_claims_are_committed_and_files_encoded_once(catalog, library, tmp_path):
    catalog.scan(str(library))
    catalog.ingest(("embed",))
    rows = catalog.read("jobs").where("stage = 'embed'").collect()
    assert [(r["status"], r["attempts"], r["worker_id"]) for r in rows] == [("completed", 1, "local")] * 3 and all(r["started_at"] and r["completed_at"] for r in rows)
    assert len((tmp_path / "log").read_text().splitlines()) == 3


def test_attempts_run_out(catalog, library):
    """Jobs of a worker that died three times are left alone."""
    catalog.scan(str(library))
    for _ in range(3):
        catalog.tables["jobs"].overwrite(jobs.reset_running(catalog.read("jobs")))
        queue = catalog.read("jobs")
        catalog.tables["jobs"].overwrite(jobs.claimed(queue, jobs.claim(queue.where("stage = 'index'"), "dies", 10)))
    assert catalog.ingest(("index",)) == {"index": 0}
    assert {(r["status"], r["attempts"]) for r in catalog.read("jobs").where("stage = 'index'").collect()} == {("pending", 3)}


def test_a_bad_image_fails_alone(catalog, library):
    (library / "bad.gif").write_bytes(b"broken")
    catalog.scan(str(library))
    catalog.ingest(("embed",))
    found = {r["file_path"].rsplit("/", 1)[1]: (r["status"], r["error_message"]) for r in catalog.read("jobs").where("stage = 'embed'").collect()}
    assert found["bad.gif"] == ("failed", "ValueError: can't decode") and [found[f"{i}.gif"] for i in range(3)] == [("completed", None)] * 3
    assert catalog.read("media").count() == 3


def test_frames_reach_the_catalog(catalog, library, tmp_path, monkeypatch):
    """The stand-in writes three frames of a video, two of them alike, and fails on another video."""
    (library / "v.mp4").write_bytes(b"video")
    (library / "w.mp4").write_bytes(b"other")
    program(tmp_path, monkeypatch, "ffmpeg", 'd=$(dirname "$last")\ncase "$*" in *w.mp4*) echo "no such stream" >&2; exit 1;; esac\nfor i in 0 25 50; do head -c 4000 /dev/zero | tr "\\\\0" $((i / 26)) > "$d/frame_$(printf %08d $i).jpg"; done\n')
    catalog.scan(str(library))
    assert catalog.ingest(("extract_frames", "embed")) == {"extract_frames": 5, "embed": 5}
    states = {(r["stage"], r["file_path"].rsplit("/", 1)[1]): (r["status"], r["error_message"]) for r in catalog.read("jobs").collect()}
    assert states["extract_frames", "v.mp4"] == ("completed", None) and states["extract_frames", "w.mp4"] == ("failed", "no such stream")
    assert states["embed", "v.mp4"] == ("completed", None) and states["embed", "w.mp4"] == ("skipped", None)
    rows = catalog.read("media").where(F.col("media_type") != "image").orderBy("frame_index").collect()
    video, frames = [r for r in rows if r["media_type"] == "video"], [r for r in rows if r["media_type"] == "video_frame"]
    assert [(r["frame_index"], r["frame_timestamp_ms"], r["source_video_path"].endswith("v.mp4")) for r in frames] == [(0, 0, True), (2, 50, True)]
    assert len(video) == 1 and video[0]["file_hash"] == frames[0]["file_hash"]
    pooled = np.mean([r["embedding"] for r in frames], axis=0)
    assert np.allclose(video[0]["embedding"], pooled / np.linalg.norm(pooled), atol=1e-6)


def test_re_embedding(catalog, library):
    catalog.scan(str(library))
    catalog.ingest(("embed",))
    before = {r["id"]: r for r in catalog.read("media").collect()}
    catalog.encoder = HashingEncoder(8)
    assert catalog.reembed("m2", "7") == 3
    assert catalog.ingest(("re_embed",)) == {"re_embed": 3}
    after = {r["id"]: r for r in catalog.read("media").collect()}
    assert set(before) == set(after) and {(r["model_id"], r["model_version"], len(r["embedding"])) for r in after.values()} == {("m2", "7", 8)}
    assert {r["status"] for r in catalog.read("jobs").where("stage = 're_embed'").collect()} == {"completed"}


def test_transcoding(catalog, library, tmp_path, monkeypatch):
    """The stand-in writes a byte: the video that has metadata is replaced, one without fails, one within the limits is skipped."""
    for name in ("tall", "fine", "unknown"):
        (library / f"{name}.mp4").write_bytes(name.encode() * 100)
    catalog.scan(str(library))
    hashes = {r["file_path"].rsplit("/", 1)[1]: r["file_hash"] for r in catalog.read("files").collect()}
    known = catalog.spark.createDataFrame([(hashes["tall.mp4"], 3840, 2160, "h264"), (hashes["fine.mp4"], 640, 360, "hevc")], "file_hash string, width int, height int, codec string")
    from shutterstack.schemas import METADATA

    catalog.tables["metadata"].upsert(catalog._full(known, METADATA))
    catalog.transcoding = TranscodeConfig(enabled=True, use_hw_encoder=False, original_policy="replace", staging_dir=str(tmp_path / "staging"))
    assert catalog.enqueue_transcodes(catalog.transcoding) == 1
    more = catalog.read("files").where("file_path like '%fine.mp4' or file_path like '%unknown.mp4'").select("file_hash", "file_path", F.lit("transcode").alias("stage"), F.lit("pending").alias("status"))
    queue = catalog.read("jobs")
    catalog.tables["jobs"].overwrite(queue.unionByName(catalog._new_jobs(more, 1000, catalog.clock()), allowMissingColumns=True))
    program(tmp_path, monkeypatch, "ffmpeg", 'echo x > "$last"\n')
    assert catalog.ingest(("transcode",)) == {"transcode": 3}
    found = {r["file_path"].rsplit("/", 1)[1]: (r["status"], r["error_message"]) for r in catalog.read("jobs").where("stage = 'transcode'").collect()}
    assert found == {"tall.mp4": ("completed", None), "fine.mp4": ("skipped", None), "unknown.mp4": ("failed", "no metadata")}
    assert (library / "tall.mp4").read_bytes() == b"x\n" and (library / "fine.mp4").read_bytes() == b"fine" * 100
