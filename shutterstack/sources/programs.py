"""Running media programs on the executors: frames of videos and transcodes. The programs have to be on all of them."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from shutterstack.operators.frames import extraction_arguments
from shutterstack.operators.transcode import TranscodeConfig, apply_policy, transcode_arguments
from shutterstack.session import ship_package


def _run(command: list[str]) -> str | None:
    """None if the program ended well, else what it said last."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, errors="replace", check=False)
    except OSError as e:
        return str(e)
    return None if done.returncode == 0 else (done.stderr.strip().splitlines() or [f"exit code {done.returncode}"])[-1]


def extract_frames(videos: DataFrame, folder: str, program: str, **settings) -> DataFrame:
    """Rows ``(file_hash, n, error)``: of each of ``videos(file_hash, file_path)`` the number of frames written to ``folder``/file_hash, or what went wrong."""
    ship_package(videos.sparkSession)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, path in zip(batch["file_hash"], batch["file_path"]):
                own = os.path.join(folder, key)
                os.makedirs(own, exist_ok=True)
                error = _run([program, "-y", "-v", "error", *extraction_arguments(path, os.path.join(own, "frame_%08d.jpg"), **settings)])
                rows.append((key, len(frame_files(own)), error))
            yield pd.DataFrame(rows, columns=["file_hash", "n", "error"])

    return videos.select("file_hash", "file_path").mapInPandas(extract, "file_hash string, n long, error string")


def frame_files(folder: str) -> list[str]:
    """The .jpg files of a folder by name; none if it is missing."""
    try:
        return sorted(os.path.join(folder, name) for name in os.listdir(folder) if name.endswith(".jpg"))
    except OSError:
        return []


def listed_frames(videos: DataFrame, folder: str) -> DataFrame:
    """Rows ``(file_hash, video, file_path, frame_index, total)``: the frames that ``extract_frames`` wrote."""
    ship_package(videos.sparkSession)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for key, video in zip(batch["file_hash"], batch["file_path"]):
                paths = frame_files(os.path.join(folder, key))
                rows.extend((key, video, frame, i, len(paths)) for i, frame in enumerate(paths))
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("file_hash", "video", "file_path", "frame_index", "total"))}, dtype=object)

    return videos.select("file_hash", "file_path").mapInPandas(listed, "file_hash string, video string, file_path string, frame_index int, total int")


def transcode_videos(videos: DataFrame, config: TranscodeConfig, program: str) -> DataFrame:
    """Rows ``(id, outcome, message)`` of ``videos(id, file_path)``: each is transcoded to the staging folder, checked, and put in place by the policy.

    An output that is missing, empty or no smaller than the original is removed, and its job failed; the original is never touched then.
    """
    ship_package(videos.sparkSession)
    staging = os.path.expanduser(config.staging_dir)
    archive = os.path.expanduser(config.archive_dir) if config.archive_dir else None

    def one(key: int, path: str) -> str | None:
        os.makedirs(staging, exist_ok=True)
        target = os.path.join(staging, f"{key}-{os.path.basename(path)}")
        error = _run([program, "-v", "error", *transcode_arguments(path, target, config)])
        size = os.path.getsize(target) if os.path.exists(target) else None
        if error is None:
            error = "no output" if size is None else "empty output" if not size else "output is no smaller" if size >= os.path.getsize(path) else None
        if error is not None:
            if size is not None:
                os.remove(target)
            return error
        apply_policy(path, target, config.original_policy, archive)
        if config.original_policy == "archive":
            os.replace(target, path)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, path in zip(batch["id"], batch["file_path"]):
                try:
                    error = one(key, path)
                except OSError as e:
                    error = str(e)
                rows.append((key, "completed" if error is None else "failed", error))
            yield pd.DataFrame(rows, columns=["id", "outcome", "message"])

    return videos.select("id", "file_path").mapInPandas(run, "id long, outcome string, message string")
