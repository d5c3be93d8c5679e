"""Files on disk as DataFrames: listing, hashing, headers."""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shutterstack.errors import NotFoundError
from shutterstack.functions.media import probe_fields
from shutterstack.functions.paths import media_type
from shutterstack.schemas import IMAGE_EXTENSIONS, METADATA, VIDEO_EXTENSIONS
from shutterstack.session import ship_package

CHUNK = 64 * 1024


def _walk(folder: str) -> Iterator[tuple[str, int, float]]:
    """Regular files below a folder, through links but never in a circle; what can't be read is passed over."""
    seen, todo = set(), [folder]
    while todo:
        at = todo.pop()
        try:
            real = os.path.realpath(at)
            entries = [] if real in seen else list(os.scandir(at))
        except OSError:
            continue
        seen.add(real)
        for e in entries:
            try:
                if e.is_dir():
                    todo.append(e.path)
                elif e.is_file():
                    s = e.stat()
                    yield e.path, s.st_size, s.st_mtime
            except OSError:
                continue


#: Files of a listing held at once, and the folders from which on the rest of a tree is walked in parallel.
LISTED, FOLDERS = 10_000, 512


def _tops(root: str) -> list[str]:
    """Folders and files that together hold the tree below ``root``: its levels are opened until there are enough folders for many tasks."""
    files, folders = [], [root]
    while folders and len(folders) < FOLDERS and len(files) < LISTED:
        below = []
        for folder in folders:
            for e in os.scandir(folder):
                (below if e.is_dir(follow_symlinks=False) else files).append(e.path)
        folders = below
    return sorted(files + folders)


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while chunk := file.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def list_files(spark: SparkSession, root: str, slices: int = 64) -> DataFrame:
    """Rows ``(file_path, file_size, file_modified)`` of the media files below ``root``, hidden and empty ones included.

    The driver lists the first levels, until it has some hundred folders or some thousand files; the rest is walked in parallel. ``root`` has to be visible to all executors.
    """
    if not os.path.isdir(root):
        raise NotFoundError(root)
    ship_package(spark)
    wanted = frozenset(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)
    top = _tops(root)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                found = _walk(path) if os.path.isdir(path) else [(path, os.path.getsize(path), os.path.getmtime(path))] if os.path.isfile(path) else []
                rows = ((p, n, pd.Timestamp(t, unit="s", tz="UTC").strftime("%Y-%m-%dT%H:%M:%SZ")) for p, n, t in found if Path(p).suffix.lower().lstrip(".") in wanted)
                # a folder of any size is passed on in pieces
                while piece := list(itertools.islice(rows, LISTED)):
                    yield pd.DataFrame(piece, columns=["file_path", "file_size", "file_modified"])

    schema = "file_path string, file_size long, file_modified string"
    if not top:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in top], "path string").repartition(max(1, min(slices, len(top)))).mapInPandas(walked, schema)


def scan_directory(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Rows ``(file_path, file_size, file_modified, media_type, file_hash)``: the listing with SHA-256 of every file, read in chunks.

    Files whose path, size and time are in ``known`` with a hash keep that hash and aren't read. A file that can't be read fails the scan.
    """
    listed = list_files(spark, root).withColumn("media_type", media_type(F.col("file_path"))).where("media_type is not null")
    names = ["file_path", "file_size", "file_modified"]
    old = known.where("file_hash is not null").groupBy(*names).agg(F.max("file_hash").alias("file_hash")) if known is not None else None

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(file_hash=[sha256_of(p) for p in batch["file_path"]])

    schema = "file_path string, file_size long, file_modified string, media_type string, file_hash string"
    fresh = listed if old is None else listed.join(old, names, "left_anti")
    out = fresh.select(*names, "media_type").mapInPandas(hashed, schema)
    return out if old is None else out.unionByName(listed.join(old, names))


def content_hash(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the lower-case hexadecimal SHA-256 of a text column."""
    return df.withColumn("file_hash", F.sha2(F.col(column), 256))


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, GIF, BMP, WebP or JPEG; nulls for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            return struct.unpack("<H", data[26:28])[0] & 0x3FFF, struct.unpack("<H", data[28:30])[0] & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + length
    except (struct.error, IndexError):
        pass
    return None, None


# EXIF tags read from the main, EXIF and GPS directories.
_TAGS = {0x010F: "exif_camera_make", 0x0110: "exif_camera_model", 0x0112: "exif_orientation", 0x9003: "exif_date_taken", 0x8827: "exif_iso", 0x920A: "exif_focal_length_mm"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif_fields(data: bytes) -> dict[str, object]:
    """EXIF values of a JPEG; what is missing or broken is left out, nothing raises."""
    out: dict[str, object] = {}
    start = data.find(b"Exif\x00\x00")
    if data[:2] != b"\xff\xd8" or start < 0:
        return out
    tiff = data[start + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return out

    def values(kind: int, count: int, raw: bytes) -> list:
        size = _SIZES.get(kind, 0) * count
        if size > 4:
            at = struct.unpack(order + "I", raw)[0]
            raw = tiff[at : at + size]
        if kind == 2:
            return [raw[:count].split(b"\x00")[0].decode("utf-8", "replace").strip().strip('"')]
        if kind in (5, 10):
            n = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw[:size])
            return [n[i] / n[i + 1] if n[i + 1] else float("inf") for i in range(0, 2 * count, 2)]
        return list(struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, raw[:size]))

    def directory(at: int) -> dict[int, list]:
        found = {}
        (n,) = struct.unpack(order + "H", tiff[at : at + 2])
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", tiff[at + 2 + 12 * i : at + 10 + 12 * i])
            try:
                found[tag] = values(kind, count, tiff[at + 10 + 12 * i : at + 14 + 12 * i])
            except (struct.error, KeyError):
                continue
        return found

    try:
        main = directory(struct.unpack(order + "I", tiff[4:8])[0])
        tags = dict(main)
        if 0x8769 in main:
            tags |= directory(main[0x8769][0])
        for tag, name in _TAGS.items():
            if tags.get(tag) and tags[tag][0] not in ("", None):
                out[name] = tags[tag][0]
        gps = directory(main[0x8825][0]) if 0x8825 in main else {}
        for tag, name in ((2, "exif_gps_lat"), (4, "exif_gps_lon")):
            if len(gps.get(tag, [])) >= 3:
                d, m, s = gps[tag][:3]
                sign = -1 if gps.get(tag - 1, [""])[0] in ("S", "W") else 1
                out[name] = sign * (d + m / 60 + s / 3600)
    except (struct.error, IndexError):
        pass
    return out


def image_metadata(files: DataFrame, path: str = "file_path") -> DataFrame:
    """``files`` with width, height and EXIF columns read from the headers; a missing or broken file gives nulls and never an error."""
    ship_package(files.sparkSession)
    names = ("width", "height", "exif_camera_make", "exif_camera_model", "exif_date_taken", "exif_gps_lat", "exif_gps_lon", "exif_focal_length_mm", "exif_iso", "exif_orientation")
    columns = [METADATA[c] for c in names]
    columns = [StructField(f.name, DoubleType()) if f.dataType.simpleString() == "float" else f for f in columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch[path]:
                try:
                    data = Path(p).read_bytes()
                except (OSError, TypeError):
                    data = b""
                w, h = image_size(data)
                rows.append({"width": w, "height": h} | exif_fields(data))
            kinds = {"int": "Int64", "double": "float64"}
            side = pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], index=batch.index, dtype=kinds.get(f.dataType.simpleString(), object)) for f in columns})
            yield pd.concat([batch, side], axis=1)

    return files.mapInPandas(read, StructType([*files.schema.fields, *columns]))


def probe_video(files: DataFrame, path: str = "file_path", program: str = "ffprobe") -> DataFrame:
    """``files`` with the probe's fields; a file the program fails on has a null ``probe_json``. The program has to be on all executors."""
    ship_package(files.sparkSession)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch[path]:
                done = subprocess.run([program, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", p], capture_output=True, text=True, check=False)
                out.append(done.stdout if done.returncode == 0 else None)
            yield batch.assign(probe_json=out)

    rows = files.mapInPandas(probed, StructType([*files.schema.fields, StructField("probe_json", StringType())]))
    return rows.withColumn("probe", probe_fields(F.col("probe_json"))).select(*rows.columns, "probe.*")


def write_sidecars(frames: DataFrame, folder: str) -> None:
    """Frames ``(file_hash, frame_index, timestamp_ms, file_path)`` as CSV, a folder for each video's hash, in frame order."""
    rows = frames.select("file_hash", "frame_index", "timestamp_ms", "file_path")
    rows.repartition("file_hash").sortWithinPartitions("file_hash", "frame_index").write.mode("overwrite").partitionBy("file_hash").csv(folder)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_sidecars`` wrote; a folder that is missing is an error."""
    if not os.path.isdir(folder):
        raise NotFoundError(folder)
    return spark.read.schema("frame_index int, timestamp_ms long, file_path string, file_hash string").option("basePath", folder).csv(folder)
