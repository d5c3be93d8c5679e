"""Files on disk, versioned tables, streams, the application, its command line and its service."""

import hashlib
import io
import json
import struct
import threading
import time
import urllib.error
import urllib.request
import zlib

import pytest
from pyspark.sql import functions as F

from shutterstack import cli, schemas
from shutterstack.app import Catalog
from shutterstack.config import Config, parse_config
from shutterstack.encoders import HashingEncoder, pad
from shutterstack.errors import CatalogError, NotFoundError, StorageError
from shutterstack.http import server
from shutterstack.sources.scan import exif_fields, image_metadata, image_size, probe_video, read_sidecars, scan_directory, write_sidecars
from shutterstack.sources.storage import Table
from shutterstack.streaming.ingest import ingest, progress, reduce_stream, watch


def png(w, h):
    body = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(w, h):
    """A header with an EXIF block: orientation 6, model K7, 40 degrees 30 minutes south."""
    text, gps_at = b"K7\x00\x00", 8 + 2 + 3 * 12 + 4
    main = struct.pack("<HHHI4s", 3, 0x0110, 2, 3, text) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + b"\0" * 4
    values = gps_at + 2 + 2 * 12 + 4
    gps = struct.pack("<HHHI4s", 2, 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, values) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + main + gps + struct.pack("<6I", 40, 1, 30, 1, 0, 1)
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 12


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "library"
    (root / "sub" / "deep").mkdir(parents=True)
    files = {"a.jpg": jpeg(40, 30), "sub/B.PNG": png(64, 48), "sub/deep/c.mp4": b"video" * 30000, "zero.jpg": b"", ".hid.jpg": b"x", "_u.gif": b"GIF89a" + struct.pack("<HH", 5, 7), "note.txt": b"no", "sub/x.pdf": b"no"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


def test_scan(spark, library):
    rows = {r["file_path"].removeprefix(str(library) + "/"): r for r in scan_directory(spark, str(library)).collect()}
    assert set(rows) == {"a.jpg", "sub/B.PNG", "sub/deep/c.mp4", "zero.jpg", ".hid.jpg", "_u.gif"}
    assert rows["zero.jpg"]["file_hash"] == hashlib.sha256().hexdigest() and rows["sub/deep/c.mp4"]["file_hash"] == hashlib.sha256(b"video" * 30000).hexdigest()
    assert rows["sub/deep/c.mp4"]["media_type"] == "video" and rows["sub/deep/c.mp4"]["file_size"] == 150000
    with pytest.raises(NotFoundError):
        scan_directory(spark, str(library / "missing"))
    known = spark.createDataFrame([(r["file_path"], r["file_size"], r["file_modified"], "old") for r in rows.values()], "file_path string, file_size long, file_modified string, file_hash string")
    assert {r["file_hash"] for r in scan_directory(spark, str(library), known).collect()} == {"old"}


def test_headers(spark, library):
    assert image_size(png(640, 480)) == (640, 480) and image_size(jpeg(40, 30)) == (40, 30) and image_size(b"") == (None, None)
    assert exif_fields(jpeg(1, 1)) == {"exif_camera_model": "K7", "exif_orientation": 6, "exif_gps_lat": -40.5} and exif_fields(b"\xff\xd8Exif\0\0II") == {}
    df = spark.createDataFrame([(str(library / "a.jpg"),), (str(library / "gone.jpg"),), (None,)], "file_path string")
    rows = {r["file_path"]: (r["width"], r["exif_camera_model"], r["exif_iso"]) for r in image_metadata(df).collect()}
    assert rows == {str(library / "a.jpg"): (40, "K7", None), str(library / "gone.jpg"): (None, None, None), None: (None, None, None)}


def test_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), schemas.CONFIG, "key")
    (tmp_path / "t").mkdir()
    assert table.version() is None and table.count() == 0
    table.upsert(spark.createDataFrame([("a", "1", "t"), ("b", "1", "t")], schemas.CONFIG))
    first = table.version()
    table.upsert(spark.createDataFrame([("b", "2", "t")], schemas.CONFIG))
    assert {r["key"]: r["value"] for r in table.read().collect()} == {"a": "1", "b": "2"} and table.version() != first
    assert table.upsert(spark.createDataFrame([], schemas.CONFIG)) == table.version()
    spark.createDataFrame([("1",)], "value string").write.parquet(str(tmp_path / "t" / "bad"))
    (tmp_path / "t" / "CURRENT").write_text("bad")
    with pytest.raises(StorageError):
        table.read()


def test_streams(spark, tmp_path):
    schema = schemas.CONFIG
    (tmp_path / "t").mkdir()
    table = Table(spark, str(tmp_path / "t"), schema, "key")
    for values in ([("a", "1", "1"), ("a", "0", "0")], [("a", "2", "2"), ("b", "1", "1")]):
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(watch(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "check")).awaitTermination(60)
    assert {r["key"]: r["value"] for r in table.read().collect()} == {"a": "2", "b": "1"}
    # a row that is older than the stored one comes late
    spark.createDataFrame([("a", "late", "1"), ("b", "3", "3")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(watch(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "check")).awaitTermination(60)
    assert {r["key"]: r["value"] for r in table.read().collect()} == {"a": "2", "b": "3"}


def test_tables_by_their_address_and_old_versions(spark, tmp_path):
    """A folder with a scheme goes through the file system of that scheme; of many versions the newest stay."""
    (tmp_path / "u").mkdir()
    for folder in (f"file://{tmp_path}/u", str(tmp_path / "u")):
        table = Table(spark, folder, schemas.CONFIG, "key")
        for i in range(6):
            table.upsert(spark.createDataFrame([("a", str(i), "t")], schemas.CONFIG))
        assert table.read().first()["value"] == "5" and len([p for p in (tmp_path / "u").iterdir() if p.name.startswith("v-")]) == 4


def test_stateful_fold(spark, tmp_path):
    schema = "video string, frame_index int, id string, embedding array<float>"
    parts = [[("v", 0, "a", [1.0, 0.0]), ("v", 1, "b", [1.0, 0.0])], [("v", 2, "c", [1.0, 0.0]), ("v", 3, "d", [0.0, 1.0]), ("w", 0, "e", [1.0, 0.0])]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = reduce_stream(watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "d", "e"]


def test_progress_stream(spark, sample, tmp_path):
    events = spark.read.parquet(f"{sample}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = progress(watch(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert 0 < spark.table("seen").agg(F.sum("n")).first()[0] <= events.count()


@pytest.fixture
def catalog(spark, tmp_path):
    ticks = iter(range(1, 10_000))
    return Catalog(spark, str(tmp_path / "catalog"), HashingEncoder(16), clock=lambda: f"2024-01-01T{next(ticks) // 3600 % 24:02}:00:00Z")


def test_life_of_a_catalog(catalog, library):
    assert catalog.scan(str(library)) == {"new": 6}
    assert catalog.read("jobs").count() == 24
    assert catalog.scan(str(library)) == {"unchanged": 6} and catalog.read("jobs").count() == 24
    assert catalog.ingest() == {"extract_frames": 6, "extract_metadata": 6, "embed": 6, "index": 6}
    rows = {r["file_name"]: r for r in catalog.read("media").collect()}
    assert len(rows) == 5 and (rows["B.PNG"]["width"], rows["a.jpg"]["exif_camera_model"]) == (64, "K7")
    assert catalog.ingest() == {"extract_frames": 0, "extract_metadata": 0, "embed": 0, "index": 0} and catalog.progress() == {"done": 24, "total": 24}
    (library / "a.jpg").rename(library / "moved.jpg")
    (library / "zero.jpg").unlink()
    (library / "_u.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 9, 9))
    assert catalog.scan(str(library)) == {"unchanged": 3, "moved": 1, "deleted": 2, "modified": 1}
    assert {r["file_name"] for r in catalog.read("media").where("tombstone").collect()} == {"zero.jpg", "_u.gif"}
    assert catalog.browse().count() == 3 and catalog.browse_files(kind="video").count() == 1
    assert catalog.search("anything at all", 2).count() == 2
    catalog.register_model("m2", "1")
    catalog.activate_model("m2")
    assert catalog.reembed("m2", "1") == 5 and catalog.reembed("m2", "1") == 0


def test_videos_are_probed_where_the_program_is(catalog, library, tmp_path, monkeypatch):
    """A stand-in that prints a fixed probe for one file and fails on others."""
    (library / "bad.mp4").write_bytes(b"?")
    tool = tmp_path / "bin" / "ffprobe"
    tool.parent.mkdir()
    tool.write_text('#!/bin/sh\nfor last; do :; done\ncase "$last" in *bad*) exit 1;; esac\n' + """echo '{"streams":[{"codec_type":"video","codec_name":"h264","width":640,"height":360,"r_frame_rate":"25/1"}],"format":{"duration":"2.5","bit_rate":"800000"}}'\n""")
    tool.chmod(0o755)
    monkeypatch.setattr("shutterstack.app.shutil.which", lambda name: str(tool))
    monkeypatch.setattr("shutterstack.app.probe_video", lambda df: probe_video(df, program=str(tool)))
    catalog.scan(str(library))
    catalog.ingest(("extract_metadata",))
    rows = catalog.read("metadata").where("codec is not null").collect()
    assert [(r["width"], r["duration_ms"], r["bitrate_kbps"], r["fps"]) for r in rows] == [(640, 2500, 800, 25.0)]
    assert [r["file_path"].rsplit("/", 1)[1] for r in catalog.read("jobs").where("status = 'failed'").collect()] == ["bad.mp4"]


def test_command_line(catalog, library):
    say = lambda *argv: (lambda out: (cli.run(cli.parser().parse_args(argv), catalog, Config(), out), out.getvalue())[1])(io.StringIO())
    assert json.loads(say("scan", str(library))) == {"new": 6}
    assert json.loads(say("ingest", "--stages", "metadata, embed"))["embed"] == 6
    assert len(say("search", "some words", "--type", "image", "--limit", "3").splitlines()) == 3
    assert json.loads(say("status"))["catalog"] == 5 and say("config", "root", "/x") == "/x\n" and say("config", "none") == "None\n"
    assert "No exact" in say("dedup", "--tier", "exact") and json.loads(say("transcode"))["videos"] == 0 and "ffmpeg" in say("setup")
    assert say("reembed", "m3") == "6 jobs\n"


def test_service(catalog, library):
    catalog.scan(str(library))
    catalog.ingest()
    web = server(catalog, "127.0.0.1", 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{web.server_address[1]}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    found = call("/api/search", {"query": "some words", "limit": 2})[1]
    assert len(found) == 2 and call(f"/api/media/{found[0]['id']}")[1]["id"] == found[0]["id"] and call("/api/media/none")[0] == 404
    assert call("/api/search", {"query": "type:image"})[0] == 400 and call("/api/nothing")[0] == 404
    assert call("/api/stats")[1] == {"total": 5} and call("/api/stats/full")[1]["files_active"] == 6 and call("/api/dedup?tier=exact")[1] == {"exact": []} and call("/api/dedup?tier=x")[0] == 400
    assert len(call("/api/browse?sort=name&per_page=2")[1]) == 2 and len(call("/api/files?kind=image")[1]) == 5 and call("/api/setup/status")[1]["catalog"]
    assert call("/api/scan", {"path": str(library / "missing")})[0] == 202
    for _ in range(100):
        state = call("/api/progress")[1]
        if state["running"] is None:
            break
        time.sleep(0.1)
    assert state["message"].startswith("error") and state["done"] == state["total"]
    request = urllib.request.Request(f"http://127.0.0.1:{web.server_address[1]}/api/progress", headers={"Accept": "text/event-stream"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        assert answer.read().startswith(b"data: {")
    web.shutdown()


def test_config_and_encoder():
    config = parse_config('[library]\npaths = ["/x"]\n[transcode]\nenabled = true\nmax_resolution = "720p"\n')
    assert config.library.paths == ["/x"] and config.transcode.enabled and config.server.port == 8080
    for bad in ("[nope]\na = 1", "[server]\nnope = 1", "= ="):
        with pytest.raises(CatalogError):
            parse_config(bad)
    e = HashingEncoder(16)
    assert e.encode_text("a b") == e.encode_text("A  b") and abs(sum(x * x for x in e.encode_text("a b c")) - 1) < 1e-9
    assert pad([1, 2], 4) == [1, 2, 0, 0] and pad([1] * 9, 4, 7) == [1, 1, 1, 7]


def test_sidecars(spark, tmp_path):
    rows = [("aa", 1, 33, "/f/2.jpg"), ("aa", 0, 0, "/f/1, with comma.jpg"), ("bb", 0, 0, None)]
    write_sidecars(spark.createDataFrame(rows, "file_hash string, frame_index int, timestamp_ms long, file_path string"), str(tmp_path / "s"))
    assert sorted((r["file_hash"], r["frame_index"], r["timestamp_ms"], r["file_path"]) for r in read_sidecars(spark, str(tmp_path / "s")).collect()) == sorted(rows)
    with pytest.raises(NotFoundError):
        read_sidecars(spark, str(tmp_path / "none"))
