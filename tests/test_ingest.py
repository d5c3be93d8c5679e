"""Ingest works off a queue that is longer than one claim."""

from shutterstack.app import Catalog
from shutterstack.encoders import HashingEncoder


def test_every_stage_is_worked_off(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("shutterstack.app.CLAIMED", 2)
    (tmp_path / "files").mkdir()
    for i in range(3):
        (tmp_path / "files" / f"{i}.gif").write_bytes(b"GIF89a" + bytes([i + 1, 0, 9, 0]))
    catalog = Catalog(spark, str(tmp_path / "catalog"), HashingEncoder(16), clock=lambda: "2024-01-01T00:00:00Z")
    assert catalog.scan(str(tmp_path / "files")) == {"new": 3}
    stages = ("extract_metadata", "index")
    assert catalog.ingest(stages) == {stage: 3 for stage in stages}
    assert catalog.read("jobs").where("status = 'pending'").where("stage in ('extract_metadata', 'index')").count() == 0
    assert catalog.read("metadata").count() == 3
