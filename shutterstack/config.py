"""Configuration from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from shutterstack.errors import CatalogError
from shutterstack.operators.transcode import TranscodeConfig
from shutterstack.schemas import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


@dataclass(frozen=True)
class Library:
    paths: list[str] = field(default_factory=list)
    extensions_image: list[str] = field(default_factory=lambda: list(IMAGE_EXTENSIONS))
    extensions_video: list[str] = field(default_factory=lambda: list(VIDEO_EXTENSIONS))


@dataclass(frozen=True)
class Database:
    catalog_path: str = os.path.expanduser("~/.local/share/shutterstack/catalog")
    state_path: str = os.path.expanduser("~/.local/share/shutterstack/state")


@dataclass(frozen=True)
class Embedding:
    model_path: str = ""
    model_id: str = "clip-vit-h-14"
    model_version: str = "1"
    dimensions: int = 1024
    batch_size: int = 16
    execution_provider: str = "cpu"


@dataclass(frozen=True)
class Extraction:
    frame_strategy: str = "adaptive"
    scene_threshold: float = 0.3
    max_interval_seconds: int = 60
    frame_interval_seconds: int = 30
    frame_max_dimension: int = 512
    dedup_similarity_threshold: float = 0.95
    ffprobe_path: str | None = None
    thumbnail_dir: str = os.path.expanduser("~/.local/share/shutterstack/thumbs")


@dataclass(frozen=True)
class Ingest:
    workers: int = 4
    hash_algorithm: str = "sha256"


@dataclass(frozen=True)
class Server:
    port: int = 8080
    host: str = "127.0.0.1"


@dataclass(frozen=True)
class Config:
    library: Library = field(default_factory=Library)
    database: Database = field(default_factory=Database)
    embedding: Embedding = field(default_factory=Embedding)
    extraction: Extraction = field(default_factory=Extraction)
    ingest: Ingest = field(default_factory=Ingest)
    server: Server = field(default_factory=Server)
    transcode: TranscodeConfig = field(default_factory=TranscodeConfig)


def _expanded(value):
    """Paths that begin with a tilde, alone or in a list, with the home folder in its place; other values as they are."""
    if isinstance(value, list):
        return [_expanded(v) for v in value]
    return os.path.expanduser(value) if isinstance(value, str) and value.startswith("~") else value


def parse_config(text: str) -> Config:
    """A configuration; sections and keys that are missing have defaults, unknown ones are an error."""
    try:
        raw = tomllib.loads(text)
        kinds = {f.name: f.default_factory for f in fields(Config)}
        return Config(**{name: kinds[name](**{k: _expanded(v) for k, v in section.items()}) for name, section in raw.items()})
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise CatalogError(f"bad configuration: {e}") from e


def load_config(path: str) -> Config:
    with open(path) as file:
        return parse_config(file.read())
