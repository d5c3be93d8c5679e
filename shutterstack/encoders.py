"""Text and image encoders: what they have to offer, one that needs no model, and one over ONNX files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from shutterstack.errors import NotFoundError
from shutterstack.session import ship_package

TOKENS, END = 77, 49407
# Channel means and deviations of the image models' training data.
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


class TextEncoder(Protocol):
    def encode_text(self, text: str) -> list[float]: ...


class ImageEncoder(Protocol):
    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Every row at unit length on its own; rows of almost no length stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1.1920929e-7, x, x / np.maximum(n, 1.1920929e-7))


class HashingEncoder:
    """Words and byte blocks hashed into a vector: deterministic, without a model, for tests and dry runs."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vector(self, parts: list[bytes]) -> np.ndarray:
        v = np.zeros(self.dim)
        for part in parts:
            digest = int.from_bytes(hashlib.sha256(part).digest()[:8], "big")
            v[digest % self.dim] += 1 if digest >> 32 & 1 else -1
        return v

    def encode_text(self, text: str) -> list[float]:
        return unit_rows(self._vector([w.encode() for w in text.lower().split()])[None])[0].tolist()

    def encode_images(self, images: list[bytes]) -> np.ndarray:
        return unit_rows(np.stack([self._vector([data[i : i + 64] for i in range(0, len(data), 64)]) for data in images])) if images else np.zeros((0, self.dim))


def pad(ids: list[int], length: int = TOKENS, end: int = END) -> list[int]:
    """Token ids cut to ``length`` with ``end`` as the last one, or filled up with zeros."""
    return [*ids[: length - 1], end] if len(ids) > length else ids + [0] * (length - len(ids))


def normalise_pixels(rgb: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes to 1 x 3 x height x width floats, centred and scaled by channel."""
    scaled = (rgb.astype(np.float32) / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)
    return scaled.transpose(2, 0, 1)[None]


class OnnxTextEncoder:
    """A text model and its tokenizer from a folder ($SHUTTERSTACK_MODEL_DIR by default)."""

    def __init__(self, folder: str | None = None, model: str = "text.onnx", tokenizer: str = "tokenizer.json"):
        folder = folder or os.environ.get("SHUTTERSTACK_MODEL_DIR", "")
        self._paths = [os.path.join(folder, name) for name in (model, tokenizer)]
        for path in self._paths:
            if not os.path.exists(path):
                raise NotFoundError(path)
        self._loaded = None

    def encode_text(self, text: str) -> list[float]:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self._loaded = onnxruntime.InferenceSession(self._paths[0]), Tokenizer.from_file(self._paths[1])
        session, tokenizer = self._loaded
        ids = np.array([pad(tokenizer.encode(text).ids)], dtype=np.int64)
        out = session.run(None, {session.get_inputs()[0].name: ids})[0]
        return unit_rows(out.reshape(1, -1).astype(np.float64))[0].tolist()


def _encoded(encoder: ImageEncoder, images: list[bytes]) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each image; where a batch fails its images are tried one by one."""
    try:
        return [(v.tolist(), None) for v in encoder.encode_images(images)]
    except Exception as e:  # any decoder's error belongs to its image
        if len(images) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [one for data in images for one in _encoded(encoder, [data])]


def embed_images(files: DataFrame, encoder: ImageEncoder, path: str = "file_path", batch: int = 16) -> DataFrame:
    """Rows ``(path, embedding, error)``: the files' vectors. A missing file is left out; one that can't be read or decoded has an error instead and stops no other."""
    ship_package(files.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            there = [p for p in frame[path] if p and os.path.exists(p)]
            for i in range(0, len(there), batch):
                found: dict[str, tuple] = {}
                images = []
                for p in there[i : i + batch]:
                    try:
                        with open(p, "rb") as file:
                            images.append((p, file.read()))
                    except OSError as e:
                        found[p] = (None, str(e))
                if images:
                    found |= dict(zip((p for p, _ in images), _encoded(encoder, [data for _, data in images])))
                yield pd.DataFrame({path: list(found), "embedding": [v for v, _ in found.values()], "error": [e for _, e in found.values()]})

    return files.select(path).mapInPandas(encode, f"{path} string, embedding array<float>, error string")
