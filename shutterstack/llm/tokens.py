"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shutterstack.session import ship_package

#: Ranks of a byte-level BPE with 50,256 entries; the file has to be at this path on every executor.
TOKENIZER = os.environ.get("SHUTTERSTACK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that this vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once in a worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text; 0 for null and empty texts. Strings of special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_sizes(documents: DataFrame, *columns: str, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``columns`` of every row and ``n_tokens`` long, the tokens of its whole text.

    Texts cross to Python in Arrow batches and don't come back; nothing is shuffled.
    """
    ship_package(documents.sparkSession)
    schema = documents.select(*columns).schema.add("n_tokens", "long", False)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = np.fromiter((len(encode(t.as_py())) if t.is_valid else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*columns, "n_tokens"])

    return documents.select(*columns, text).mapInArrow(sized, schema)
