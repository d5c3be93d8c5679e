"""Names, extensions and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterstack.schemas import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def media_type(path: Column, unknown: str | None = None) -> Column:
    """'image' or 'video' by extension, the image list first; ``unknown`` otherwise."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise(F.lit(unknown))
