"""Browsing pages and catalog statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterstack.functions.paths import basename, extension, media_type

MOST_PER_PAGE = 200


def _page(df: DataFrame, order: list, page: int, per_page: int) -> DataFrame:
    size = max(1, min(MOST_PER_PAGE, per_page))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def browse(media: DataFrame, kind: str | None = None, sort: str = "date", page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of the catalog without tombstones, with the ``total`` before paging.

    ``kind`` 'image' or 'video' (which includes frames); anything else is all. ``sort``: 'name' (any case, ascending),
    'size' or, by default, indexed_at, both descending; ties by id. The vectors are never read.
    """
    kinds = {"image": ["image"], "video": ["video", "video_frame"]}.get((kind or "").lower())
    rows = media.where(~F.coalesce("tombstone", F.lit(False)))
    rows = rows.where(F.col("media_type").isin(kinds)) if kinds else rows
    order = {"name": [F.lower("file_name")], "size": [F.desc_nulls_last("file_size")]}.get(sort, [F.desc_nulls_last("indexed_at")])
    shown = rows.select("id", "file_name", "file_path", "media_type", "file_size", "indexed_at")
    return _page(shown, [*order, "id"], page, per_page).withColumn("total", rows.agg(F.count("*")).scalar())


def browse_files(files: DataFrame, kind: str | None = None, sort: str = "name", page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of the active files with their names and types by extension, and the ``total`` before paging."""
    rows = files.where("status = 'active'").select("file_hash", "file_path", "file_size", "file_modified", basename(F.col("file_path")).alias("file_name"), media_type(F.col("file_path"), "unknown").alias("media_type"))
    rows = rows.where(F.col("media_type") == kind) if kind in ("image", "video") else rows
    order = {"size": [F.desc_nulls_last("file_size")], "date": [F.desc_nulls_last("file_modified")]}.get(sort, [F.lower("file_name")])
    return _page(rows, [*order, "file_path"], page, per_page).withColumn("total", rows.agg(F.count("*")).scalar())


def classify(files: DataFrame) -> DataFrame:
    """Path, extension and media type of the files that are media."""
    rows = files.select("file_path", extension(F.col("file_path")).alias("ext"), media_type(F.col("file_path")).alias("media_type"))
    return rows.where("media_type is not null")


def catalog_stats(media: DataFrame, files: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    """One row per figure: rows of the catalog, active files, jobs by status, models."""
    counts = [
        media.agg(F.lit("catalog").alias("metric"), F.count("*").alias("value")),
        files.agg(F.lit("files_active"), F.count_if(F.col("status") == "active")),
        models.agg(F.lit("models"), F.count("*")),
    ]
    by_status = jobs.groupBy(F.concat(F.lit("jobs_"), "status").alias("metric")).agg(F.count("*").alias("value"))
    out = by_status
    for c in counts:
        out = out.union(c)
    return out


def files_by(files: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of the files table with a hash or a path, whatever their status: a filter that reaches the scan."""
    return files.where(F.col(column) == value)
