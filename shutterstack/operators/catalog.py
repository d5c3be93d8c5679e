"""Point reads and merges of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterstack.errors import NotFoundError


def by_id(media: DataFrame, key: str) -> DataFrame:
    return media.where(F.col("id") == key).limit(1)


def by_hash(media: DataFrame, file_hash: str) -> DataFrame:
    return media.where(F.col("file_hash") == file_hash)


def list_page(media: DataFrame, offset: int, limit: int, kind: str | None = None) -> DataFrame:
    """Ids in order, a page of them, with the number of all that match."""
    rows = media.where(F.col("media_type") == kind) if kind else media
    return rows.select("id", "file_name", "media_type").orderBy("id").offset(offset).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())


def upsert(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the rows of ``delta`` put in by key. Keys of ``delta`` should be unique; an empty delta changes nothing."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta.select(*base.columns))


def tombstoned(media: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with the rows of deleted hashes tombstoned."""
    gone = changes.where("kind = 'deleted'").select("file_hash").distinct().withColumn("_gone", F.lit(True))
    return media.join(gone, "file_hash", "left").withColumn("tombstone", F.coalesce("_gone", "tombstone", F.lit(False))).drop("_gone")


def reembedded(media: DataFrame, vectors: DataFrame, model_id: str, model_version: str, now: str) -> DataFrame:
    """Rows whose hash is in ``vectors(file_hash, vector)`` with the new vector and model; all others as they are."""
    new = vectors.groupBy("file_hash").agg(F.max("vector").alias("_vector"))
    rows = media.join(new, "file_hash", "left")
    hit = F.col("_vector").isNotNull()
    values = {"embedding": F.col("_vector"), "model_id": F.lit(model_id), "model_version": F.lit(model_version), "updated_at": F.lit(now)}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_vector")


def activate(models: DataFrame, model_id: str) -> DataFrame:
    """The registry with only ``model_id`` current; an unknown one is an error."""
    if models.where(F.col("model_id") == model_id).isEmpty():
        raise NotFoundError(f"no model {model_id}")
    return models.withColumn("is_current", F.col("model_id") == model_id)


def register(models: DataFrame, model: DataFrame) -> DataFrame:
    """Register or replace models by id; a replaced one stays current, and keeps its time of registration, if it was."""
    kept = models.select("model_id", F.col("is_current").alias("_current"), F.col("registered_at").alias("_at"))
    fresh = model.join(kept, "model_id", "left").withColumns({"is_current": F.coalesce("_current", "is_current"), "registered_at": F.coalesce("_at", "registered_at")})
    return upsert(models, fresh.drop("_current", "_at"), "model_id")


def with_metadata(media: DataFrame, metadata: DataFrame) -> DataFrame:
    """Catalog rows with the media and EXIF columns of their content, where they have none themselves."""
    columns = [c for c in metadata.columns if c in media.columns and c != "file_hash"]
    side = metadata.select("file_hash", *(F.col(c).alias(f"_{c}") for c in columns))
    return media.join(side, "file_hash", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def exif_struct(metadata: DataFrame) -> DataFrame:
    """Metadata with one ``exif`` struct, which is null unless make, model, date or latitude is there."""
    names = [c for c in metadata.columns if c.startswith("exif_")]
    there = F.coalesce("exif_camera_make", "exif_camera_model", "exif_date_taken", F.col("exif_gps_lat").cast("string")).isNotNull()
    whole = F.struct(*(F.col(c).alias(c.removeprefix("exif_")) for c in names))
    return metadata.select(*(c for c in metadata.columns if c not in names), F.when(there, whole).alias("exif"))
