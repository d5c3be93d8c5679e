"""Schemas of the catalog's tables. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType, TimestampNTZType

_TYPES: dict[str, DataType] = {
    "string": StringType(), "long": LongType(), "int": IntegerType(), "float": FloatType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp_ntz": TimestampNTZType(), "array<float>": ArrayType(FloatType()),
}


def _schema(text: str) -> StructType:
    """A schema from 'name type [not null], ...'; unlike the DDL parser it needs no session."""
    out = StructType()
    for field in text.split(", "):
        name, kind, *rest = field.split(" ")
        out.add(name, _TYPES[kind], not rest)
    return out


MEDIA = _schema(
    "id string not null, file_hash string not null, file_path string not null, file_name string not null, file_size long not null, file_ext string not null, media_type string not null, "
    "embedding array<float> not null, model_id string not null, model_version string not null, width int, height int, duration_ms long, fps float, codec string, bitrate_kbps int, "
    "exif_camera_make string, exif_camera_model string, exif_date_taken string, exif_gps_lat double, exif_gps_lon double, exif_focal_length_mm float, exif_iso int, exif_orientation int, "
    "source_video_path string, frame_index int, frame_timestamp_ms long, file_created string, file_modified string, indexed_at string not null, updated_at string not null, tombstone boolean not null"
)
FILES = _schema("file_hash string not null, file_path string not null, file_size long, file_modified string, first_seen string, last_seen string, status string")
JOBS = _schema(
    "id long not null, file_hash string, file_path string, stage string, status string, attempts int, max_attempts int, error_message string, created_at timestamp_ntz, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, worker_id string, model_id string, model_version string"
)
MODELS = _schema("model_id string not null, model_version string, model_path string, dimensions int, is_current boolean, registered_at string")
CONFIG = _schema("key string not null, value string, updated_at string")
METADATA = _schema(
    "file_hash string not null, width int, height int, duration_ms long, fps float, codec string, bitrate_kbps int, exif_camera_make string, exif_camera_model string, exif_date_taken string, "
    "exif_gps_lat double, exif_gps_lon double, exif_focal_length_mm float, exif_iso int, exif_orientation int, extracted_at string"
)
PROBE = "streams array<struct<codec_type string, codec_name string, width int, height int, r_frame_rate string>>, format struct<duration string, bit_rate string>"

# Stages of the queue, those a new file is enqueued for, the states of a job, and the extensions of media files.
STAGES = ("extract_metadata", "extract_frames", "embed", "index", "re_embed", "transcode")
ENQUEUED = ("extract_metadata", "extract_frames", "embed", "index")
STATUSES = ("pending", "running", "completed", "failed", "skipped")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "heic", "heif", "avif")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "flv", "mpg", "mpeg")
