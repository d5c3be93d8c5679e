"""The catalog's tables as views of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterstack.functions.text import folded
from shutterstack.functions.vectors import usable
from shutterstack.operators.current import current_rows
from shutterstack.schemas import MEDIA, STAGES
from shutterstack.session import read_table

DIM = 64


def media(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows of the catalog with ``columns``, or all of them. Name what is needed: nothing else is read, above all no vector."""
    return current_rows(read_table(spark, folder, "media"), *(columns or (f.name for f in MEDIA if f.name != "id")))


def vectors(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current rows with a usable vector, ``columns`` besides."""
    return media(spark, folder, *columns, "embedding").where(usable(F.col("embedding"), DIM))


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector of the smallest id that has one."""
    rows = read_table(spark, folder, "media").select("id", "updated_at", "embedding")
    fine = current_rows(rows.select("id", "updated_at", usable(F.col("embedding"), DIM).alias("fine")), "fine").where("fine")
    least = fine.agg(F.min("id")).first()[0]
    return [float(x) for x in current_rows(rows.where(F.col("id") == least), "embedding").first()["embedding"]]


def files(spark: SparkSession, folder: str, back: int = 0) -> DataFrame:
    """The files table as of the last delivered snapshot, or ``back`` snapshots before it: one row per path, the one last seen."""
    rows = read_table(spark, folder, "files").where("file_path is not null")
    numbers = [r[0] for r in rows.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(back + 1).collect()]
    columns = ("file_hash", "file_size", "file_modified", "first_seen", "status")
    one = rows.where(F.col("snapshot_no") == (numbers[back] if len(numbers) > back else -1)).groupBy("file_path").agg(F.max(F.struct("last_seen", *columns)).alias("r"))
    return one.select(folded("r.file_hash").alias("file_hash"), "file_path", "r.file_size", "r.file_modified", "r.first_seen", "r.last_seen", folded("r.status").alias("status"))


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The active files of the last snapshot, as a scan finds them."""
    return files(spark, folder).where("status = 'active' and file_hash is not null").select("file_hash", "file_path", "file_size", "file_modified")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a job queue; each job is about a file of the stored snapshot's hash range by user."""
    status = F.create_map(*(F.lit(x) for pair in (("view", "pending"), ("click", "running"), ("purchase", "completed"), ("error", "failed"), ("signup", "skipped")) for x in pair))
    e = read_table(spark, folder, "events")
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 6).cast("int"))
    state = F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("pending"))
    return e.select(
        F.col("event_id").alias("id"), F.sha2(F.col("user_id").cast("string"), 256).alias("file_hash"), F.concat(F.lit("/u/"), "user_id").alias("file_path"), stage.alias("stage"), state.alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("created_at"), F.when(state == "running", F.col("ts")).alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.when(state == "running", F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string"))).alias("worker_id"),
    )


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Media and EXIF values per content hash: those of the row updated last, of equally recent rows the one with the greatest id."""
    names = ["width", "height", "duration_ms", "fps", "codec", "bitrate_kbps", "exif_camera_make", "exif_camera_model", "exif_date_taken", "exif_gps_lat", "exif_gps_lon", "exif_focal_length_mm", "exif_iso", "exif_orientation"]
    rows = media(spark, folder, "updated_at", "file_hash", "media_type", *names).where("media_type <> 'video_frame'").groupBy(folded("file_hash").alias("file_hash")).agg(F.max(F.struct("updated_at", "id", *names)).alias("r"))
    return rows.select("file_hash", *(F.col("r")[c].alias(c) for c in names))


def models(spark: SparkSession) -> DataFrame:
    rows = [("clip-vit-h-14", "1", 1024, True), ("clip-vit-l-14", "1", 768, False), ("clip-vit-b-32", "2", 512, False)]
    return spark.createDataFrame(rows, "model_id string, model_version string, dimensions int, is_current boolean")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with a usable vector and the video they are from."""
    rows = vectors(spark, folder, "media_type", "source_video_path", "frame_index").where("media_type = 'video_frame' and source_video_path is not null")
    return rows.select(F.col("source_video_path").alias("video"), "frame_index", "id", "embedding")
