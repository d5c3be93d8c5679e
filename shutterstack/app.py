"""The catalog as an application: its tables in one folder, and what the command line and the web service do with them."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shutterstack import schemas
from shutterstack.config import Extraction
from shutterstack.encoders import HashingEncoder, embed_images
from shutterstack.errors import NotFoundError
from shutterstack.functions.media import frame_time
from shutterstack.functions.paths import basename, extension, media_type
from shutterstack.operators import browse, catalog, changes, dedup, jobs, knn, search, transcode
from shutterstack.operators.frames import reduce_frames, video_embeddings_of
from shutterstack.session import checkpointed
from shutterstack.sources.programs import extract_frames, listed_frames, transcode_videos
from shutterstack.sources.scan import image_metadata, probe_video, scan_directory
from shutterstack.sources.storage import Table


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


#: Jobs of a stage claimed at a time.
CLAIMED = 1_000_000


class Catalog:
    """All tables of one catalog. One process writes at a time; readers always see whole versions."""

    def __init__(self, spark: SparkSession, folder: str, encoder=None, model_id: str = "hashing", model_version: str = "1", clock=_now, extraction: Extraction | None = None, transcoding: transcode.TranscodeConfig | None = None):
        self.spark, self.folder, self.clock = spark, folder, clock
        self.encoder, self.model_id, self.model_version = encoder or HashingEncoder(), model_id, model_version
        self.extraction, self.transcoding = extraction or Extraction(), transcoding or transcode.TranscodeConfig()
        os.makedirs(folder, exist_ok=True)
        kinds = {"media": (schemas.MEDIA, "id"), "files": (schemas.FILES, "file_path"), "jobs": (schemas.JOBS, "id"), "models": (schemas.MODELS, "model_id"), "config": (schemas.CONFIG, "key"), "metadata": (schemas.METADATA, "file_hash")}
        self.tables = {name: Table(spark, os.path.join(folder, name), schema, key) for name, (schema, key) in kinds.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def scan(self, root: str) -> dict[str, int]:
        """Scan a folder, write files and jobs, tombstone what is gone; counts by kind of change."""
        files = self.read("files")
        scanned = scan_directory(self.spark, root, files.where("status = 'active'")).persist()
        found = changes.detect_changes(files, scanned, root).persist()
        counts = {r["kind"]: r["n"] for r in changes.change_summary(found).collect()}
        now, state = self.clock(), changes.apply_changes(files, found)
        sizes = scanned.select("file_hash", "file_path", F.col("file_size").alias("_size"), F.col("file_modified").alias("_modified"))
        old = files.select("file_hash", "file_path", "file_size", "file_modified", "first_seen", "last_seen")
        keys = ["file_hash", "file_path"]
        rows = state.join(old, keys, "left").join(sizes, keys, "left").select(
            *keys, F.coalesce("_size", "file_size").alias("file_size"), F.coalesce("_modified", "file_modified").alias("file_modified"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
            F.when(F.col("_size").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"), "status",
        )
        queue = self.read("jobs")
        fresh = jobs.enqueue_changes(found, queue).join(found.groupBy("file_hash").agg(F.max("file_path").alias("file_path")), "file_hash")
        top = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.tables["jobs"].overwrite(jobs.update_paths(queue, found).unionByName(self._new_jobs(fresh, top, now), allowMissingColumns=True))
        self.tables["files"].overwrite(rows)
        if counts.get("deleted") and self.tables["media"].version():
            self.tables["media"].overwrite(catalog.tombstoned(self.read("media"), found))
        self.set("last_scan_time", now)
        for df in (scanned, found):
            df.unpersist()
        return counts

    def _new_jobs(self, fresh: DataFrame, top: int, now: str) -> DataFrame:
        stamp = F.to_timestamp_ntz(F.lit(now.rstrip("Z")))
        numbered = fresh.withColumn("id", F.monotonically_increasing_id() + top + 1)
        return numbered.withColumns({"attempts": F.lit(0), "max_attempts": F.lit(3), "created_at": stamp})

    def _stamp(self):
        return F.to_timestamp_ntz(F.lit(self.clock().rstrip("Z")))

    def ingest(self, stages: tuple[str, ...] = ("extract_frames", "extract_metadata", "embed", "index"), worker: str = "local") -> dict[str, int]:
        """Work off the queue stage by stage, each until nothing can be claimed. Jobs done by stage.

        A batch of jobs is claimed by one commit, with its start and one more attempt, so that a run that dies leaves a trace; then the work is one
        transformation, whose results are committed before its outcomes. Jobs that were running when a run began go back into the queue, but
        none is claimed more than its ``max_attempts`` times.
        """
        table = self.tables["jobs"]
        table.overwrite(jobs.reset_running(self.read("jobs")))
        done = {}
        for stage in stages:
            done[stage], n = 0, 1
            while n:
                queue = self.read("jobs")
                claims = jobs.claim(queue.where(F.col("stage") == stage), worker, CLAIMED, now=self._stamp()).persist()
                n = claims.count()
                if n:
                    table.overwrite(jobs.claimed(queue, claims))
                    running = self.read("jobs").where((F.col("stage") == stage) & (F.col("status") == "running"))
                    outcomes = self._work(stage, running).persist()
                    table.overwrite(jobs.transition(self.read("jobs"), outcomes, self._stamp()))
                    outcomes.unpersist()
                claims.unpersist()
                done[stage] += n
        return done

    def _work(self, stage: str, claimed: DataFrame) -> DataFrame:
        """Do one stage for claimed jobs; rows ``(id, outcome, message)``."""
        kind = media_type(F.col("file_path"), "image")
        images, videos = claimed.where(kind == "image"), claimed.where(kind == "video")
        works = {"extract_metadata": self._metadata, "extract_frames": self._frames, "embed": self._embed, "re_embed": self._embed_again, "transcode": self._transcode}
        if stage in works:
            return works[stage](claimed, images, videos)
        return self._outcomes(claimed, "completed" if stage == "index" else "skipped")

    @staticmethod
    def _outcomes(rows: DataFrame, outcome, message=None) -> DataFrame:
        return rows.select("id", (outcome if isinstance(outcome, Column) else F.lit(outcome)).alias("outcome"), (F.lit(None).cast("string") if message is None else message).alias("message"))

    def _full(self, rows: DataFrame, schema: StructType) -> DataFrame:
        """``rows`` with all columns of a table, null where they have none."""
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def _metadata(self, claimed: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
        read = image_metadata(images.select("file_hash", "file_path").dropDuplicates(["file_hash"])).drop("file_path").withColumn("extracted_at", F.lit(self.clock()))
        self.tables["metadata"].upsert(self._full(read, schemas.METADATA))
        if not shutil.which("ffprobe"):
            return self._outcomes(images, "completed").unionByName(self._outcomes(videos, "skipped"))
        probed = checkpointed(probe_video(videos.select("file_hash", "file_path").dropDuplicates(["file_hash"])))
        known = probed.where("probe_json is not null").withColumn("extracted_at", F.lit(self.clock()))
        self.tables["metadata"].upsert(self._full(known, schemas.METADATA))
        rows = videos.join(known.select("file_hash", F.lit(True).alias("_ok")), "file_hash", "left")
        return self._outcomes(images, "completed").unionByName(self._outcomes(rows, F.when(F.col("_ok"), "completed").otherwise("failed"), F.when(F.col("_ok").isNull(), "probe failed")))

    @property
    def frames_folder(self) -> str:
        return os.path.join(os.path.abspath(self.folder), "frames")

    def _frames(self, claimed: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
        """Frames of videos as files, a folder for each content hash; images have none. Without the program the jobs are skipped."""
        program = shutil.which("ffmpeg")
        if not program:
            return self._outcomes(claimed, "skipped")
        e = self.extraction
        written = checkpointed(extract_frames(videos.select("file_hash", "file_path").dropDuplicates(["file_hash"]), self.frames_folder, program, strategy=e.frame_strategy, seconds=e.max_interval_seconds, scene=e.scene_threshold, side=e.frame_max_dimension))
        rows = videos.join(written, "file_hash", "left")
        return self._outcomes(images, "skipped").unionByName(self._outcomes(rows, F.when(F.col("error").isNull(), "completed").otherwise("failed"), F.col("error")))

    def _vectors(self, images: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(file_hash, file_path, embedding, error)`` of images and, pooled over their frames, of videos; and the frames that differ, with ``frame_index``, ``video`` and ``ts_ms``."""
        listed = checkpointed(listed_frames(videos.dropDuplicates(["file_hash"]), self.frames_folder))
        paths = images.select("file_path").unionByName(listed.select("file_path")).distinct()
        vectors = checkpointed(embed_images(paths, self.encoder))
        of_images = vectors.join(images.select("file_path", "file_hash").distinct(), "file_path").select("file_hash", "file_path", "embedding", "error")
        seen = listed.join(vectors.where("embedding is not null"), "file_path").select("video", "frame_index", F.col("file_path").alias("id"), "embedding")
        kept = checkpointed(reduce_frames(seen, self.extraction.dedup_similarity_threshold))
        pooled = video_embeddings_of(kept).select(F.col("video").alias("file_path"), F.col("embedding").cast("array<float>").alias("embedding"))
        of_videos = pooled.join(videos.select("file_path", "file_hash").dropDuplicates(["file_path"]), "file_path").select("file_hash", "file_path", "embedding", F.lit(None).cast("string").alias("error"))
        known = self.read("metadata").select("file_hash", "fps", "duration_ms")
        at = listed.join(known, "file_hash", "left").select("file_hash", "file_path", frame_time(F.col("file_path"), F.col("frame_index"), F.col("total"), F.col("fps"), F.col("duration_ms")).alias("ts_ms"))
        frames = kept.withColumnRenamed("id", "file_path").join(at, "file_path")
        return checkpointed(of_images.unionByName(of_videos)), frames

    def _embed(self, claimed: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
        vectors, frames = self._vectors(images, videos)
        media = self.tables["media"]
        media.upsert(self._records(vectors.where("embedding is not null")))
        media.upsert(self._frame_records(frames))
        return self._embedded(claimed, vectors)

    def _embedded(self, claimed: DataFrame, vectors: DataFrame) -> DataFrame:
        there = vectors.groupBy("file_hash").agg(F.bool_or(F.col("embedding").isNotNull()).alias("_ok"), F.max("error").alias("error"))
        rows = claimed.join(there, "file_hash", "left")
        return self._outcomes(rows, F.when(F.col("_ok"), "completed").when(F.col("error").isNotNull(), "failed").otherwise("skipped"), F.when(~F.col("_ok"), F.col("error")))

    def _embed_again(self, claimed: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
        """New vectors for the rows of claimed files, frames included, under the model the jobs name."""
        vectors, frames = self._vectors(images, videos)
        tags = claimed.groupBy("file_hash").agg(F.max(F.struct("model_id", "model_version")).alias("_tag"))
        whole = vectors.where("embedding is not null").join(tags, "file_hash").select("file_path", F.col("embedding").alias("_vector"), "_tag")
        still = frames.join(tags, "file_hash").select("file_path", F.col("embedding").alias("_vector"), "_tag")
        new = whole.unionByName(still).groupBy("file_path").agg(F.max_by("_vector", "file_path").alias("_vector"), F.max("_tag").alias("_tag"))
        rows = self.read("media").join(new, "file_path")
        values = {"embedding": F.col("_vector"), "model_id": F.coalesce("_tag.model_id", "model_id"), "model_version": F.coalesce("_tag.model_version", "model_version"), "updated_at": F.lit(self.clock())}
        self.tables["media"].upsert(rows.withColumns(values))
        return self._embedded(claimed, vectors)

    def _transcode(self, claimed: DataFrame, images: DataFrame, videos: DataFrame) -> DataFrame:
        """Videos above the configured size or of another codec are transcoded; a job without metadata fails, one that needs nothing, or whose program is missing, is skipped."""
        known = self.read("metadata").select("file_hash", "width", "height", "codec", "bitrate_kbps")
        decided = transcode.decide(videos.join(known, "file_hash").select(F.col("id").cast("string").alias("file_path"), "width", "height", "codec", "bitrate_kbps"), self.transcoding)
        plan = decided.select(F.col("file_path").cast("long").alias("id"), "decision", "reason")
        rows = checkpointed(videos.join(known.select("file_hash", F.lit(True).alias("_known")), "file_hash", "left").join(plan, "id", "left").select("id", "file_path", "_known", "decision", "reason"))
        out = self._outcomes(images, "skipped").unionByName(self._outcomes(rows.where("_known is null"), "failed", F.lit("no metadata"))).unionByName(self._outcomes(rows.where("decision = 'skip'"), "skipped", F.col("reason")))
        program, due = shutil.which("ffmpeg"), rows.where("decision = 'transcode'")
        return out.unionByName(transcode_videos(due, self.transcoding, program) if program else self._outcomes(due, "skipped"))

    def _frame_records(self, frames: DataFrame) -> DataFrame:
        now, path = self.clock(), F.col("file_path")
        rows = frames.select(
            F.concat_ws("-", F.lit(uuid.uuid4().hex[:8]), F.sha2("file_path", 256)).alias("id"), "file_hash", "file_path", basename(path).alias("file_name"), F.lit(0).cast("long").alias("file_size"), extension(path).alias("file_ext"), F.lit("video_frame").alias("media_type"),
            "embedding", F.lit(self.model_id).alias("model_id"), F.lit(self.model_version).alias("model_version"), F.col("video").alias("source_video_path"), "frame_index", F.col("ts_ms").alias("frame_timestamp_ms"), F.lit(now).alias("indexed_at"), F.lit(now).alias("updated_at"), F.lit(False).alias("tombstone"),
        )
        return self._full(rows, schemas.MEDIA)

    def _records(self, vectors: DataFrame) -> DataFrame:
        now, path = self.clock(), F.col("file_path")
        files = self.read("files").select("file_path", "file_size", "file_modified")
        base = vectors.select("file_hash", "file_path", "embedding").dropDuplicates(["file_path"]).join(files, "file_path", "left").select(
            F.concat_ws("-", F.lit(uuid.uuid4().hex[:8]), F.sha2("file_path", 256)).alias("id"), "file_hash", "file_path", basename(path).alias("file_name"), F.coalesce("file_size", F.lit(0)).alias("file_size"), extension(path).alias("file_ext"),
            media_type(path, "image").alias("media_type"), "embedding", F.lit(self.model_id).alias("model_id"), F.lit(self.model_version).alias("model_version"), "file_modified", F.lit(now).alias("indexed_at"), F.lit(now).alias("updated_at"), F.lit(False).alias("tombstone"),
        )
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.MEDIA if f.name not in base.columns]
        return catalog.with_metadata(base.select("*", *empty), self.read("metadata")).select(*(f.name for f in schemas.MEDIA))

    @property
    def _index_folder(self) -> str:
        return os.path.join(os.path.abspath(self.folder), "index")

    def build_index(self) -> int:
        """Write the catalog's vectors as an inverted file, a folder for each list, and its centroids; the number of lists. Searches use it until the catalog changes."""
        version, rows = self.tables["media"].version(), self.read("media").where("size(embedding) > 0")
        if version is None:
            return 0
        centres = knn.fit_centroids(rows.select("id", "embedding"))
        target = os.path.join(self._index_folder, version)
        knn.ivf_assign(rows, centres).repartition("centroid_id").write.mode("overwrite").partitionBy("centroid_id").parquet(os.path.join(target, "lists"))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "centroid_id int, centre array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(os.path.join(target, "centroids"))
        for old in os.listdir(self._index_folder):
            if old != version:
                shutil.rmtree(os.path.join(self._index_folder, old), ignore_errors=True)
        return len(centres)

    def search(self, text: str, limit: int = 20, **given: str) -> DataFrame:
        """The best matches of a text. With an index of the catalog as it is now only the lists nearest to the query are read, and ranked exactly."""
        target = os.path.join(self._index_folder, self.tables["media"].version() or "none")
        if not os.path.exists(os.path.join(target, "centroids", "_SUCCESS")):
            return search.search_text(self.read("media"), self.encoder, text, limit, **given)
        rows = self.spark.read.parquet(os.path.join(target, "centroids")).orderBy("centroid_id").collect()
        near = knn.nearest_lists(np.array([r["centre"] for r in rows]), self.encoder.encode_text(search.parse_query(text, **given).text))
        lists = self.spark.read.schema(StructType([*schemas.MEDIA.fields, StructField("centroid_id", IntegerType())])).parquet(os.path.join(target, "lists"))
        return search.search_text(lists.where(F.col("centroid_id").isin(near)).drop("centroid_id"), self.encoder, text, limit, **given)

    def media(self, key: str):
        row = catalog.by_id(self.read("media"), key).first()
        if row is None:
            raise NotFoundError(key)
        return row

    def stats(self) -> dict[str, int]:
        rows = browse.catalog_stats(self.read("media"), self.read("files"), self.read("jobs"), self.read("models")).collect()
        return {r["metric"]: r["value"] for r in rows}

    def progress(self) -> dict[str, int]:
        return jobs.queue_progress(self.read("jobs")).first().asDict()

    def dedup(self, tier: str, threshold: float = dedup.THRESHOLD) -> dict[str, DataFrame]:
        return dedup.duplicates(tier, self.read("files"), self.read("media").where("not tombstone"), threshold)

    def browse(self, **page) -> DataFrame:
        return browse.browse(self.read("media"), **page)

    def browse_files(self, **page) -> DataFrame:
        return browse.browse_files(self.read("files"), **page)

    def reembed(self, model_id: str, model_version: str) -> int:
        """Enqueue a re-embed of every active file; the number of jobs added."""
        queue, files = self.read("jobs"), self.read("files")
        fresh = jobs.enqueue_reembed(files, queue, model_id, model_version).join(files.groupBy("file_hash").agg(F.max("file_path").alias("file_path")), "file_hash").persist()
        top = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        n = fresh.count()
        if n:
            self.tables["jobs"].overwrite(queue.unionByName(self._new_jobs(fresh, top, self.clock()), allowMissingColumns=True))
        fresh.unpersist()
        return n

    def enqueue_transcodes(self, config: transcode.TranscodeConfig) -> int:
        """Enqueue a transcode of every active video that has something to gain; the number of jobs added."""
        queue = self.read("jobs")
        due = self.transcode_plan(config).where("decision = 'transcode'").select("file_path").join(self.read("files").where("status = 'active'").select("file_hash", "file_path"), "file_path")
        paths = due.groupBy("file_hash").agg(F.max("file_path").alias("file_path")).persist()
        fresh = jobs.enqueue(paths, queue, ("transcode",)).join(paths, "file_hash").persist()
        top, n = queue.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], fresh.count()
        if n:
            self.tables["jobs"].overwrite(queue.unionByName(self._new_jobs(fresh, top, self.clock()), allowMissingColumns=True))
        for df in (paths, fresh):
            df.unpersist()
        return n

    def transcode_plan(self, config: transcode.TranscodeConfig) -> DataFrame:
        return transcode.dry_run(self.read("files"), self.read("metadata"), config)

    def set(self, key: str, value: str) -> None:
        self.tables["config"].upsert(self.spark.createDataFrame([(key, value, self.clock())], schemas.CONFIG))

    def get(self, key: str) -> str | None:
        row = self.read("config").where(F.col("key") == key).first()
        return row["value"] if row else None

    def register_model(self, model_id: str, version: str, path: str = "", dimensions: int = 1024) -> None:
        row = self.spark.createDataFrame([(model_id, version, path, dimensions, False, self.clock())], schemas.MODELS)
        self.tables["models"].overwrite(catalog.register(self.read("models"), row))

    def activate_model(self, model_id: str) -> None:
        self.tables["models"].overwrite(catalog.activate(self.read("models"), model_id))
