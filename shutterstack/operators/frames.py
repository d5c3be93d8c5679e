"""Frames of videos: sampling, indexing, reduction and pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.functions.media import frame_time
from shutterstack.functions.vectors import LEAST_NORM
from shutterstack.session import broadcast_if_small, checkpointed, ship_package

SIMILARITY = 0.95
#: Frames of a chunk at most, about, and at least where more chunks would only be for more tasks.
CHUNK, LEAST_CHUNK = 50_000, 10_000


def interval_frames(videos: DataFrame, seconds: int = 30) -> DataFrame:
    """Sampled frames ``(video, k, frame, timestamp_sec, name)`` of ``videos(video, fps, frames)``: every ``seconds``; none without a rate or length."""
    step = F.floor(F.col("fps") * seconds).cast("long")
    at = F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1, F.greatest(step, F.lit(1).cast("long")))
    rows = videos.where("fps > 0 and frames > 0").select("video", "fps", F.posexplode(at).alias("k", "frame"))
    time = F.round(F.col("frame") / F.col("fps"), 2)
    stem = F.regexp_replace(F.substring_index("video", "/", -1), r"(?<=.)\.[^.]*$", "")
    return rows.select("video", "k", "frame", time.alias("timestamp_sec"), F.concat(stem, F.lit("_f"), F.lpad(F.col("k").cast("string"), 4, "0"), F.lit("_"), F.floor(time).cast("string"), F.lit("s.jpg")).alias("name"))


def parse_frame_name(files: DataFrame, path: str = "file_path") -> DataFrame:
    """``source`` and ``timestamp_sec`` of names like 'clip_f0003_90s.jpg'; '' and -1.0 for others."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    pattern = r"^(.*)_f(\d+)_(-?\d+(?:\.\d+)?)s$"
    return files.withColumns({"name": name, "source": F.regexp_extract(name, pattern, 1), "timestamp_sec": F.coalesce(F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")).try_cast("double"), F.lit(-1.0))})


def _in_chunks(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` sorted by ``keys`` across partitions of about ``most`` rows, with the number of each as ``chunk``; a long run of one key spans several."""
    n = rows.count()
    chunks = max(1, -(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_CHUNK))
    return checkpointed(rows.repartitionByRange(chunks, *keys).sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id()))


def frame_index(frames: DataFrame, most: int = CHUNK) -> DataFrame:
    """Rows ``(video, file_path, idx)``: the position of each .jpg among its video's frames by path, from 0.

    Positions are counted in chunks of about ``most`` frames, and what comes before a chunk is added, so no task gets a whole long video.
    """
    rows = frames.where(F.endswith("file_path", F.lit(".jpg"))).select(F.col("source_video_path").alias("video"), "file_path").distinct()
    chunked = _in_chunks(rows, ["video", "file_path"], most)
    order = Window.partitionBy("video").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # only the first video of a chunk has frames in the one before
    before = chunked.groupBy("video", "chunk").count().withColumn("before", F.sum("count").over(order)).where("before > 0")
    own = F.row_number().over(Window.partitionBy("video", "chunk").orderBy("file_path")) - 1
    counted = chunked.withColumn("own", own).join(broadcast_if_small(before.drop("count").withColumnsRenamed({"video": "_video", "chunk": "_chunk"})), F.col("video").eqNullSafe(F.col("_video")) & (F.col("chunk") == F.col("_chunk")), "left")
    return counted.select("video", "file_path", (F.col("own") + F.coalesce("before", F.lit(0))).cast("int").alias("idx"))


def frame_timestamps(frames: DataFrame) -> DataFrame:
    """``ts_ms`` of ``frames(video, file_path, idx, total, fps, duration_ms)``."""
    return frames.select("video", "file_path", "idx", frame_time(F.col("file_path"), F.col("idx"), F.col("total"), F.col("fps"), F.col("duration_ms")).alias("ts_ms"))


def keep_changed(last: np.ndarray | None, vectors: list[np.ndarray], threshold: float) -> tuple[np.ndarray | None, list[int]]:
    """The fold over one video's frames: the last kept vector and the numbers of those kept. A frame stays unless it is too similar to the last kept one."""
    kept = []
    for i, v in enumerate(vectors):
        n = min(len(v), len(last)) if last is not None else 0
        if last is None or not float(np.dot(last[:n], v[:n])) > threshold:
            last = v
            kept.append(i)
    return last, kept


def _runs(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (part for _, part in batch.groupby((batch["video"] != batch["video"].shift()).cumsum(), sort=False))


def _vectors(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in part["embedding"]]


def _summaries(batches: Iterator[pd.DataFrame], starts: dict[int, np.ndarray], threshold: float) -> Iterator[pd.DataFrame]:
    """Of each chunk its number, its first and last video, and the place and vector of the frame last kept."""
    chunk = first = video = last = place = None
    seen = 0
    for batch in batches:
        for part in _runs(batch):
            if chunk is None:
                chunk = int(part["chunk"].iat[0])
                first = video = part["video"].iat[0]
                last, place = starts.get(chunk), -1
            elif part["video"].iat[0] != video:
                video, last, place = part["video"].iat[0], None, -1
            last, kept = keep_changed(last, _vectors(part), threshold)
            place = seen + kept[-1] if kept else place
            seen += len(part)
    if chunk is not None:
        yield pd.DataFrame({"chunk": [chunk], "first": [first], "last": [video], "place": [place], "vector": [last.tolist()]})


def _kept(batches: Iterator[pd.DataFrame], starts: dict[int, np.ndarray], threshold: float) -> Iterator[pd.DataFrame]:
    """The frames of each chunk that stay, after the vector its first video comes with."""
    begun, video, last = False, None, None
    for batch in batches:
        keep = []
        for part in _runs(batch):
            if not begun:
                begun, video, last = True, part["video"].iat[0], starts.get(int(part["chunk"].iat[0]))
            elif part["video"].iat[0] != video:
                video, last = part["video"].iat[0], None
            last, kept = keep_changed(last, _vectors(part), threshold)
            keep += part.index[kept].tolist()
        yield batch.loc[keep].drop(columns="chunk")


def reduce_frames(frames: DataFrame, threshold: float = SIMILARITY, most: int = CHUNK) -> DataFrame:
    """Rows ``(video, frame_index, id, embedding)``: the frames that differ from the last one kept, in frame order, ties by id.

    Similarity is the scalar product of the vectors. The fold is sequential in a video, but a long one is folded in chunks of about ``most`` frames
    at once: each begins as if nothing were kept, then again with what the one before ended with. As soon as two folds keep the same frame they go on
    alike, so the ends of chunks soon stop changing; only chunks whose beginning changed are folded again, as often as there are chunks in the longest
    video at most. The driver holds one vector for each chunk.
    """
    ship_package(frames.sparkSession)
    rows = frames.where("video is not null").select("video", "frame_index", "id", "embedding")
    chunked = _in_chunks(rows, ["video", "frame_index", "id"], most)
    sc = frames.sparkSession.sparkContext
    schema = "chunk int, first string, last string, place long, vector array<double>"
    ends: dict[int, tuple] = {}
    starts: dict[int, np.ndarray] = {}
    origin: dict[int, tuple] = {}
    todo = None
    while todo is None or todo:
        held = sc.broadcast(starts)
        part = chunked if todo is None else chunked.where(F.col("chunk").isin(sorted(todo)))
        for r in part.mapInPandas(lambda batches: _summaries(batches, held.value, threshold), schema).toLocalIterator():
            # nothing kept in a chunk: it ends with what it began with
            mark = origin.get(r["chunk"]) if r["place"] < 0 else (r["chunk"], r["place"])
            ends[r["chunk"]] = (r["first"], r["last"], mark, np.array(r["vector"]))
        todo, order = set(), sorted(ends)
        for before, chunk in zip(order, order[1:]):
            _, video, mark, vector = ends[before]
            if video == ends[chunk][0] and origin.get(chunk) != mark:
                starts[chunk], origin[chunk] = vector, mark
                todo.add(chunk)
    held = sc.broadcast(starts)
    return chunked.mapInPandas(lambda batches: _kept(batches, held.value, threshold), rows.schema)


def video_embeddings(frames: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Rows ``(video, n_kept, embedding)``: the mean of the reduced frames, at unit length (unless it has almost none)."""
    return video_embeddings_of(reduce_frames(frames, threshold))


def video_embeddings_of(kept: DataFrame) -> DataFrame:
    """``video_embeddings`` of frames that are reduced already."""
    parts = kept.select("video", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    means = parts.groupBy("video", "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    # one row per dimension
    pooled = means.groupBy("video").agg(F.max("n").alias("n_kept"), F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return pooled.select("video", "n_kept", F.when(F.col("norm") < LEAST_NORM, F.col("mean")).otherwise(F.transform("mean", lambda x: x / F.col("norm"))).alias("embedding"))


def extraction_arguments(video: str, pattern: str, strategy: str = "adaptive", seconds: int = 60, scene: float = 0.3, side: int = 512) -> list[str]:
    """Arguments for the frame extractor. Any strategy but 'interval' is adaptive."""
    rate = f"fps={1 / seconds:.6f}"
    select = rate if strategy == "interval" else f"select='gt(scene,{scene})+isnan(prev_selected_t)+gte(t-prev_selected_t,{seconds})',{rate}:round=up"
    scale = f"scale='if(gt(iw,ih),{side},-2)':'if(gt(iw,ih),-2,{side})'"
    return ["-i", video, "-vf", f"{select},{scale}", "-vsync", "vfr", "-frame_pts", "1", "-q:v", "2", pattern]
