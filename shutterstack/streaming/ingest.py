"""Streams: a folder of arriving rows into a table, a stateful frame reduction, and progress over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from shutterstack.operators.frames import SIMILARITY, keep_changed
from shutterstack.session import ship_package
from shutterstack.sources.storage import Table


def watch(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Merge what has arrived into ``table`` by key and stop. Of the rows of a key that of the greatest ``updated_at`` counts, if there is one, be it in the batch or in the table.

    A batch that is run again after a failure gives the same table.
    """
    def merge(batch: DataFrame, _: int) -> None:
        order = "updated_at" if "updated_at" in batch.columns else table.key
        others = [c for c in batch.columns if c not in (table.key, order)]
        row = F.max(F.struct(F.col(order).alias("_at"), *others)).alias("r")
        last = batch.groupBy(table.key).agg(row).select(table.key, *(F.col("r")[c].alias(c) for c in others), *([] if order == table.key else [F.col("r._at").alias(order)]))
        last = last.select(*batch.columns)
        if order != table.key:
            # a row that comes later but is older than the stored one changes nothing
            stored = table.read().select(F.col(table.key).alias("_key"), F.col(order).alias("_stored"))
            kept = last.join(stored, last[table.key] == F.col("_key"), "left").where(F.col("_stored").isNull() | (F.col(order) >= F.col("_stored")))
            last = kept.select(*batch.columns)
        table.upsert(last)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reduce_stream(frames: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The frame fold over a stream of ``(video, frame_index, id, embedding)``: the last kept vector is the state of a video.

    Frames of a batch are put in order; one that arrives after a later frame was folded is compared with the last kept vector then.
    """
    ship_package(frames.sparkSession)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = np.asarray(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["frame_index", "id"])
        last, kept = keep_changed(last, [np.asarray(v, np.float64) for v in rows["embedding"]], threshold)
        if last is not None:
            state.update((last.tolist(),))
        yield pd.DataFrame({"video": key[0], "frame_index": rows["frame_index"].iloc[kept], "id": rows["id"].iloc[kept]})

    return frames.groupBy("video").applyInPandasWithState(fold, "video string, frame_index int, id string", "last array<double>", "append", "NoTimeout")


def progress(events: DataFrame, every: str = "1 day", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events per window and type; rows that come later than ``late`` behind the newest are left out."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    rows = timed.groupBy(F.window("_at", every).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")
