"""Change detection between the stored files and a scan, and applying it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(files: DataFrame, scanned: DataFrame, root: str | None = None) -> DataFrame:
    """Rows ``(kind, file_hash, file_path, old_path)``: what a scan found new, modified, moved, unchanged or deleted.

    A scanned file is unchanged if its hash is active at its path, moved if its hash is active elsewhere (``old_path``
    is the smallest such path), modified if its path is active with another hash, else new. An active file whose
    hash the scan has nowhere is deleted; so a modified file gives two rows. With ``root`` only files below it can be
    deleted. Rows without hash or path take no part; repeated rows count once.
    """
    active = files.where("status = 'active' and file_hash is not null and file_path is not null").select("file_hash", "file_path").distinct()
    seen = scanned.where("file_hash is not null and file_path is not null").select("file_hash", "file_path").distinct()
    by_hash = active.groupBy("file_hash").agg(F.min("file_path").alias("_old"))
    by_path = active.groupBy("file_path").agg(F.lit(True).alias("_known"))
    same = active.withColumn("_same", F.lit(True))
    found = seen.join(same, ["file_hash", "file_path"], "left").join(by_hash, "file_hash", "left").join(by_path, "file_path", "left")
    kind = F.when(F.col("_same"), "unchanged").when(F.col("_old").isNotNull(), "moved").when(F.col("_known"), "modified").otherwise("new")
    present = found.select(kind.alias("kind"), "file_hash", "file_path", F.when(kind == "moved", F.col("_old")).alias("old_path"))
    gone = active.join(seen.select("file_hash").distinct(), "file_hash", "left_anti")
    if root is not None:
        gone = gone.where(F.startswith("file_path", F.lit(root.rstrip("/") + "/")))
    return present.unionByName(gone.select(F.lit("deleted").alias("kind"), "file_hash", "file_path", F.lit(None).cast("string").alias("old_path")))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n"))


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files after a scan: one row ``(file_hash, file_path, status)`` per hash and path.

    Deleted files stay as 'deleted'; a moved file is active at its new path only; new and modified ones are added as active.
    """
    old = files.where("file_hash is not null and file_path is not null").select("file_hash", "file_path", "status")
    known = old.groupBy("file_hash", "file_path").agg(F.min("status").alias("status"))
    fresh = changes.where("kind in ('new', 'modified', 'moved')").select("file_hash", "file_path").withColumn("_fresh", F.lit(True))
    dropped = changes.where("kind = 'deleted'").select("file_hash", "file_path").withColumn("_dropped", F.lit(True))
    left = changes.where("kind = 'moved'").select("file_hash", F.col("old_path").alias("file_path")).distinct().withColumn("_left", F.lit(True))
    keys = ["file_hash", "file_path"]
    # a path that the scan found unchanged was not left, whatever else has its hash
    stays = changes.where("kind = 'unchanged'").select(*keys).withColumn("_stays", F.lit(True))
    rows = known.join(fresh.distinct(), keys, "full_outer").join(dropped, keys, "left").join(left, keys, "left").join(stays, keys, "left")
    status = F.when(F.col("_fresh"), "active").when(F.col("_dropped"), "deleted").otherwise(F.col("status"))
    return rows.where("not (_left is not null and _stays is null and _fresh is null)").select(*keys, status.alias("status"))


def upsert_files(files: DataFrame, scanned: DataFrame, now: str) -> DataFrame:
    """The files after every scanned row was put in by hash: path, size and time are replaced, ``first_seen`` is kept, all are active.

    A hash that is scanned at several paths keeps the greatest; of several stored rows of a hash the greatest path counts.
    """
    def one(df: DataFrame, *columns: str) -> DataFrame:
        best = F.max(F.struct("file_path", *(c for c in columns if c != "file_path")))
        return df.where("file_hash is not null").groupBy("file_hash").agg(best.alias("r")).select("file_hash", *(F.col("r")[c].alias(c) for c in columns))

    stored = one(files, "file_path", "file_size", "file_modified", "first_seen", "last_seen", "status")
    fresh = one(scanned, "file_path", "file_size", "file_modified")
    s, f = stored.alias("s"), fresh.alias("f")
    put = F.col("f.file_path").isNotNull()
    rows = s.join(f, "file_hash", "full_outer")
    return rows.select(
        "file_hash",
        *(F.when(put, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("file_path", "file_size", "file_modified")),
        F.coalesce("s.first_seen", F.lit(now)).alias("first_seen"),
        F.when(put, F.lit(now)).otherwise(F.col("s.last_seen")).alias("last_seen"),
        F.when(put, "active").otherwise(F.col("s.status")).alias("status"),
    )
