"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.functions.text import folded
from shutterstack.session import broadcast_if_small, checkpointed


def canonical_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 over values in canonical form; a null is told apart from every text."""
    marked = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c), F.lit(":"), c)) for c in columns]
    return F.sha2(F.concat(*marked), 256)


def snapshot_changes(
    table: DataFrame,
    snapshot: str = "snapshot_no",
    key: str = "file_path",
    version: str = "last_seen",
    compared: Sequence[str] = ("file_hash", "status"),
) -> DataFrame:
    """Rows ``(snapshot, key, change)``: what was added, removed or changed from one delivered snapshot to the next.

    Consecutive means consecutive among the snapshots present; gaps in the numbers don't matter, and the
    first snapshot is compared with nothing. Within a snapshot the row with the greatest ``version`` stands
    for its key; rows that tie on it are told apart by the greatest hash of their compared values, so the result never
    depends on row order. Keys compare exactly (a blank key is a key), compared values trimmed and without
    regard to case, and a null equals only null. Rows with a null key or snapshot are left out. Other
    columns are never read. An empty table, or one with a single snapshot, gives an empty result.

    Plan: the table is read once; repeated rows collapse in a partial aggregate, which is written down, then one full outer join on (snapshot, key)
    compares row hashes; a missing side is an addition or a removal. Both join keys shuffle, so no
    single path or snapshot ends in one task.
    """
    canonical = [folded(F.col(c).cast("string")) for c in compared]
    rows = checkpointed(
        table.where(F.col(snapshot).isNotNull())
        .select(F.col(snapshot).alias("_no"), F.col(key).alias("_key"), F.struct(F.col(version).alias("v"), canonical_hash(canonical).alias("h")).alias("_row"))
        .groupBy("_no", "_key")
        .agg(F.max("_row")["h"].alias("_hash"))
    )
    # a snapshot was delivered even if all its rows lack a key
    numbers = rows.select("_no").distinct()
    rows = rows.where("_key is not null")
    following = numbers.withColumn("_next", F.lead("_no").over(Window.orderBy("_no")))
    follows = broadcast_if_small(following.where("_next is not null"))
    before = rows.join(follows, "_no").select(F.col("_next").alias("_no"), "_key", F.col("_hash").alias("_before"))
    after = rows.join(follows.select(F.col("_next").alias("_no")), "_no").select("_no", "_key", F.col("_hash").alias("_after"))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(F.col("_before") != F.col("_after"), "changed")
    return (
        before.join(after, ["_no", "_key"], "full_outer")
        .select(F.col("_no").alias(snapshot), F.col("_key").alias(key), change.alias("change"))
        .where("change is not null")
    )
