"""Current and live rows of the append-only media catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(media: DataFrame, *columns: str) -> DataFrame:
    """One row per id with ``columns``: the one with the greatest ``updated_at``.

    Only the named columns are read. The newest row is found by a mergeable maximum, so repeated rows
    of a hot id collapse before the shuffle. Rows that tie on ``updated_at`` are told apart by the
    values of ``columns`` in their order, nulls first. Rows without an id are left out; a null
    ``updated_at`` is older than any other. An empty table gives an empty result.
    """
    newest = F.max(F.struct(F.col("updated_at").alias("_at"), *(F.col(c) for c in columns)))
    rows = media.where(F.col("id").isNotNull()).groupBy("id").agg(newest.alias("_row"))
    return rows.select("id", *(F.col("_row")[c].alias(c) for c in columns))


def live_rows(media: DataFrame, *columns: str) -> DataFrame:
    """The current rows that are not tombstoned; a null tombstone counts as false."""
    rows = current_rows(media, *columns, "tombstone")
    return rows.where(~F.coalesce("tombstone", F.lit(False))).drop("tombstone")
