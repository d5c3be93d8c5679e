"""The best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterstack.functions.text import clean, folded
from shutterstack.operators.instants import with_parts
from shutterstack.session import broadcast_if_small


def _first(wanted: Column, value: Column, *ranking: Column) -> Column:
    """``(id, value)`` of the row that ranks highest among those ``wanted``.

    The ranking is one struct whose maximum is the best row: nulls are smallest, and the record_id is
    negated to make the smallest win. The maximum of structs merges, so a group of any size is reduced
    before the shuffle and never collected.
    """
    return F.max(F.when(wanted, F.struct(*(c.alias(f"r{i}") for i, c in enumerate([*ranking, -F.col("record_id")])), F.col("record_id").alias("id"), value.alias("value"))))


def _chosen(records: DataFrame, origins: DataFrame, values: bool) -> DataFrame:
    """Rows ``(file_hash, path, size, modified)`` of the hashes with two records or more: for each field the best record's id and, if ``values``, its value, null if there is none."""
    trust = origins.where("origin is not null").groupBy(folded("origin").alias("_origin")).agg(F.min("trust").alias("_trust"))
    rows = records.where("record_id is not null").select(
        "record_id", folded("file_hash").alias("file_hash"), "path", clean("path").alias("_path"), "size", folded("origin").alias("_origin"), "scanned_at", "modified"
    )
    timed = with_parts(rows.where("file_hash <> ''"), "modified")
    instant = F.coalesce(F.col("epoch_us"), F.col("wall_us") - F.col("offset_min") * 60_000_000)
    ranked = timed.join(broadcast_if_small(trust), "_origin", "left").select(
        "record_id", "file_hash", "path", "_path", "size", "modified", (-F.col("_trust")).alias("trusted"), F.when(instant <= F.unix_micros(F.col("scanned_at").cast("timestamp")), instant).alias("at")
    )
    path, size, modified = F.coalesce(F.col("_path") != "", F.lit(False)), F.coalesce(F.col("size") > 0, F.lit(False)), F.col("at").isNotNull()
    carried = F.col if values else lambda _: F.lit(None)
    return (
        ranked.groupBy("file_hash")
        .agg(
            (F.min("record_id") < F.max("record_id")).alias("_several"),
            _first(path, carried("path"), F.col("trusted"), F.col("at")).alias("path"),
            _first(size, carried("size"), F.col("at"), F.col("trusted")).alias("size"),
            _first(modified, carried("modified"), F.col("at"), F.col("trusted")).alias("modified"),
        )
        .where("_several")
        .drop("_several")
    )


def survivors(records: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows ``(file_hash, path_from, size_from, modified_from)``: which record gives each field of the survivor of a hash.

    A hash (trimmed, lower case, not empty) needs at least two distinct record_ids. path_from: of the
    records with a non-blank path the one of best trust, then latest counting modified, then smallest
    record_id. size_from: of those with size > 0 the latest counting modified, then best trust, then smallest
    record_id. modified_from: of those with a counting modified the latest, then best trust, then smallest
    record_id. No such record: 0.

    A modified value counts if it is a time with a zone not after scanned_at; a value without a zone, or one
    in a row without scanned_at, doesn't. Origins compare trimmed, in lower case; an origin that is null or
    not listed ranks last, and of an origin listed twice the better trust counts. Rows without record_id or
    hash are left out. Repeated rows change nothing, and an empty table gives an empty result. Other columns,
    whatever their names, are never read.
    """
    return _chosen(records, origins, False).select("file_hash", *(F.coalesce(F.col(f)["id"], F.lit(0).cast("long")).alias(f"{f}_from") for f in ("path", "size", "modified")))


def surviving_records(records: DataFrame, origins: DataFrame) -> DataFrame:
    """The built records: ``(file_hash, path, size, modified)`` with each field copied from the record ``survivors`` names.

    A field that no record can give is null. Of repeated rows of one record_id the greatest value is copied.
    """
    return _chosen(records, origins, True).select("file_hash", *(F.col(f)["value"].alias(f) for f in ("path", "size", "modified")))
