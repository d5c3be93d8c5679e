"""Scalar rules for media: probe output, EXIF values, dimensions, frame times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterstack.schemas import PROBE


def _parse(json: Column, schema: str) -> Column:
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def frame_rate(text: Column) -> Column:
    """'n/d' or a plain number as float; null for a zero denominator or other text."""
    n, d = (F.get(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(F.instr(text, "/") > 0, F.when(d != 0, n / d)).otherwise(text.try_cast("double")).cast("float")


def probe_fields(json: Column) -> Column:
    """Struct of width, height, codec, fps, duration_ms and bitrate_kbps of the first video stream; null if the text is no JSON object.

    Unknown fields are ignored, missing ones are null; the duration is cut to whole milliseconds.
    """
    probe = _parse(json, PROBE)
    video = F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.when(
        F.startswith(F.ltrim(json), F.lit("{")),
        F.struct(
            video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("codec"), frame_rate(video["r_frame_rate"]).alias("fps"),
            F.floor(probe["format"]["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"), F.floor(probe["format"]["bit_rate"].try_cast("long") / 1000).cast("int").alias("bitrate_kbps"),
        ),
    )


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees; south and west are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.coalesce(reference, F.lit("")).isin("S", "W"), -value).otherwise(value)


def exif_text(value: Column) -> Column:
    """EXIF text without surrounding blanks and quotes; empty is null."""
    return F.nullif(F.trim(F.trim(value), F.lit('"')), F.lit(""))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def fit_dimensions(w: Column, h: Column, most: int) -> Column:
    """Struct (width, height) fitted into a square of ``most``, never enlarged, no side below 1."""
    long_w, side = w >= h, F.lit(most)
    fits = (w <= side) & (h <= side)
    width = F.when(fits, w).when(long_w, side).otherwise(F.greatest(F.lit(1), _rounded(w * most / h)))
    height = F.when(fits, h).when(long_w, F.greatest(F.lit(1), _rounded(h * most / w))).otherwise(side)
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def crop_geometry(w: Column, h: Column, side: int = 224) -> Column:
    """Struct (width, height, x, y): the size at which the shortest side is ``side``, and the corner of the centre crop."""
    width = F.when(w < h, F.lit(side)).otherwise(_rounded(w * side / h))
    height = F.when(w < h, _rounded(h * side / w)).otherwise(F.lit(side))
    corner = [F.floor((x - side) / 2).cast("int") for x in (width, height)]
    return F.when((w > 0) & (h > 0), F.struct(width.alias("width"), height.alias("height"), corner[0].alias("x"), corner[1].alias("y")))


def frame_time(name: Column, index: Column, total: Column, fps: Column, duration_ms: Column) -> Column:
    """Milliseconds of a frame: its numbered name over the frame rate, that number itself without a rate, else its even share of the duration, else 0."""
    number = F.regexp_extract(name, r"(?:^|/)frame_(\d+)\.[^./]*$", 1)
    pts = F.nullif(number, F.lit("")).try_cast("long")
    even = F.when(total > 1, F.expr("1") * F.floor(duration_ms * index / (total - 1))).otherwise(F.lit(0))
    timed = F.when(fps > 0, F.floor(pts / fps.cast("double") * 1000)).otherwise(pts)
    return F.coalesce(F.when(pts.isNotNull(), timed), even, F.lit(0)).cast("long")


def padded_tokens(ids: Column, length: int = 77, end: int = 49407) -> Column:
    """Token ids cut to ``length``, the last one then being ``end``, or filled up with zeros."""
    filled = F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), length)), 1, length)
    cut = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end).cast("long")))
    return F.when(F.size(ids) > length, cut).otherwise(filled)
