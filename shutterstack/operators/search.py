"""Semantic search: the query language, ranked scans, and filters before or after ranking."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.errors import QueryError
from shutterstack.functions.vectors import cosine_similarity, l2sq, literal, usable
from shutterstack.operators.current import current_rows

#: Ranked rows fetched per result before filters apply.
OVERFETCH = 4
#: Date forms that date conditions understand.
TAKEN = r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d((\.\d{1,9})?Z)?| \d\d:\d\d:\d\d)$"
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


@dataclass(frozen=True)
class Filters:
    """Conditions on results; None is no condition. A null date passes the date conditions, any other null value fails its condition."""

    media_type: str | None = None
    after: dt.datetime | None = None
    before: dt.datetime | None = None
    min_width: int | None = None
    min_height: int | None = None
    file_ext: str | None = None
    camera_model: str | None = None
    has_gps: bool | None = None

    def predicate(self) -> Column:
        tests = [F.lit(True)]
        if self.media_type is not None:
            tests.append(kind() == self.media_type)
        when = taken_at()
        if self.after is not None:
            tests.append(when.isNull() | (when >= F.lit(self.after).cast("timestamp_ntz")))
        if self.before is not None:
            tests.append(when.isNull() | (when <= F.lit(self.before).cast("timestamp_ntz")))
        for name, least in (("width", self.min_width), ("height", self.min_height)):
            if least is not None:
                tests.append(F.coalesce(F.col(name) >= least, F.lit(False)))
        if self.file_ext is not None:
            tests.append(F.coalesce(F.lower("file_ext") == self.file_ext.lower(), F.lit(False)))
        if self.camera_model is not None:
            tests.append(F.coalesce(F.col("exif_camera_model") == self.camera_model, F.lit(False)))
        if self.has_gps is not None:
            tests.append((F.col("exif_gps_lat").isNotNull() & F.col("exif_gps_lon").isNotNull()) == self.has_gps)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


@dataclass(frozen=True)
class Query:
    """A parsed search: free text and conditions."""

    text: str = ""
    filters: Filters = field(default_factory=Filters)


def _date(text: str) -> dt.date | None:
    if not _DATE.fullmatch(text):
        return None
    try:
        return dt.date(*map(int, text.split("-")))
    except ValueError:
        return None


def parse_query(text: str, media_type: str | None = None, after: str | None = None) -> Query:
    """Split a search into ``type:``, ``after:`` and ``before:`` conditions and free text.

    A condition whose value makes no sense stays text, the last of its kind wins, and the text is joined by
    single spaces. ``media_type`` and ``after`` are conditions given beside the text; the text's own win.
    """
    filters, words = Filters(), []
    given = [f"{name}:{value}" for name, value in (("type", media_type), ("after", after)) if value is not None]
    for token in [*given, *text.split()]:
        name, colon, value = token.partition(":")
        day = _date(value) if colon else None
        if colon and name == "type" and value.lower() in ("image", "video"):
            filters = replace(filters, media_type=value.lower())
        elif name == "after" and day:
            filters = replace(filters, after=dt.datetime.combine(day, dt.time()))
        elif name == "before" and day:
            filters = replace(filters, before=dt.datetime.combine(day, dt.time(23, 59, 59)))
        else:
            words.append(token)
    return Query(" ".join(words), filters)


def parse_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """``parse_query`` for a column of searches, as columns text, media_type, after_ts and before_ts."""
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    df = queries.withColumn("_tokens", tokens)

    def day(token: Column, start: int) -> Column:
        value = F.substring(token, start, 20)
        return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(value, "yyyy-M-d"))

    def is_type(t: Column) -> Column:
        return F.startswith(t, F.lit("type:")) & F.lower(F.substring(t, 6, 20)).isin("image", "video")

    def is_day(t: Column, name: str) -> Column:
        return F.startswith(t, F.lit(name)) & day(t, len(name) + 1).isNotNull()

    def last(test) -> Column:
        return F.try_element_at(F.filter("_tokens", test), F.lit(-1))

    words = F.filter("_tokens", lambda t: ~(is_type(t) | is_day(t, "after:") | is_day(t, "before:")))
    return df.select(
        *(c for c in queries.columns if c != text),
        F.array_join(words, " ").alias("text"),
        F.lower(F.substring(last(is_type), 6, 20)).alias("media_type"),
        day(last(lambda t: is_day(t, "after:")), 7).cast("timestamp_ntz").alias("after_ts"),
        (day(last(lambda t: is_day(t, "before:")), 8).cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")).alias("before_ts"),
    )


def kind() -> Column:
    """Media type as filters see it: lower case, anything unknown is an image."""
    low = F.lower("media_type")
    return F.when(low.isin("video", "video_frame"), low).otherwise("image")


def taken_at() -> Column:
    """EXIF date if there is one, else the file's; null if that text is in none of the three accepted forms."""
    raw = F.coalesce("exif_date_taken", "file_modified")
    text = F.when(raw.rlike(TAKEN), F.translate(raw, "TZ", " "))
    return F.substring(text, 1, 26).try_cast("timestamp_ntz")


def measured(media: DataFrame, vector: Sequence[float], *columns: str) -> DataFrame:
    """Current rows of the append-only catalog with ``distance`` to a vector, which is measured where a row is read, so that no vector is shuffled.

    Rows without a vector of that length of finite numbers are left out. Rank the result with the vector None.
    """
    distance = F.when(usable(F.col("embedding"), len(vector)), l2sq(F.col("embedding"), literal(vector)))
    return current_rows(media.select("id", "updated_at", *columns, distance.alias("distance")), *columns, "distance").where("distance is not null")


def ranked(media: DataFrame, vector: Sequence[float] | None, limit: int) -> DataFrame:
    """The ``limit`` nearest rows by squared distance, ties by id, with ``distance`` (the rows' own if the vector is None) and ``score`` = 1 / (1 + distance)."""
    distance = F.col("distance") if vector is None else l2sq(F.col("embedding"), literal(vector))
    near = media.withColumn("distance", distance).orderBy("distance", "id").limit(limit)
    return near.withColumn("score", 1 / (1 + F.col("distance")))


def search(media: DataFrame, vector: Sequence[float] | None, filters: Filters | None = None, limit: int = 20, prefilter: bool = False) -> DataFrame:
    """Ranked results, best first.

    By default ``OVERFETCH`` times ``limit`` rows are ranked and then filtered, so a selective filter can give fewer
    than ``limit`` results although more exist; ``prefilter`` filters first and misses none. Tombstones don't matter here.
    """
    test = (filters or Filters()).predicate()
    if prefilter:
        return ranked(media.where(test), vector, limit)
    return ranked(media, vector, limit * OVERFETCH).where(test).orderBy(F.desc("score"), "id").limit(limit)


def search_text(media: DataFrame, encoder, text: str, limit: int = 20, **given: str) -> DataFrame:
    """Parse, encode and search. Without any text the result is empty, but a search of a ``type:`` only is an error."""
    query = parse_query(text, **given)
    if not query.text:
        if query.filters.media_type is not None:
            raise QueryError("a search needs some text besides its filters")
        return search(media, [0.0], limit=0)
    return search(media, encoder.encode_text(query.text), query.filters, limit)


def result_columns(results: DataFrame) -> DataFrame:
    """Results as the interface shows them, with a frame struct for rows that have a source video."""
    frame = F.struct(F.col("source_video_path"), F.coalesce("frame_index", F.lit(0)).alias("frame_index"), F.coalesce("frame_timestamp_ms", F.lit(0)).alias("frame_timestamp_ms"))
    return results.select("id", "file_path", "file_name", "media_type", "score", "width", "height", F.when(F.col("source_video_path").isNotNull(), frame).alias("frame"))


def display_table(results: DataFrame) -> DataFrame:
    """Rank from 1, score with three decimals, type label and dimensions; results are few, so one task ranks them."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    dims = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat(F.col("width"), F.lit("x"), F.col("height"))).otherwise("-")
    label = F.when(F.col("media_type") == "video_frame", "frame").otherwise(F.col("media_type"))
    return results.select(rank.alias("rank"), "id", F.format_string("%.3f", F.col("score")).alias("score_text"), label.alias("type_label"), dims.alias("dims"))


def cosine_search(media: DataFrame, vector: Sequence[float], limit: int = 5) -> DataFrame:
    """Ranked by cosine similarity; vectors of no length come last."""
    score = cosine_similarity(F.col("embedding"), literal(vector))
    return media.select("id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(limit)
