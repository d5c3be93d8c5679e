"""Mixed written timestamps to UTC instants.

Every accepted format is one branch of a single regular expression with named groups. One
``regexp_replace`` per value extracts all components at once; the rest is integer arithmetic on
columns, so the operator stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterstack.functions.text import SPACE, clean, folded
from shutterstack.operators.current import current_rows
from shutterstack.session import broadcast_if_small

# Month names, and the offsets in minutes that zone letters name.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONE_LETTERS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480,
    "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "jst": 540, "kst": 540, "sgt": 480, "hkt": 480, "awst": 480,
    "ist": 330, "npt": 345, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

_CLOCK = r"(?<h{n}>\d{{1,2}}):(?<m{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?(?:[ \u00a0\u202f]?(?<p{n}>[aApP])\.?[mM]\.?)?"
_ZONE = r"(?:[ \u00a0\u202f]?(?<z{n}>[+-]\d{{2}}(?::?\d{{2}})?|[A-Za-z]{{1,4}}))?(?:\[[A-Za-z0-9_+/-]+\])?"
_MONTH = "|".join(MONTHS)
_NAME = rf"(?<b{{n}}>(?i:{_MONTH}))[a-z]*\.?"
#: Date forms, each followed by a time of day: year first, day first with dots, month first with slashes, day and month name, month name and day.
_DATES = (
    r"(?<y{n}>\d{{4}})(?<q{n}>[-:/.])(?<o{n}>\d{{1,2}})\k<q{n}>(?<d{n}>\d{{1,2}})(?:[Tt]|[ \u00a0\u202f]+)",
    r"(?<d{n}>\d{{1,2}})\.(?<o{n}>\d{{1,2}})\.(?<y{n}>\d{{4}}),?[ \u00a0\u202f]+",
    r"(?<o{n}>\d{{1,2}})/(?<d{n}>\d{{1,2}})/(?<y{n}>\d{{4}}),?[ \u00a0\u202f]+",
    r"(?:[A-Za-z]{{3,9}},?[ ]+)?(?<d{n}>\d{{1,2}})[ -]" + _NAME + r"[ -](?<y{n}>\d{{4}}),?[ \u00a0\u202f]+",
    _NAME + r"[ ](?<d{n}>\d{{1,2}}),[ ](?<y{n}>\d{{4}}),?[ \u00a0\u202f]+",
)
_COMPACT = r"(?<y{n}>\d{{4}})(?<o{n}>\d{{2}})(?<d{n}>\d{{2}})[Tt_ ](?<h{n}>\d{{2}})(?<m{n}>\d{{2}})(?:(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?" + _ZONE
_EPOCH = r"(?<e0>\d{9,10}|\d{12,13}|\d{15,16})"
_PARTS = "yobdhmsfpz"
_MARK = "\x01"


def _compile() -> tuple[str, str]:
    branches, groups = [_EPOCH], {p: [] for p in _PARTS}
    for n, date in enumerate([*_DATES, _COMPACT], 1):
        body = date if date is _COMPACT else date + _CLOCK + _ZONE
        branches.append(body.format(n=n))
        for p in _PARTS:
            if f"(?<{p}{n}>" in branches[-1]:
                groups[p].append(f"${{{p}{n}}}")
    pattern = "^(?:" + "|".join(branches) + ")$"
    return pattern, _MARK + "|".join("".join(groups[p]) for p in _PARTS) + "|${e0}"


PATTERN, REPLACEMENT = _compile()


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic on a year that begins in March."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    shifted = F.pmod(m + 9, F.lit(12))
    era = F.floor(year / 400)
    of_era = year - era * 400
    of_year = F.floor((shifted * 153 + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def components(value: Column) -> Column:
    """All components of a written timestamp, as an array of texts in the order of ``_PARTS``, then the epoch digits.

    White space and quotes around the value are ignored. Text in no known format gives an array of one element.
    """
    return F.split(F.regexp_replace(F.trim(value, F.lit(SPACE + "\"'")), PATTERN, REPLACEMENT), r"\|")


def with_parts(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``wall_us`` (written date and time as if it were UTC), ``offset_min`` (null without a zone) and ``epoch_us`` of the written timestamp in column ``value``.

    Wall and epoch are both null if the value is unusable. A value counts if its date exists and its hour, minute and second are in
    range (no leap second); seconds may be missing, and fraction digits beyond microseconds are cut off. Zone
    letters that name no known offset make it unusable. Each step is a projection of its own, so that no
    expression is evaluated twice.
    """
    fields = F.col("_fields")

    def part(name: str) -> Column:
        return F.get(fields, F.lit(_PARTS.index(name)))

    def number(name: str) -> Column:
        return part(name).try_cast("int")

    known = (F.size(fields) == len(_PARTS) + 1) & F.startswith(F.get(fields, F.lit(0)), F.lit(_MARK))
    read = df.withColumn("_fields", components(F.col(value))).withColumn("_fields", F.when(known, fields)).withColumns(
        {
            "_y": F.substring(part("y"), 2, 4).try_cast("int"),
            "_mo": F.coalesce(number("o"), F.expr(f"(locate(lower(get(_fields, {_PARTS.index('b')})), '{''.join(MONTHS)}') + 2) div 3").cast("int")),
            "_d": number("d"), "_h": number("h"), "_mi": number("m"), "_s": F.coalesce(number("s"), F.lit(0)),
            "_us": F.rpad(F.substring(F.coalesce(part("f"), F.lit("")), 1, 6), 6, "0").try_cast("long"),
            "_half": F.lower(part("p")), "_zone": F.lower(part("z")), "_epoch": F.get(fields, F.lit(len(_PARTS))),
        }
    )
    hour = F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.pmod("_h", F.lit(12)) + F.when(F.col("_half") == "p", 12).otherwise(0))
    leap = (F.pmod("_y", F.lit(4)) == 0) & ((F.pmod("_y", F.lit(100)) != 0) | (F.pmod("_y", F.lit(400)) == 0))
    last = F.when(F.col("_mo") == 2, F.when(leap, 29).otherwise(28)).when(F.col("_mo").isin(4, 6, 9, 11), 30).otherwise(31)
    digits = F.regexp_replace("_zone", r"[+:-]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    letters = F.create_map(*(F.lit(x) for item in ZONE_LETTERS.items() for x in item))
    read = read.withColumns({"_h": hour, "_last": last, "_minutes": F.when(F.col("_zone").rlike("^[+-]"), minutes), "_letters": F.try_element_at(letters, F.col("_zone"))})
    offset = F.when(F.col("_minutes") <= 18 * 60, F.when(F.startswith("_zone", F.lit("-")), -F.col("_minutes")).otherwise(F.col("_minutes")))
    read = read.withColumns({"offset_min": F.coalesce(offset, F.col("_letters")).cast("long"), "_days": _days(F.col("_y"), F.col("_mo"), F.col("_d"))})
    valid = F.expr("_y >= 1 and _mo between 1 and 12 and _d between 1 and _last and _h between 0 and 23 and _mi between 0 and 59 and _s between 0 and 59 and (_zone = '' or offset_min is not null)")
    wall = F.expr("(((_days * 24 + _h) * 60 + _mi) * 60 + _s) * 1000000 + _us")
    scale = F.when(F.length("_epoch") <= 10, 1_000_000).when(F.length("_epoch") <= 13, 1_000).otherwise(1)
    read = read.withColumns({"wall_us": F.when(valid, wall), "epoch_us": F.col("_epoch").try_cast("long") * scale})
    return read.select(*(F.col(c) for c in df.columns), "wall_us", "offset_min", "epoch_us")


def instant_us(zone: Column) -> Column:
    """Of ``with_parts``, microseconds since 1970-01-01 UTC. ``zone`` (IANA name) is used where the value names none; null without either.

    A wall time that occurs twice means the earlier instant; a skipped one moves forward by the length of the gap.
    """
    placed = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("wall_us"), zone))
    return F.coalesce(F.col("epoch_us"), F.col("wall_us") - F.col("offset_min") * 60_000_000, placed)


def media_instants(media: DataFrame, zone_hints: DataFrame) -> DataFrame:
    """Rows ``(id, field, instant_us)`` for the usable exif_date_taken and file_modified values of the current rows, tombstoned or not.

    Without a zone in the value, exif_date_taken is taken in the zone of the row's camera model if that is
    listed (names compare trimmed, without regard to case), else, like file_modified always, in the zone of
    the library root, the first segment of file_path. Values with neither give no row, as do nulls, blanks
    and impossible dates. If a hint name is listed more than once the smallest zone name counts.
    The session time zone has to be UTC, which is how the result is defined; nothing else depends on it.
    """
    rows = current_rows(media, "exif_date_taken", "file_modified", "exif_camera_model", "file_path")
    known = list(media.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    hints = zone_hints.where(F.col("hint_name").isNotNull() & F.col("zone_name").isin(known))
    cameras = hints.where("scope = 'camera_model'").groupBy(folded("hint_name").alias("_camera")).agg(F.min("zone_name").alias("_camera_zone"))
    roots = hints.where("scope = 'library_root'").groupBy(clean("hint_name").alias("_root")).agg(F.min("zone_name").alias("_root_zone"))
    values = rows.select(
        "id",
        folded("exif_camera_model").alias("_camera"),
        F.regexp_extract("file_path", "^/*([^/]+)", 1).alias("_root"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("exif_date_taken", "file_modified")))).alias("_v"),
    ).select("id", "_camera", "_root", "_v.field", "_v.value")
    # unusable values are left out at the end: a filter here would be pushed down and evaluate every expression twice
    read = with_parts(values.where("value is not null"), "value")
    zoned = read.join(broadcast_if_small(cameras), "_camera", "left").join(broadcast_if_small(roots), "_root", "left")
    zoned = zoned.withColumn("_zone", F.coalesce(F.when(F.col("field") == "exif_date_taken", F.col("_camera_zone")), F.col("_root_zone")))
    return zoned.select("id", "field", instant_us(F.col("_zone")).alias("instant_us")).where("instant_us is not null")
