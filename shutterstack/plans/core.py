"""Queries of the general data problems, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterstack.operators.instants import ZONE_LETTERS, media_instants
from shutterstack.operators.snapshots import snapshot_changes
from shutterstack.operators.spatial import media_near_and_inside
from shutterstack.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return media_near_and_inside(read_table(spark, folder, "media"), read_table(spark, folder, "places"))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    return media_near_and_inside(read_table(spark, folder, "media"), read_table(spark, folder, "places"), copies="members")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(read_table(spark, folder, "files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return media_instants(read_table(spark, folder, "media"), read_table(spark, folder, "zone_hints"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_members": p1_members, "p5_found": p5_found, "p6_found": p6_found}

#: White space that compares as nothing at the ends of a value, as a SQL expression.
SPACE_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8239) || chr(65279)"
CURRENT_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM media WHERE id IS NOT NULL) WHERE rn = 1"

P1_SQL = f"""
WITH spots AS (
  SELECT id, exif_gps_lat AS lat, exif_gps_lon AS lon, radians(exif_gps_lat) AS y, radians(exif_gps_lon) AS x FROM ({CURRENT_SQL})
  WHERE NOT coalesce(tombstone, false) AND exif_gps_lat BETWEEN -90 AND 90 AND exif_gps_lon BETWEEN -180 AND 180 AND NOT (exif_gps_lat = 0 AND exif_gps_lon = 0)
), near AS (
  SELECT a.id AS a, b.id AS b, 2 * asin(least(1, sqrt(pow(sin((a.y - b.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((a.x - b.x) / 2), 2)))) * 6371008.8 AS d
  FROM spots a JOIN spots b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001
), corners AS (
  SELECT place_id, len(ring_lat) AS n, generate_subscripts(ring_lat, 1) AS i, unnest(ring_lat) AS lat, unnest(ring_lon) AS lon FROM places
), sides AS (
  SELECT p.place_id, p.lat AS ay, p.lon AS ax, q.lat AS by_, q.lon AS bx FROM corners p JOIN corners q ON p.place_id = q.place_id AND q.i = p.i % p.n + 1
), turned AS (SELECT s.*, lon + t.turn AS gx, t.turn FROM spots s, (VALUES (-360), (0), (360)) t(turn)
), inside AS (
  SELECT s.id, e.place_id, s.turn FROM turned s JOIN sides e ON (e.ay > s.lat) <> (e.by_ > s.lat) AND s.gx < (e.bx - e.ax) * (s.lat - e.ay) / (e.by_ - e.ay) + e.ax
  GROUP BY s.id, e.place_id, s.turn HAVING count(*) % 2 = 1
)
SELECT 'near' AS relation, a AS left_key, b AS right_key FROM near WHERE d <= 60
UNION ALL SELECT DISTINCT 'inside', id, CAST(place_id AS VARCHAR) FROM inside
"""

# a location that several ids share is represented by the smallest; -180 is the meridian 180
P1_MEMBERS_SQL = f"""
WITH pairs AS ({P1_SQL}), placed AS (
  SELECT id, exif_gps_lat + 0.0 AS lat, CASE WHEN exif_gps_lon = -180 THEN 180 ELSE exif_gps_lon + 0.0 END AS lon FROM ({CURRENT_SQL})
  WHERE NOT coalesce(tombstone, false) AND exif_gps_lat BETWEEN -90 AND 90 AND exif_gps_lon BETWEEN -180 AND 180 AND NOT (exif_gps_lat = 0 AND exif_gps_lon = 0)
), reps AS (SELECT id, min(id) OVER (PARTITION BY lat, lon) AS rep FROM placed)
SELECT 'same' AS relation, rep AS left_key, id AS right_key FROM reps WHERE id <> rep
UNION ALL SELECT relation, left_key, right_key FROM pairs WHERE left_key IN (SELECT rep FROM reps) AND (relation = 'inside' OR right_key IN (SELECT rep FROM reps))
"""

P5_SQL = f"""
WITH rows_ AS (
  SELECT snapshot_no, file_path, lower(trim(file_hash, {SPACE_SQL})) AS h, lower(trim(status, {SPACE_SQL})) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, file_path ORDER BY last_seen DESC NULLS LAST) AS rn FROM files WHERE file_path IS NOT NULL AND snapshot_no IS NOT NULL
  ) WHERE rn = 1
), numbers AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM files WHERE snapshot_no IS NOT NULL)),
before AS (SELECT next_no AS snapshot_no, file_path, h, s FROM rows_ JOIN numbers USING (snapshot_no) WHERE next_no IS NOT NULL),
after AS (SELECT r.* FROM rows_ r JOIN numbers n ON n.next_no = r.snapshot_no)
SELECT snapshot_no, file_path, CASE WHEN b.file_path IS NULL THEN 'added' WHEN a.file_path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT *, true AS old FROM before) b FULL JOIN (SELECT *, true AS new FROM after) a USING (snapshot_no, file_path)
WHERE old IS NULL OR new IS NULL OR a.h IS DISTINCT FROM b.h OR a.s IS DISTINCT FROM b.s
"""

_LETTERS = ", ".join(f"('{k}', {v})" for k, v in ZONE_LETTERS.items())
_FORMS = {
    "iso": r"^(\d{4})[-:/](\d\d)[-:/](\d\d)[T ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)? ?([+-]\d\d:?\d{0,2}|[A-Za-z]+)?(?:\[.*\])?$",
    "packed": r"^(\d{4})(\d\d)(\d\d)[T_](\d\d)(\d\d)(\d\d)()(Z)?$",
    "dotted": r"^(\d\d)\.(\d\d)\.(\d{4}) (\d\d):(\d\d)(?::(\d\d))?$",
    "half": r"^(\d\d)/(\d\d)/(\d{4}) (\d{1,2}):(\d\d):(\d\d)[ \x{202f}]([AP]M)$",
    "mail": r"^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d):(\d\d) ?([+-]\d{4}|GMT)?$",
    "named": r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) (\d\d):(\d\d):(\d\d) ([ap]m)$",
}


def _form(kind: str, order: str) -> str:
    pattern = _FORMS[kind].replace(r"\x{202f}", "\u202f")
    parts = {c: f"regexp_extract(v, '{pattern}', {i})" for i, c in enumerate(order, 1)}
    month = f"CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({parts['b']})) + 2) / 3 AS INT)" if "b" in parts else f"CAST({parts['o']} AS INT)"
    zone = parts.get("z", "''")
    return f"""SELECT id, field, file_path, exif_camera_model, CAST({parts['y']} AS INT) AS y, {month} AS o, CAST({parts['d']} AS INT) AS d, CAST({parts['h']} AS INT) AS h, CAST({parts['m']} AS INT) AS m,
      coalesce(try_cast({parts['s']} AS INT), 0) AS s, {parts.get('f', "''")} AS f, lower({parts.get('p', "''")}) AS p, lower({zone}) AS z FROM vals WHERE regexp_full_match(v, '{pattern}')"""


P6_SQL = f"""
WITH cur AS ({CURRENT_SQL}),
vals AS (
  SELECT id, file_path, exif_camera_model, 'exif_date_taken' AS field, trim(exif_date_taken, {SPACE_SQL} || chr(34)) AS v FROM cur WHERE exif_date_taken IS NOT NULL
  UNION ALL SELECT id, file_path, exif_camera_model, 'file_modified', trim(file_modified, {SPACE_SQL} || chr(34)) FROM cur WHERE file_modified IS NOT NULL
), parts AS (
  {_form("iso", "yodhmsfz")} UNION ALL {_form("packed", "yodhmsfz")} UNION ALL {_form("dotted", "doyhms")} UNION ALL {_form("half", "odyhmsp")} UNION ALL {_form("mail", "dbyhmsz")} UNION ALL {_form("named", "bdyhmsp")}
), clock AS (
  SELECT *, CASE WHEN p = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN p[1] = 'p' THEN 12 ELSE 0 END END AS hour,
    try_cast(printf('%04d-%02d-%02d', y, o, d) AS DATE) AS day FROM parts
), walls AS (
  SELECT c.*, epoch_us(CAST(day AS TIMESTAMP)) + ((hour * 60 + m) * 60 + s) * 1000000::BIGINT + CAST(rpad(left(f, 6), 6, '0') AS BIGINT) AS wall,
    CASE WHEN z = '' THEN NULL WHEN z[1] IN ('+', '-') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 60 + coalesce(try_cast(replace(z[4:], ':', '') AS INT), 0)) ELSE letters.minutes END AS minutes
  FROM clock c LEFT JOIN (VALUES {_LETTERS}) letters(letter, minutes) ON letters.letter = c.z
  WHERE day IS NOT NULL AND hour BETWEEN 0 AND 23 AND m < 60 AND s < 60
), hinted AS (
  SELECT w.*, coalesce(CASE WHEN field = 'exif_date_taken' THEN a.zone_name END, b.zone_name) AS zone FROM walls w
  LEFT JOIN zone_hints a ON a.scope = 'camera_model' AND lower(trim(a.hint_name)) = lower(trim(w.exif_camera_model, {SPACE_SQL}))
  LEFT JOIN zone_hints b ON b.scope = 'library_root' AND b.hint_name = regexp_extract(w.file_path, '^/*([^/]+)', 1)
), zoned AS (
  SELECT id, field, minutes, z, wall, zone, epoch_us(timezone(zone, make_timestamp(wall))) AS placed,
    epoch_us(timezone(zone, make_timestamp(wall - 10800000000))) + 10800000000 AS earlier FROM hinted
)
SELECT id, field, CASE WHEN minutes IS NOT NULL THEN wall - minutes * 60000000::BIGINT
  -- the offset in force three hours before decides a wall time that occurs twice or never
  WHEN epoch_us(timezone(zone, to_timestamp(earlier / 1000000.0))) IN (wall, wall - wall % 1000000) OR timezone(zone, to_timestamp(floor(earlier / 1000000))) = make_timestamp(wall - wall % 1000000) OR timezone(zone, to_timestamp(floor(placed / 1000000))) <> make_timestamp(wall - wall % 1000000) THEN earlier
  ELSE placed END AS instant_us
FROM zoned WHERE minutes IS NOT NULL OR (z = '' AND zone IS NOT NULL)
UNION ALL
SELECT id, field, CAST(v AS BIGINT) * CASE WHEN length(v) <= 10 THEN 1000000 WHEN length(v) <= 13 THEN 1000 ELSE 1 END FROM vals WHERE regexp_full_match(v, '\\d{{9,10}}|\\d{{12,13}}|\\d{{15,16}}')
"""

SQL: dict[str, str] = {"p1_found": P1_SQL, "p1_members": P1_MEMBERS_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
