"""Queries of the media catalog operators, each with the SQL it is checked against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterstack.functions import media as rules
from shutterstack.functions.text import folded
from shutterstack.functions.vectors import dot, literal, norm, normalised, rounded
from shutterstack.operators import browse, catalog, changes, dedup, frames, jobs, search, transcode
from shutterstack.operators.knn import fit_centroids, ivf_assign, ivf_join, ivf_search, knn
from shutterstack.plans import domain
from shutterstack.plans.core import CURRENT_SQL, SPACE_SQL
from shutterstack.schemas import ENQUEUED, IMAGE_EXTENSIONS, STAGES, STATUSES, VIDEO_EXTENSIONS
from shutterstack.session import read_table
from shutterstack.sources.scan import content_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _files_sql(back: int) -> str:
    number = "SELECT max(snapshot_no) FROM files" if not back else "SELECT max(snapshot_no) FROM files WHERE snapshot_no < (SELECT max(snapshot_no) FROM files)"
    return f"""SELECT lower(trim(file_hash, {SPACE_SQL})) AS file_hash, file_path, file_size, file_modified, first_seen, last_seen, lower(trim(status, {SPACE_SQL})) AS status
      FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY last_seen DESC NULLS LAST) AS rn FROM files WHERE file_path IS NOT NULL AND snapshot_no = ({number})) WHERE rn = 1"""


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


_EXT = r"lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]*)$', 1))"
_KIND = f"CASE WHEN {_EXT} IN {_listed(IMAGE_EXTENSIONS)} THEN 'image' WHEN {_EXT} IN {_listed(VIDEO_EXTENSIONS)} THEN 'video' END"
_RAW = "coalesce(exif_date_taken, file_modified)"
_TAKEN = f"try_cast(left(translate(CASE WHEN regexp_matches({_RAW}, '{search.TAKEN}') THEN {_RAW} END, 'TZ', ' '), 26) AS TIMESTAMP)"
BASE = f"""
WITH RECURSIVE cur AS ({CURRENT_SQL}),
vec AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM cur WHERE len(embedding) = {domain.DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
qv AS (SELECT v AS q FROM vec ORDER BY id LIMIT 1),
near AS (SELECT vec.*, {_l2("v", "q")} AS d FROM vec, qv),
f0 AS ({_files_sql(0)}), f1 AS ({_files_sql(1)}),
scan AS (SELECT DISTINCT file_hash, file_path, file_size, file_modified FROM f0 WHERE status = 'active' AND file_hash IS NOT NULL),
act AS (SELECT DISTINCT file_hash, file_path FROM f1 WHERE status = 'active' AND file_hash IS NOT NULL),
chg AS (
  SELECT CASE WHEN a.file_hash IS NOT NULL THEN 'unchanged' WHEN h.old IS NOT NULL THEN 'moved' WHEN p.file_path IS NOT NULL THEN 'modified' ELSE 'new' END AS kind, s.file_hash, s.file_path,
    CASE WHEN a.file_hash IS NULL THEN h.old END AS old_path
  FROM (SELECT DISTINCT file_hash, file_path FROM scan) s LEFT JOIN act a ON a.file_hash = s.file_hash AND a.file_path = s.file_path
  LEFT JOIN (SELECT file_hash, min(file_path) AS old FROM act GROUP BY 1) h ON h.file_hash = s.file_hash LEFT JOIN (SELECT DISTINCT file_path FROM act) p ON p.file_path = s.file_path
  UNION ALL SELECT 'deleted', file_hash, file_path, NULL FROM act WHERE file_hash NOT IN (SELECT file_hash FROM scan)
),
jobs AS (
  SELECT event_id AS id, sha256(CAST(user_id AS VARCHAR)) AS file_hash, ({_listed(STAGES).replace("(", "[").replace(")", "]")})[event_id % 6 + 1] AS stage,
    CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'pending' END AS status,
    CAST(event_id % 4 AS INT) AS attempts, ts AS created_at, CASE WHEN event_type = 'click' THEN 'w' || (event_id % 5) END AS worker_id FROM events
),
fjobs AS (
  SELECT DISTINCT file_hash, file_path, (['extract_metadata', 'embed', 'index', 're_embed'])[ascii(file_hash) % 4 + 1] AS stage, CASE ascii(substr(file_hash, 2, 1)) % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'pending' END AS status
  FROM f1 WHERE file_hash IS NOT NULL
),
dup AS (SELECT DISTINCT lower(trim(file_hash, {SPACE_SQL})) AS file_hash, path AS file_path, size AS file_size, modified AS file_modified FROM duplicate_files WHERE file_hash IS NOT NULL),
meta AS (SELECT * EXCLUDE (file_hash), lower(trim(file_hash, {SPACE_SQL})) AS file_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(file_hash, {SPACE_SQL})) ORDER BY updated_at DESC, id DESC) AS r FROM cur WHERE media_type <> 'video_frame') WHERE r = 1),
frm AS (SELECT source_video_path AS video, frame_index, id, v, row_number() OVER (PARTITION BY source_video_path ORDER BY frame_index NULLS FIRST, id) AS r FROM vec WHERE media_type = 'video_frame' AND source_video_path IS NOT NULL)
"""


def query(name: str, sql: str | None = None):
    """Register a query with the SQL (after ``BASE``) that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = BASE + sql
        return f

    return put


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "media_type", _r("distance").alias("distance"), _r("score").alias("score"))


def _vector(spark: SparkSession, folder: str) -> list[float]:
    return domain.query_vector(spark, folder)


def _measured(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return search.measured(read_table(spark, folder, "media"), _vector(spark, folder), *columns)


_SHOWN = "SELECT id, media_type, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM"


@query("search_topk", f"{_SHOWN} near ORDER BY d, id LIMIT 20")
def _(spark, folder):
    return _shown(search.search(_measured(spark, folder, "media_type"), None, limit=20))


_WINDOW = search.Filters(media_type="image", after=dt.datetime(2018, 1, 1), before=dt.datetime(2022, 12, 31, 23, 59, 59))


@query("search_filtered", f"""SELECT * FROM ({_SHOWN} (SELECT *, {_TAKEN} AS taken FROM (SELECT * FROM near ORDER BY d, id LIMIT 40))
  WHERE media_type NOT IN ('video', 'video_frame') AND (taken IS NULL OR taken BETWEEN TIMESTAMP '2018-01-01' AND TIMESTAMP '2022-12-31 23:59:59') ORDER BY 1 / (1 + d) DESC, id LIMIT 10)""")
def _(spark, folder):
    return _shown(search.search(_measured(spark, folder, "media_type", "exif_date_taken", "file_modified"), None, _WINDOW, 10))


@query("search_prefilter", f"""{_SHOWN} (SELECT *, {_TAKEN} AS taken FROM near)
  WHERE media_type NOT IN ('video', 'video_frame') AND (taken IS NULL OR taken BETWEEN TIMESTAMP '2018-01-01' AND TIMESTAMP '2022-12-31 23:59:59') ORDER BY d, id LIMIT 10""")
def _(spark, folder):
    return _shown(search.search(_measured(spark, folder, "media_type", "exif_date_taken", "file_modified"), None, _WINDOW, 10, prefilter=True))


@query("search_extended_filters", f"{_SHOWN} near WHERE width >= 1000 AND height >= 700 AND lower(file_ext) = 'jpg' AND exif_camera_model = 'LV-200' AND exif_gps_lat IS NOT NULL AND exif_gps_lon IS NOT NULL ORDER BY d, id LIMIT 10")
def _(spark, folder):
    only = search.Filters(min_width=1000, min_height=700, file_ext="JPG", camera_model="LV-200", has_gps=True)
    return _shown(search.search(_measured(spark, folder, "media_type", "width", "height", "file_ext", "exif_camera_model", "exif_gps_lat", "exif_gps_lon", "exif_date_taken", "file_modified"), None, only, 10, prefilter=True))


@query("search_table", """SELECT row_number() OVER (ORDER BY d, id) AS rank, id, printf('%.3f', 1 / (1 + d)) AS score_text, CASE media_type WHEN 'video_frame' THEN 'frame' ELSE media_type END AS type_label,
  coalesce(width || 'x' || height, '-') AS dims FROM (SELECT * FROM near ORDER BY d, id LIMIT 20)""")
def _(spark, folder):
    return search.display_table(search.search(_measured(spark, folder, "media_type", "width", "height"), None, limit=20))


@query("search_results", """SELECT id, file_path, file_name, media_type, width, height, round(1 / (1 + d), 6) AS score, CASE WHEN source_video_path IS NOT NULL THEN coalesce(frame_index, 0) END AS frame_index FROM near ORDER BY d, id LIMIT 20""")
def _(spark, folder):
    rows = search.result_columns(search.search(_measured(spark, folder, "media_type", "file_path", "file_name", "width", "height", "source_video_path", "frame_index", "frame_timestamp_ms"), None, limit=20))
    return rows.select("id", "file_path", "file_name", "media_type", "width", "height", _r("score").alias("score"), F.col("frame.frame_index").alias("frame_index"))


@query("poc_cosine_search", "SELECT id, round(c, 6) AS score FROM (SELECT id, list_inner_product(v, q) / nullif(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)), 0) AS c FROM vec, qv) ORDER BY c DESC NULLS LAST, id LIMIT 5")
def _(spark, folder):
    rows = search.cosine_search(domain.vectors(spark, folder), _vector(spark, folder))
    return rows.select("id", _r("score").alias("score"))


_PREFIX = "(['', 'type:image ', 'TYPE:video  ', 'type:Video after:2024-01-01 ', 'type:audio before:2024-1-5 ', 'after:soon type:video type:IMAGE ', 'before:2024-02-30 after:2023-03-04 after:2023-05-06 '])[p_partkey % 7 + 1]"


@query("query_parse", f"""SELECT qid, list_aggregate(list_filter(t, lambda x: NOT coalesce((starts_with(x, 'type:') AND lower(x[6:]) IN ('image', 'video')) OR (starts_with(x, 'after:') AND try_cast(CASE WHEN regexp_matches(x[7:], '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN x[7:] END AS DATE) IS NOT NULL)
    OR (starts_with(x, 'before:') AND try_cast(CASE WHEN regexp_matches(x[8:], '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN x[8:] END AS DATE) IS NOT NULL), false)), 'string_agg', ' ') AS text,
  lower(list_filter(t, lambda x: starts_with(x, 'type:') AND lower(x[6:]) IN ('image', 'video'))[-1][6:]) AS media_type,
  CAST(CAST(list_filter(t, lambda x: starts_with(x, 'after:') AND try_cast(CASE WHEN regexp_matches(x[7:], '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN x[7:] END AS DATE) IS NOT NULL)[-1][7:] AS DATE) AS TIMESTAMP) AS after_ts,
  CAST(list_filter(t, lambda x: starts_with(x, 'before:') AND try_cast(CASE WHEN regexp_matches(x[8:], '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN x[8:] END AS DATE) IS NOT NULL)[-1][8:] AS DATE) + INTERVAL '23:59:59' AS before_ts
FROM (SELECT p_partkey AS qid, list_filter(regexp_split_to_array({_PREFIX} || p_name, '\\s+'), lambda x: x <> '') AS t FROM part)""")
def _(spark, folder):
    prefixes = ["", "type:image ", "TYPE:video  ", "type:Video after:2024-01-01 ", "type:audio before:2024-1-5 ", "after:soon type:video type:IMAGE ", "before:2024-02-30 after:2023-03-04 after:2023-05-06 "]
    text = F.concat(F.get(F.array(*map(F.lit, prefixes)), (F.col("p_partkey") % 7).cast("int")), F.col("p_name"))
    return search.parse_queries(read_table(spark, folder, "part").select(F.col("p_partkey").alias("qid"), text.alias("query")))


@query("vec_normalize", "SELECT vec_id AS id, round(sqrt(list_inner_product(s, s)), 6) AS norm_before, list_transform(s, lambda x: round(x / CASE WHEN vec_id % 5 = 0 THEN 1 ELSE sqrt(list_inner_product(s, s)) END, 6)) AS unit FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 5)) AS s FROM embeddings)")
def _(spark, folder):
    rows = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("s"))
    return rows.select("id", rounded(norm(F.col("s")), 6).alias("norm_before"), F.transform(normalised(F.col("s")), lambda x: rounded(x, 6)).alias("unit"))


@query("vec_cosine", "SELECT e.vec_id AS id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) o")
def _(spark, folder):
    e = read_table(spark, folder, "embeddings")
    one = e.where("vec_id = 0").select("embedding").first()[0]
    return e.select(F.col("vec_id").alias("id"), _r(dot(F.col("embedding"), literal(one))).alias("cos"))


@query("catalog_scan", "SELECT id, file_hash, file_name, media_type, width, tombstone FROM cur")
def _(spark, folder):
    return domain.media(spark, folder, "file_hash", "file_name", "media_type", "width", "tombstone").select("id", "file_hash", "file_name", "media_type", "width", "tombstone")


@query("catalog_count", "SELECT count(*) AS n FROM cur")
def _(spark, folder):
    return domain.media(spark, folder, "tombstone").agg(F.count("*").alias("n"))


@query("catalog_get_by_id", "SELECT id, file_name FROM cur WHERE id = (SELECT min(id) FROM cur)")
def _(spark, folder):
    rows = domain.media(spark, folder, "file_name")
    return catalog.by_id(rows, rows.agg(F.min("id")).first()[0]).select("id", "file_name")


@query("catalog_get_by_hash", "SELECT id, file_name FROM cur WHERE file_hash = (SELECT min(file_hash) FROM cur WHERE media_type = 'video_frame')")
def _(spark, folder):
    rows = domain.media(spark, folder, "file_name", "file_hash", "media_type")
    return catalog.by_hash(rows, rows.where("media_type = 'video_frame'").agg(F.min("file_hash")).first()[0]).select("id", "file_name")


@query("catalog_list_page", "SELECT id, file_name, media_type, (SELECT count(*) FROM cur WHERE media_type = 'image') AS total FROM cur WHERE media_type = 'image' ORDER BY id LIMIT 25 OFFSET 10")
def _(spark, folder):
    return catalog.list_page(domain.media(spark, folder, "file_name", "media_type"), 10, 25, "image")


@query("catalog_upsert", "SELECT id, CASE WHEN media_type = 'image' THEN width + 1 ELSE width END AS width FROM cur UNION ALL SELECT 'new-' || id, width FROM cur WHERE media_type = 'video'")
def _(spark, folder):
    rows = domain.media(spark, folder, "width", "media_type").select("id", "width", "media_type")
    delta = rows.where("media_type = 'image'").withColumn("width", F.col("width") + 1).unionByName(rows.where("media_type = 'video'").withColumn("id", F.concat(F.lit("new-"), "id")))
    return catalog.upsert(rows, delta).select("id", "width")


@query("catalog_tombstone", "SELECT id, coalesce(tombstone, false) OR file_hash IN (SELECT file_hash FROM chg WHERE kind = 'deleted') AS tombstone FROM cur")
def _(spark, folder):
    return catalog.tombstoned(domain.media(spark, folder, "file_hash", "tombstone").select("id", "file_hash", "tombstone"), _changes(spark, folder)).select("id", "tombstone")


@query("reembed_merge", f"""SELECT id, CASE WHEN w IS NOT NULL THEN 'new-model' ELSE model_id END AS model_id, CASE WHEN w IS NOT NULL THEN list_transform(w, lambda x: round(x, 4)) END AS embedding, CASE WHEN w IS NOT NULL THEN '2' ELSE model_version END AS model_version, CASE WHEN w IS NOT NULL THEN '2025-01-01T00:00:00Z' ELSE updated_at END AS updated_at
  FROM cur LEFT JOIN (SELECT file_hash, max(list_transform(v, lambda x: x * 2)) AS w FROM vec WHERE media_type = 'image' GROUP BY 1) n USING (file_hash)""")
def _(spark, folder):
    # + 0.0 makes -0.0 zero, as the SQL's maximum of lists does
    new = domain.vectors(spark, folder, "media_type", "file_hash").where("media_type = 'image'").select("file_hash", F.transform("embedding", lambda x: x.cast("double") * 2 + 0.0).alias("vector"))
    rows = catalog.reembedded(domain.media(spark, folder, "file_hash", "embedding", "model_id", "model_version", "updated_at").select("id", "file_hash", "embedding", "model_id", "model_version", "updated_at"), new, "new-model", "2", "2025-01-01T00:00:00Z")
    return rows.select("id", "model_id", F.when(F.col("model_id") == "new-model", F.transform("embedding", lambda x: rounded(x.cast("double"), 4))).alias("embedding"), "model_version", "updated_at")


@query("content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(spark, folder):
    return content_hash(read_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "file_hash")


@query("scan_classify", f"SELECT file_path, {_EXT} AS ext, {_KIND} AS media_type FROM f0 WHERE {_KIND} IS NOT NULL")
def _(spark, folder):
    return browse.classify(domain.files(spark, folder))


def _changes(spark, folder):
    return changes.detect_changes(domain.files(spark, folder, 1), domain.scanned(spark, folder))


@query("detect_changes", "SELECT kind, file_hash, file_path, old_path FROM chg")
def _(spark, folder):
    return _changes(spark, folder)


@query("change_summary", "SELECT kind, count(*) AS n FROM chg GROUP BY 1")
def _(spark, folder):
    return changes.change_summary(_changes(spark, folder))


@query("apply_changes", """SELECT file_hash, file_path, CASE WHEN fresh THEN 'active' WHEN d.file_path IS NOT NULL THEN 'deleted' ELSE status END AS status
  FROM (SELECT file_hash, file_path, min(status) AS status, true AS old FROM f1 WHERE file_hash IS NOT NULL GROUP BY 1, 2) k
  FULL JOIN (SELECT DISTINCT file_hash, file_path, true AS fresh FROM chg WHERE kind IN ('new', 'modified', 'moved')) c USING (file_hash, file_path)
  LEFT JOIN (SELECT DISTINCT file_hash, file_path FROM chg WHERE kind = 'deleted') d USING (file_hash, file_path)
  WHERE fresh OR NOT ((file_hash, file_path) IN (SELECT (file_hash, old_path) FROM chg WHERE kind = 'moved') AND (file_hash, file_path) NOT IN (SELECT (file_hash, file_path) FROM chg WHERE kind = 'unchanged'))""")
def _(spark, folder):
    return changes.apply_changes(domain.files(spark, folder, 1), _changes(spark, folder))


@query("files_active", "SELECT file_hash, file_path FROM f0 WHERE status = 'active'")
def _(spark, folder):
    return domain.files(spark, folder).where("status = 'active'").select("file_hash", "file_path")


@query("files_by_hash", "SELECT file_path, status FROM f0 WHERE file_hash = (SELECT min(file_hash) FROM f0)")
def _(spark, folder):
    rows = domain.files(spark, folder)
    return browse.files_by(rows, "file_hash", rows.agg(F.min("file_hash")).first()[0]).select("file_path", "status")


@query("files_by_path", "SELECT file_hash, status FROM f0 WHERE file_path = (SELECT max(file_path) FROM f0)")
def _(spark, folder):
    rows = domain.files(spark, folder)
    return browse.files_by(rows, "file_path", rows.agg(F.max("file_path")).first()[0]).select("file_hash", "status")


@query("files_count", "SELECT count(*) AS n FROM f0 WHERE status = 'active'")
def _(spark, folder):
    return domain.files(spark, folder).where("status = 'active'").agg(F.count("*").alias("n"))


@query("files_upsert", """SELECT file_hash, coalesce(n.file_path, o.file_path) AS file_path, coalesce(first_seen, '2024-03-01T00:00:00Z') AS first_seen, CASE WHEN n.file_path IS NOT NULL THEN 'active' ELSE status END AS status
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY file_path DESC) AS k FROM f1 WHERE file_hash IS NOT NULL) WHERE k = 1) o
  FULL JOIN (SELECT file_hash, max(file_path) AS file_path FROM scan GROUP BY 1) n USING (file_hash)""")
def _(spark, folder):
    return changes.upsert_files(domain.files(spark, folder, 1), domain.scanned(spark, folder), "2024-03-01T00:00:00Z").select("file_hash", "file_path", "first_seen", "status")


@query("files_page", f"""SELECT file_path, file_size, {_KIND} AS media_type, (SELECT count(*) FROM f0 WHERE status = 'active' AND {_KIND} = 'image') AS total FROM f0 WHERE status = 'active' AND {_KIND} = 'image'
  ORDER BY file_size DESC NULLS LAST, file_path LIMIT 20 OFFSET 20""")
def _(spark, folder):
    return browse.browse_files(domain.files(spark, folder), "image", "size", 2, 20).select("file_path", "file_size", "media_type", "total")


def _file_jobs(spark, folder):
    rows = domain.files(spark, folder, 1).where("file_hash is not null")
    stage = F.get(F.array(*map(F.lit, ("extract_metadata", "embed", "index", "re_embed"))), F.ascii("file_hash") % 4)
    second = F.ascii(F.substring("file_hash", 2, 1)) % 3
    return rows.select("file_hash", "file_path", stage.alias("stage"), F.when(second == 0, "failed").when(second == 1, "completed").otherwise("pending").alias("status")).distinct()


@query("jobs_enqueue", f"""SELECT file_hash, stage, 'pending' AS status FROM (SELECT DISTINCT file_hash FROM f0 WHERE status = 'active' AND file_hash IS NOT NULL), (SELECT unnest({list(ENQUEUED)}) AS stage)
  WHERE (file_hash, stage) NOT IN (SELECT (file_hash, stage) FROM fjobs WHERE status <> 'failed')""")
def _(spark, folder):
    return jobs.enqueue(domain.files(spark, folder).where("status = 'active'"), _file_jobs(spark, folder))


@query("jobs_enqueue_changes", f"""SELECT DISTINCT file_hash, stage, 'pending' AS status FROM (SELECT file_hash, unnest({list(ENQUEUED)}) AS stage FROM chg WHERE kind IN ('new', 'modified') UNION SELECT file_hash, 'index' FROM chg WHERE kind = 'deleted')
  WHERE (file_hash, stage) NOT IN (SELECT (file_hash, stage) FROM fjobs WHERE status <> 'failed')""")
def _(spark, folder):
    return jobs.enqueue_changes(_changes(spark, folder), _file_jobs(spark, folder))


@query("jobs_enqueue_reembed", """SELECT DISTINCT file_hash, 're_embed' AS stage, 'pending' AS status, 'clip-vit-l-14' AS model_id, '1' AS model_version FROM f0 WHERE status = 'active' AND file_hash IS NOT NULL
  AND file_hash NOT IN (SELECT file_hash FROM fjobs WHERE status <> 'failed' AND stage = 're_embed')""")
def _(spark, folder):
    return jobs.enqueue_reembed(domain.files(spark, folder), _file_jobs(spark, folder), "clip-vit-l-14", "1")


def _now():
    return F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")


@query("jobs_claim", """SELECT stage, id, 'running' AS status, attempts + 1 AS attempts, 'w1' AS worker_id, TIMESTAMP '2025-01-02 03:04:05' AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY created_at, id) AS k FROM jobs WHERE status = 'pending') WHERE k <= 3""")
def _(spark, folder):
    return jobs.claim(domain.jobs(spark, folder), "w1", 3, now=_now())


@query("jobs_transition", """SELECT id, CASE WHEN status = 'running' THEN (['completed', 'skipped', 'failed'])[id % 3 + 1] ELSE status END AS status, CASE WHEN status = 'running' AND id % 3 = 2 THEN 'broken ' || id END AS error_message, CASE WHEN status = 'running' THEN TIMESTAMP '2025-01-02 03:04:05' END AS completed_at, CASE WHEN status = 'running' THEN created_at END AS started_at FROM jobs""")
def _(spark, folder):
    rows = domain.jobs(spark, folder)
    outcome = F.get(F.array(*map(F.lit, ("completed", "skipped", "failed"))), (F.col("id") % 3).cast("int"))
    return jobs.transition(rows, rows.where("status = 'running'").select("id", outcome.alias("outcome"), F.concat(F.lit("broken "), F.col("id").cast("string")).alias("message")), _now()).select("id", "status", "error_message", "completed_at", "started_at")


@query("jobs_reset", "SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'running' THEN worker_id END AS worker_id FROM jobs")
def _(spark, folder):
    return jobs.reset_running(domain.jobs(spark, folder)).select("id", "status", "worker_id")


@query("jobs_update_paths", """SELECT file_hash, stage, CASE WHEN status IN ('pending', 'running') THEN coalesce(m.p, file_path) ELSE file_path END AS file_path FROM fjobs LEFT JOIN (SELECT file_hash, max(file_path) AS p FROM chg WHERE kind = 'moved' GROUP BY 1) m USING (file_hash)""")
def _(spark, folder):
    return jobs.update_paths(_file_jobs(spark, folder), _changes(spark, folder)).select("file_hash", "stage", "file_path")


@query("queue_stats", f"SELECT s.status, count(j.id) AS n FROM (SELECT unnest({list(STATUSES)}) AS status) s LEFT JOIN jobs j USING (status) GROUP BY 1")
def _(spark, folder):
    return jobs.queue_stats(domain.jobs(spark, folder))


@query("queue_stats_by_stage", "SELECT stage, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + " FROM jobs GROUP BY 1")
def _(spark, folder):
    return jobs.queue_stats_by_stage(domain.jobs(spark, folder))


@query("queue_progress", "SELECT count(*) FILTER (status IN ('completed', 'skipped', 'failed')) AS done, count(*) AS total FROM jobs")
def _(spark, folder):
    return jobs.queue_progress(domain.jobs(spark, folder))


@query("models_activate", "SELECT * FROM (VALUES ('clip-vit-h-14', false), ('clip-vit-l-14', true), ('clip-vit-b-32', false)) t(model_id, is_current)")
def _(spark, folder):
    return catalog.activate(domain.models(spark), "clip-vit-l-14").select("model_id", "is_current")


@query("models_register", "SELECT * FROM (VALUES ('clip-vit-h-14', '2', true), ('clip-vit-l-14', '1', false), ('clip-vit-b-32', '2', false), ('siglip', '1', false)) t(model_id, model_version, is_current)")
def _(spark, folder):
    add = spark.createDataFrame([("clip-vit-h-14", "2", 1024, False), ("siglip", "1", 768, False)], "model_id string, model_version string, dimensions int, is_current boolean")
    stamp = F.lit("2025-01-01T00:00:00Z")
    return catalog.register(domain.models(spark).withColumn("registered_at", stamp), add.withColumn("registered_at", stamp)).select("model_id", "model_version", "is_current")


@query("config_kv", "SELECT * FROM (VALUES ('last_scan_time', '2025-01-02'), ('root', '/library')) t(key, value)")
def _(spark, folder):
    base = spark.createDataFrame([("last_scan_time", "2025-01-01"), ("root", "/library")], "key string, value string")
    return catalog.upsert(base, spark.createDataFrame([("last_scan_time", "2025-01-02")], base.schema), "key")


@query("catalog_stats", "SELECT 'catalog' AS metric, count(*) AS value FROM cur UNION ALL SELECT 'files_active', count(*) FROM f0 WHERE status = 'active' UNION ALL SELECT 'models', 3 UNION ALL SELECT 'jobs_' || status, count(*) FROM jobs GROUP BY 1")
def _(spark, folder):
    return browse.catalog_stats(domain.media(spark, folder, "tombstone"), domain.files(spark, folder), domain.jobs(spark, folder), domain.models(spark))


@query("browse_page", """SELECT id, file_name, media_type, (SELECT count(*) FROM cur WHERE NOT coalesce(tombstone, false) AND media_type IN ('video', 'video_frame')) AS total FROM cur WHERE NOT coalesce(tombstone, false) AND media_type IN ('video', 'video_frame')
  ORDER BY file_size DESC NULLS LAST, id LIMIT 25 OFFSET 25""")
def _(spark, folder):
    return browse.browse(domain.media(spark, folder, "file_name", "file_path", "media_type", "file_size", "indexed_at", "tombstone"), "video", "size", 2, 25).select("id", "file_name", "media_type", "total")


@query("browse_newest", "SELECT id, file_name, (SELECT count(*) FROM cur WHERE NOT coalesce(tombstone, false)) AS total FROM cur WHERE NOT coalesce(tombstone, false) ORDER BY indexed_at DESC NULLS LAST, id LIMIT 50")
def _(spark, folder):
    return browse.browse(domain.media(spark, folder, "file_name", "file_path", "media_type", "file_size", "indexed_at", "tombstone")).select("id", "file_name", "total")


def _duplicates(spark, folder):
    return read_table(spark, folder, "duplicate_files").select(folded("file_hash").alias("file_hash"), F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.col("modified").alias("file_modified"), F.lit("active").alias("status"))


@query("exact_duplicates", "SELECT file_hash, file_path, n FROM dup JOIN (SELECT file_hash, count(*) AS n FROM dup GROUP BY 1 HAVING count(*) > 1) USING (file_hash)")
def _(spark, folder):
    return dedup.exact_duplicates(_duplicates(spark, folder))


@query("exact_duplicate_sets", "SELECT file_hash, count(*) AS n, min(file_path) AS first_path, max(file_path) AS last_path, sum(file_size)::BIGINT AS bytes FROM dup GROUP BY 1 HAVING count(*) > 1")
def _(spark, folder):
    return dedup.exact_duplicate_sets(_duplicates(spark, folder))


@query("exact_duplicate_summary", "SELECT count(*) AS sets, sum(n)::BIGINT AS files, sum(n - 1)::BIGINT AS wasted FROM (SELECT count(*) AS n FROM dup GROUP BY file_hash HAVING count(*) > 1)")
def _(spark, folder):
    return dedup.exact_duplicate_summary(_duplicates(spark, folder))


@query("knn", f"""SELECT q, n, rank, round(d, 6) AS distance FROM (SELECT q, n, d, row_number() OVER (PARTITION BY q ORDER BY d, n) AS rank
  FROM (SELECT CAST(a.vec_id AS VARCHAR) AS q, CAST(b.vec_id AS VARCHAR) AS n, {_l2("CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 20""")
def _(spark, folder):
    rows = read_table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return knn(rows.where("cast(id as long) % 100 = 0"), rows, 20).withColumn("distance", _r("distance"))


def _ranked_sql(queries: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, n) AS k FROM (
      SELECT a.id AS q, b.id AS n, a.media_type AS qt, b.media_type AS nt, coalesce(a.source_video_path, a.file_path) AS va, coalesce(b.source_video_path, b.file_path) AS vb, {_l2("a.v", "b.v")} AS d FROM vec a, vec b WHERE {queries})) WHERE k <= {k})"""


_EDGES_SQL = f"""SELECT least(q, n) AS a, greatest(q, n) AS b, max(1 - d / 2) AS similarity FROM {_ranked_sql("a.media_type <> 'video_frame'", 20)} WHERE q <> n AND nt <> 'video_frame' AND 1 - d / 2 >= 0.92 GROUP BY 1, 2"""


@query("visual_edges", f"SELECT a, b, round(similarity, 6) AS similarity FROM ({_EDGES_SQL})")
def _(spark, folder):
    return dedup.visual_edges(domain.vectors(spark, folder, "media_type")).withColumn("similarity", _r("similarity"))


@query("visual_clusters", f""", edges AS MATERIALIZED ({_EDGES_SQL}), links AS (SELECT a, b, similarity FROM edges UNION ALL SELECT b, a, similarity FROM edges),
  reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
  SELECT least(id, lo) AS cluster_id, id, round(s, 6) AS similarity FROM (SELECT id, min(other) AS lo FROM reach GROUP BY 1) JOIN (SELECT a AS id, max(similarity) AS s FROM links GROUP BY 1) USING (id)""")
def _(spark, folder):
    return dedup.visual_clusters(domain.vectors(spark, folder, "media_type")).withColumn("similarity", _r("similarity"))


@query("cross_video_pairs", f""", pairs AS (SELECT DISTINCT least(va, vb) AS video_a, greatest(va, vb) AS video_b, least(q, n) AS fa, greatest(q, n) AS fb FROM {_ranked_sql("a.media_type = 'video_frame'", 10)} WHERE nt = 'video_frame' AND va <> vb AND 1 - d / 2 >= 0.92),
  totals AS (SELECT coalesce(source_video_path, file_path) AS video, count(*) AS total FROM vec WHERE media_type = 'video_frame' GROUP BY 1)
  SELECT video_a, video_b, count(*) AS shared, any_value(a.total) AS total_a, any_value(b.total) AS total_b, round(count(*) / least(any_value(a.total), any_value(b.total)), 6) AS overlap_ratio
  FROM pairs JOIN totals a ON a.video = video_a JOIN totals b ON b.video = video_b GROUP BY 1, 2""")
def _(spark, folder):
    return dedup.cross_video_pairs(domain.vectors(spark, folder, "media_type", "source_video_path", "file_path")).withColumn("overlap_ratio", _r("overlap_ratio"))


@query("frame_index", "SELECT video, file_path, row_number() OVER (PARTITION BY video ORDER BY file_path) - 1 AS idx FROM (SELECT DISTINCT source_video_path AS video, file_path FROM cur WHERE media_type = 'video_frame' AND file_path LIKE '%.jpg')")
def _(spark, folder):
    return frames.frame_index(domain.media(spark, folder, "media_type", "source_video_path", "file_path").where("media_type = 'video_frame'"))


_VIDEOS_SQL = "SELECT file_path AS video, fps, CAST(floor(duration_ms * CAST(fps AS DOUBLE) / 1000) AS BIGINT) AS frames FROM cur WHERE media_type = 'video' AND fps > 0 AND duration_ms > 0"


def _videos(spark, folder):
    rows = domain.media(spark, folder, "media_type", "file_path", "fps", "duration_ms").where("media_type = 'video' and fps > 0 and duration_ms > 0")
    return rows.select(F.col("file_path").alias("video"), "fps", F.floor(F.col("duration_ms") * F.col("fps").cast("double") / 1000).alias("frames"))


@query("interval_frames", f"""SELECT video, k, frame, round(frame / CAST(fps AS DOUBLE), 2) AS timestamp_sec FROM (
  SELECT video, fps, unnest(range(0, len(g))) AS k, unnest(g) AS frame FROM (SELECT *, range(0, frames, greatest(1, CAST(floor(CAST(fps AS DOUBLE) * 30) AS BIGINT))) AS g FROM ({_VIDEOS_SQL}) WHERE frames > 0))""")
def _(spark, folder):
    return frames.interval_frames(_videos(spark, folder).withColumn("fps", F.col("fps").cast("double"))).select("video", F.col("k").cast("long").alias("k"), "frame", "timestamp_sec")


@query("frame_timestamp", """SELECT id, CASE WHEN pts IS NOT NULL AND fps > 0 THEN CAST(floor(pts / CAST(fps AS DOUBLE) * 1000) AS BIGINT) WHEN pts IS NOT NULL THEN pts WHEN total > 1 AND duration_ms IS NOT NULL THEN CAST(floor(duration_ms * idx / (total - 1)) AS BIGINT) ELSE 0 END AS ts_ms FROM (
  SELECT f.id, try_cast(regexp_extract(name, '(?:^|/)frame_(\\d+)\\.[^./]*$', 1) AS BIGINT) AS pts, coalesce(f.frame_index, 0) AS idx, count(*) OVER (PARTITION BY f.source_video_path) AS total, m.fps, m.duration_ms FROM (
    SELECT *, CASE WHEN frame_index % 2 = 0 THEN file_path ELSE '/frames/still.jpg' END AS name, {h} AS h FROM cur WHERE media_type = 'video_frame') f LEFT JOIN meta m ON m.file_hash = f.h)""".replace("{h}", f"lower(trim(file_hash, {SPACE_SQL}))"))
def _(spark, folder):
    """Times of all frames, by the rate and duration of their videos where those are known; every other name has no number."""
    rows = domain.media(spark, folder, "media_type", "frame_index", "file_path", "file_hash", "source_video_path").where("media_type = 'video_frame'")
    totals = rows.groupBy(F.col("source_video_path").alias("_video")).agg(F.count("*").alias("total"))
    known = domain.metadata(spark, folder).select(F.col("file_hash").alias("_hash"), "fps", "duration_ms")
    both = rows.join(totals, F.col("source_video_path").eqNullSafe(F.col("_video"))).join(known, folded("file_hash") == F.col("_hash"), "left")
    name = F.when(F.col("frame_index") % 2 == 0, F.col("file_path")).otherwise("/frames/still.jpg")
    return both.select("id", rules.frame_time(name, F.coalesce("frame_index", F.lit(0)), F.col("total"), F.col("fps"), F.col("duration_ms")).alias("ts_ms"))


_FOLD_SQL = """, fold(video, r, id, frame_index, kept, last) AS (
    SELECT video, r, id, frame_index, true, v FROM frm WHERE r = 1
    UNION ALL SELECT f.video, f.r, f.id, f.frame_index, NOT list_inner_product(o.last, f.v) > 0.95, CASE WHEN NOT list_inner_product(o.last, f.v) > 0.95 THEN f.v ELSE o.last END FROM fold o JOIN frm f ON f.video = o.video AND f.r = o.r + 1)"""


@query("frame_dedup", _FOLD_SQL + " SELECT video, frame_index, id FROM fold WHERE kept")
def _(spark, folder):
    return frames.reduce_frames(domain.frames(spark, folder)).select("video", "frame_index", "id")


@query("video_embedding", _FOLD_SQL + """, means AS (SELECT video, i, avg(last[i]) AS x, count(*) AS n FROM (SELECT video, last, unnest(range(1, 65)) AS i FROM fold WHERE kept) GROUP BY 1, 2)
  SELECT video, max(n) AS n_kept, list_transform(list(x ORDER BY i), lambda v: round(v / sqrt(sum(x * x)), 5)) AS embedding FROM means GROUP BY 1""")
def _(spark, folder):
    return frames.video_embeddings(domain.frames(spark, folder)).select("video", "n_kept", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query("poc_frame_name_parse", """SELECT file_path, regexp_extract(name, p, 1) AS source, coalesce(try_cast(regexp_extract(name, p, 3) AS DOUBLE), -1) AS timestamp_sec FROM (
  SELECT *, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS name, '^(.*)_f(\\d+)_(-?\\d+(?:\\.\\d+)?)s$' AS p FROM (
    SELECT CASE WHEN frame_index % 2 = 0 THEN '/frames/' || file_hash[1:8] || '_f' || frame_index || '_' || frame_index * 30 || 's.jpg' ELSE file_path END AS file_path FROM cur WHERE media_type = 'video_frame'))""")
def _(spark, folder):
    rows = domain.media(spark, folder, "media_type", "frame_index", "file_path", "file_hash").where("media_type = 'video_frame'")
    made = F.concat(F.lit("/frames/"), F.substring("file_hash", 1, 8), F.lit("_f"), F.col("frame_index").cast("string"), F.lit("_"), (F.col("frame_index") * 30).cast("string"), F.lit("s.jpg"))
    return frames.parse_frame_name(rows.select(F.when(F.col("frame_index") % 2 == 0, made).otherwise(F.col("file_path")).alias("file_path"))).drop("name")


def _meta_kind(spark, folder):
    kinds = domain.media(spark, folder, "media_type", "file_hash", "updated_at").where("media_type <> 'video_frame'")
    best = kinds.groupBy(folded("file_hash").alias("file_hash")).agg(F.max(F.struct("updated_at", "id", "media_type"))["media_type"].alias("media_type"))
    return domain.metadata(spark, folder).join(best, "file_hash")


@query("metadata_ffprobe", """SELECT file_hash, width, height, codec, round(CASE WHEN width % 3 = 0 THEN NULL WHEN width % 3 = 1 THEN 24.0 ELSE 30000.0 / 1001 END, 4) AS fps, CAST(floor(CAST(duration_ms AS DOUBLE) / 1000 * 1000) AS BIGINT) AS duration_ms, bitrate_kbps FROM meta WHERE media_type = 'video'
  UNION ALL SELECT file_hash, NULL, NULL, NULL, NULL, NULL, NULL FROM meta WHERE media_type = 'image'""")
def _(spark, folder):
    """Every video, whatever its duration; a null field isn't in its JSON at all."""
    m = _meta_kind(spark, folder)
    rate = F.when(F.col("width") % 3 == 0, "0/0").when(F.col("width") % 3 == 1, "24").otherwise("30000/1001")
    duration = F.format_string("%d.%03d", F.floor(F.col("duration_ms") / 1000), F.pmod("duration_ms", F.lit(1000)))
    audio, video = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name")), F.struct(F.lit("video").alias("codec_type"), F.col("codec").alias("codec_name"), "width", "height", F.array(F.lit(1)).alias("extra"), rate.alias("r_frame_rate"))
    form = F.struct(F.when(F.col("duration_ms").isNotNull(), duration).alias("duration"), F.concat(F.col("bitrate_kbps").cast("string"), F.lit("999")).alias("bit_rate"))
    json = F.concat(F.lit('{"streams":['), F.to_json(audio), F.lit(","), F.to_json(video), F.lit('],"format":'), F.to_json(form), F.lit("}"))
    rows = m.select("file_hash", F.when(F.col("media_type") == "video", json).when(F.col("media_type") == "image", '{"streams":[],"format":{}}').alias("json")).where("json is not null")
    return rows.select("file_hash", rules.probe_fields(F.col("json")).alias("p")).select("file_hash", "p.width", "p.height", "p.codec", _r(F.col("p.fps").cast("double"), 4).alias("fps"), "p.duration_ms", "p.bitrate_kbps")


_EXIF = ("camera_make", "camera_model", "date_taken", "gps_lat", "gps_lon", "focal_length_mm", "iso", "orientation")
_THERE = "coalesce(exif_camera_make, exif_camera_model, exif_date_taken, CAST(exif_gps_lat AS VARCHAR)) IS NOT NULL"


@query("metadata_exif_struct", f"SELECT file_hash, {_THERE} AS has_exif, " + ", ".join(f"CASE WHEN {_THERE} THEN exif_{c} END AS {c}" for c in _EXIF) + " FROM meta")
def _(spark, folder):
    rows = catalog.exif_struct(domain.metadata(spark, folder))
    return rows.select("file_hash", F.col("exif").isNotNull().alias("has_exif"), *(F.col(f"exif.{c}").alias(c) for c in _EXIF))


@query("metadata_upsert", "SELECT file_hash, CASE WHEN width > 2000 THEN 1 ELSE width END AS width FROM meta UNION ALL SELECT 'x' || file_hash, 1 FROM meta WHERE width > 2000")
def _(spark, folder):
    base = domain.metadata(spark, folder).select("file_hash", "width")
    wide = base.where("width > 2000").withColumn("width", F.lit(1))
    return catalog.upsert(base, wide.unionByName(wide.withColumn("file_hash", F.concat(F.lit("x"), "file_hash"))), "file_hash")


_META = ("width", "height", "duration_ms", "fps", "codec", "bitrate_kbps", *(f"exif_{c}" for c in _EXIF))


@query("catalog_with_metadata", "SELECT c.id, " + ", ".join(f"coalesce(c.{c}, m.{c}) AS {c}" for c in _META) + f" FROM (SELECT *, lower(trim(file_hash, {SPACE_SQL})) AS h FROM cur) c LEFT JOIN meta m ON m.file_hash = c.h")
def _(spark, folder):
    rows = domain.media(spark, folder, "file_hash", *_META).select("id", folded("file_hash").alias("file_hash"), *_META)
    return catalog.with_metadata(rows, domain.metadata(spark, folder)).select("id", *_META)


@query("gps_decimal", """SELECT file_hash, round(CASE WHEN lat < 0 THEN -1 ELSE 1 END * (d + m / 60.0::DOUBLE + ((x - d) * 60 - m) * 60 / 3600.0::DOUBLE), 8) AS lat FROM (
  SELECT *, floor((x - d) * 60) AS m FROM (SELECT file_hash, exif_gps_lat AS lat, abs(exif_gps_lat) AS x, floor(abs(exif_gps_lat)) AS d FROM meta WHERE exif_gps_lat BETWEEN -90 AND 90))""")
def _(spark, folder):
    x = F.abs("exif_gps_lat")
    degrees = F.floor(x)
    minutes = F.floor((x - degrees) * 60)
    seconds = ((x - degrees) * 60 - minutes) * 60
    value = rules.gps_decimal(degrees, minutes, seconds, F.when(F.col("exif_gps_lat") < 0, "S").otherwise("N"))
    return domain.metadata(spark, folder).where("exif_gps_lat between -90 and 90").select("file_hash", _r(value, 8).alias("lat"))


_FIT_SQL = "CASE WHEN w <= 300 AND h <= 300 THEN {same} WHEN w >= h THEN {wide} ELSE {tall} END"


@query("fit_dimensions", f"""SELECT file_hash, {_FIT_SQL.format(same="w", wide="300", tall="greatest(1, CAST(floor(w * 300 / h + 0.5) AS INT))")} AS width, {_FIT_SQL.format(same="h", wide="greatest(1, CAST(floor(h * 300 / w + 0.5) AS INT))", tall="300")} AS height
  FROM (SELECT file_hash, width AS w, height AS h FROM meta WHERE width IS NOT NULL AND height IS NOT NULL)""")
def _(spark, folder):
    rows = domain.metadata(spark, folder).where("width is not null and height is not null")
    return rows.select("file_hash", rules.fit_dimensions(F.col("width"), F.col("height"), 300).alias("d")).select("file_hash", "d.width", "d.height")


@query("clip_resize_dims", """SELECT file_hash, width, height, CAST(floor((width - 224) / 2) AS INT) AS x, CAST(floor((height - 224) / 2) AS INT) AS y FROM (SELECT file_hash, CASE WHEN w < h THEN 224 ELSE CAST(floor(w * 224 / h + 0.5) AS INT) END AS width, CASE WHEN w < h THEN CAST(floor(h * 224 / w + 0.5) AS INT) ELSE 224 END AS height
  FROM (SELECT file_hash, width AS w, height AS h FROM meta WHERE width > 0 AND height > 0))""")
def _(spark, folder):
    rows = domain.metadata(spark, folder).where("width > 0 and height > 0")
    return rows.select("file_hash", rules.crop_geometry(F.col("width"), F.col("height")).alias("d")).select("file_hash", "d.*")


@query("token_pad", "SELECT doc_id, 77 AS n, CASE WHEN m > 77 THEN 49407 WHEN m = 77 THEN 77 ELSE 0 END AS last, CAST(CASE WHEN m > 77 THEN 76 * 77 / 2 + 49407 ELSE m * (m + 1) / 2 END AS BIGINT) AS total FROM (SELECT doc_id, n_cells * 7 AS m FROM documents)")
def _(spark, folder):
    d = read_table(spark, folder, "documents").select("doc_id", F.when(F.col("n_cells") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_cells").cast("long") * 7)).otherwise(F.array().cast("array<long>")).alias("ids"))
    p = d.select("doc_id", rules.padded_tokens(F.col("ids")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.element_at("p", -1).alias("last"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_CONFIG = transcode.TranscodeConfig(enabled=True, max_resolution="1080p", target_codec="h265")
_FAMILY_SQL = "CASE WHEN codec IS NULL THEN 'unknown' " + " ".join(f"WHEN lower(codec) IN {_listed(names)} THEN '{family}'" for family, names in transcode.CODECS.items()) + " ELSE 'other' END"
_PLAN_SQL = f"""SELECT file_path, CASE WHEN reason IS NULL THEN 'transcode' ELSE 'skip' END AS decision, reason, CASE WHEN reason IS NULL THEN tw END AS target_w, CASE WHEN reason IS NULL THEN th END AS target_h,
    CASE WHEN reason IS NULL THEN coalesce(CAST(floor(bitrate_kbps::BIGINT * 1000 / 8) AS BIGINT) * 60, CAST(floor(w * h * bpp * 30.0 * 60.0 / 8.0) AS BIGINT)) - CAST(floor(tw * th * 0.07::DOUBLE * 30.0 * 60.0 / 8.0) AS BIGINT) END AS savings
  FROM (SELECT *, CASE WHEN w IS NULL OR h IS NULL THEN 'width or height unknown' WHEN h <= 1080 AND family = 'h265' THEN family || ' at ' || w || 'x' || h || ' needs no change' END AS reason,
    CASE WHEN h > 1080 THEN CAST(floor(w * (1080.0::DOUBLE / h)) AS BIGINT) // 2 * 2 ELSE w END AS tw, least(h, 1080) AS th, CAST(CASE family WHEN 'h265' THEN 0.07 WHEN 'h264' THEN 0.12 WHEN 'av1' THEN 0.06 ELSE 0.15 END AS DOUBLE) AS bpp
  FROM (SELECT f.file_path, width::BIGINT AS w, height::BIGINT AS h, bitrate_kbps, {_FAMILY_SQL} AS family FROM (SELECT * FROM f0 WHERE status = 'active' AND {_KIND} = 'video') f JOIN meta m ON m.file_hash = f.file_hash))"""


@query("transcode_dry_run", _PLAN_SQL)
def _(spark, folder):
    return transcode.dry_run(domain.files(spark, folder), domain.metadata(spark, folder), _CONFIG)


@query("transcode_summary", f"SELECT count(*) AS videos, count(*) FILTER (decision = 'transcode') AS transcode, count(*) FILTER (decision = 'skip') AS skip, coalesce(sum(savings), 0)::BIGINT AS savings FROM ({_PLAN_SQL})")
def _(spark, folder):
    return transcode.summary(transcode.dry_run(domain.files(spark, folder), domain.metadata(spark, folder), _CONFIG))


@query("transcode_verify", """SELECT id, issues = '' AS passed, issues FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 13 = 0 OR p_partkey % 7 = 0 THEN 'empty' ELSE
  concat_ws(',', CASE WHEN p_partkey % 7 * 1000 >= p_size * 100 THEN 'not smaller' END, CASE WHEN p_partkey % 5 <> 0 AND abs(p_size - p_size - (p_partkey % 4) * 0.25) > 0.5 THEN 'duration' END, CASE WHEN p_partkey % 3 <> 1 THEN 'audio streams' END) END AS issues FROM part)""")
def _(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    pairs = read_table(spark, folder, "part").select(
        key.alias("id"), (size * 100).alias("original_bytes"), F.when(key % 11 == 0, None).when(key % 13 == 0, 0).otherwise(key % 7 * 1000).alias("output_bytes"),
        size.cast("double").alias("original_sec"), F.when(key % 5 != 0, size + (key % 4) * 0.25).alias("output_sec"), F.lit(1).cast("long").alias("original_audio"), (key % 3).alias("output_audio"),
    )
    return transcode.verify(pairs)


@query("ann_ivf")
def _(spark, folder):
    rows = domain.vectors(spark, folder).select("id", "embedding")
    centres = fit_centroids(rows)
    return ivf_search(ivf_assign(rows, centres), centres, _vector(spark, folder), 20)


@query("ann_ivf_join")
def _(spark, folder):
    """The 20 nearest of every hundredth vector, through the index; the tests measure recall against ``knn``."""
    rows = read_table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    centres = fit_centroids(rows)
    return ivf_join(rows.where("cast(id as long) % 100 = 0"), ivf_assign(rows, centres), centres, 20)
