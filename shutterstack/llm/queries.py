"""Queries of the training-data problems, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterstack.llm.groups import visual_match_groups
from shutterstack.llm.mixing import block_tokens, mixture, mixture_shares
from shutterstack.llm.neighbours import similar_media
from shutterstack.llm.packing import pack_documents, packing_report
from shutterstack.llm.residue import residue_documents, without_residue
from shutterstack.llm.survivors import surviving_records, survivors
from shutterstack.plans.core import CURRENT_SQL, SPACE_SQL
from shutterstack.session import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(read_table(spark, folder, "duplicate_files"), read_table(spark, folder, "origins"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_records(read_table(spark, folder, "duplicate_files"), read_table(spark, folder, "origins"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_media(read_table(spark, folder, "media"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual_match_groups(read_table(spark, folder, "visual_matches"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "pack_capacities"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p7_containers(spark, folder))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_shares(p8_mixture(spark, folder), read_table(spark, folder, "mix_targets"))


def p8_longer_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mixture with as many tokens as the documents have characters, more than the caps of some sources allow."""
    documents, targets = read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets")
    wanted = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return mixture_shares(mixture(documents, targets, tokens=wanted), targets)


def p8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return block_tokens(p8_mixture(spark, folder), read_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_documents(read_table(spark, folder, "documents"))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    return without_residue(read_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_records, p3_found, p4_found, p7_containers, p7_report, p8_mixture, p8_shares, p8_longer_shares, p8_tokens, p9_found, p9_kept)
}

P2_SQL = f"""
WITH trust AS (SELECT lower(trim(origin)) AS origin, min(trust) AS trust FROM origins GROUP BY 1),
recs AS (
  SELECT DISTINCT record_id, lower(trim(file_hash, {SPACE_SQL})) AS file_hash, trim(path, {SPACE_SQL}) AS path, size, t.trust,
    try_cast(CASE WHEN regexp_matches(modified, '(Z|[+-]\\d\\d:\\d\\d)$') THEN modified END AS TIMESTAMPTZ) AS m, scanned_at
  FROM duplicate_files d LEFT JOIN trust t ON t.origin = lower(trim(d.origin, {SPACE_SQL})) WHERE record_id IS NOT NULL
), r AS (SELECT *, CASE WHEN m <= scanned_at THEN m END AS since FROM recs WHERE file_hash <> ''),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY coalesce(path <> '', false) DESC, trust NULLS LAST, since DESC NULLS LAST, record_id) AS rp,
    row_number() OVER (PARTITION BY file_hash ORDER BY coalesce(size > 0, false) DESC, since DESC NULLS LAST, trust NULLS LAST, record_id) AS rs,
    row_number() OVER (PARTITION BY file_hash ORDER BY since DESC NULLS LAST, trust NULLS LAST, record_id) AS rm FROM r
)
SELECT file_hash, coalesce(max(CASE WHEN rp = 1 AND path <> '' THEN record_id END), 0) AS path_from,
  coalesce(max(CASE WHEN rs = 1 AND size > 0 THEN record_id END), 0) AS size_from, coalesce(max(CASE WHEN rm = 1 AND since IS NOT NULL THEN record_id END), 0) AS modified_from
FROM ranked GROUP BY file_hash HAVING count(DISTINCT record_id) >= 2
"""
P2_RECORDS_SQL = f"""
WITH s AS ({P2_SQL}), v AS (SELECT lower(trim(file_hash, {SPACE_SQL})) AS file_hash, record_id, max(path) AS path, max(size) AS size, max(modified) AS modified FROM duplicate_files GROUP BY 1, 2)
SELECT s.file_hash, p.path, z.size, m.modified FROM s LEFT JOIN v p ON p.file_hash = s.file_hash AND p.record_id = s.path_from
LEFT JOIN v z ON z.file_hash = s.file_hash AND z.record_id = s.size_from LEFT JOIN v m ON m.file_hash = s.file_hash AND m.record_id = s.modified_from
"""
# isnan is tested on its own: a reader that prunes by column statistics may take NaN for a value below the maximum
P4_SQL = f"""
WITH RECURSIVE links AS (
  SELECT lower(trim(id_a, {SPACE_SQL})) AS a, lower(trim(id_b, {SPACE_SQL})) AS b FROM visual_matches WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND similarity BETWEEN CAST(0.92 AS FLOAT) AND 1 AND NOT isnan(similarity)
), e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT id, least(id, min(other)) AS group_id FROM reach GROUP BY id
"""
P3_SQL = f"""
WITH v AS (
  SELECT id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM ({CURRENT_SQL})
  WHERE NOT coalesce(tombstone, false) AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.x, b.x) / (a.norm * b.norm) AS c FROM v a JOIN v b ON a.id <> b.id),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM pairs WHERE c >= 0.88)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best WHERE r <= 5
"""
#: The neighbour search is approximate, so P3_SQL is no oracle; the tests measure recall against it.
SQL: dict[str, str] = {"p2_found": P2_SQL, "p2_records": P2_RECORDS_SQL, "p4_found": P4_SQL}
