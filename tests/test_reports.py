"""Reports of duplicates have every row."""

from shutterstack.operators import dedup


def test_exact_report_of_many_sets(spark):
    sets = spark.range(1500).selectExpr("printf('%012d', 1499 - id) AS file_hash", "3L AS n", "'/a' AS first_path", "'/b' AS last_path", "30L AS bytes").repartition(7)
    lines = dedup.duplicate_report("exact", sets).splitlines()
    assert lines[0] == "exact duplicates: 1500 sets, 3000 extra files"
    assert [line.split(":")[0].strip() for line in lines[1:]] == [f"{i:012d}" for i in range(1500)]


def test_visual_report_keeps_clusters_whole(spark):
    members = spark.range(1200).selectExpr("printf('c%03d', id % 300) AS cluster_id", "printf('%04d', id) AS id", "0.95D AS similarity").repartition(5)
    lines = dedup.duplicate_report("visual", members).splitlines()
    assert lines[0] == "visual duplicates: 300 clusters, 1200 items" and len(lines) == 1201 and lines[1:] == sorted(lines[1:])


def test_video_report(spark):
    pairs = spark.range(1001).selectExpr("printf('%04d', id) AS video_a", "'z' AS video_b", "1L AS shared", "0.5D AS overlap_ratio")
    lines = dedup.duplicate_report("cross-video", pairs).splitlines()
    assert lines[0] == "cross-video duplicates: 1001 pairs" and len(lines) == 1002
