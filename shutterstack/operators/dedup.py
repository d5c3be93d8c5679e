"""Duplicates: equal content, similar looks, and videos that share frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.errors import QueryError
from shutterstack.operators.knn import knn_within
from shutterstack.session import checkpointed

THRESHOLD = 0.92
VISUAL_NEIGHBOURS, VIDEO_NEIGHBOURS = 20, 10


def _copies(files: DataFrame) -> DataFrame:
    return files.where("status = 'active' and file_hash is not null").select("file_hash", "file_path", "file_size", "file_modified").distinct()


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Rows ``(file_hash, file_path, n)``: every active file whose content is at ``n`` > 1 paths."""
    rows = _copies(files)
    counts = rows.groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts, "file_hash").select("file_hash", "file_path", "n")


def exact_duplicate_sets(files: DataFrame) -> DataFrame:
    """Rows ``(file_hash, n, first_path, last_path, bytes)``: a row per set, from aggregates that merge, so no set is collected."""
    sets = _copies(files).groupBy("file_hash").agg(F.count("*").alias("n"), F.min("file_path").alias("first_path"), F.max("file_path").alias("last_path"), F.sum("file_size").alias("bytes"))
    return sets.where("n > 1")


def exact_duplicate_summary(files: DataFrame) -> DataFrame:
    """Sets, their files, and the copies beyond the first of each."""
    sets = _copies(files).groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1")
    return sets.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("wasted"))


def visual_edges(media: DataFrame, threshold: float = THRESHOLD, k: int = VISUAL_NEIGHBOURS) -> DataFrame:
    """Rows ``(a, b, similarity)``, a < b: images and videos that look alike.

    Ranked first and filtered then: the ``k`` nearest of a row include itself and frames, which use up ranks. The similarity is
    1 - distance / 2, the larger of both directions.
    """
    vectors = media.select("id", "embedding")
    whole = media.where("media_type <> 'video_frame'").select("id", "embedding")
    # beyond the threshold nothing counts, and nothing there ranks before what does
    near = knn_within(whole, vectors, k, 2 * (1 - threshold) + 1e-9).where("q <> n").withColumn("similarity", 1 - F.col("distance") / 2)
    near = near.where(F.col("similarity") >= threshold).join(whole.select(F.col("id").alias("n")), "n", "left_semi")
    return near.groupBy(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(id, cluster_id)``: the connected components of ``edges(a, b)``, named by their smallest id.

    Alternates two star operations that hang every vertex on the smallest one in reach until nothing changes. Each
    round is written to the checkpoint folder; the driver holds a count and a checksum.
    """
    current, before = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = current.union(current.select("v", "u"))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every vertex also links to its own least neighbour, over its smaller neighbours only
        down = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = down.select("u", F.col("m").alias("v")).union(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        current = checkpointed(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("cluster_id")).union(roots)


def visual_clusters(media: DataFrame, threshold: float = THRESHOLD, k: int = VISUAL_NEIGHBOURS) -> DataFrame:
    """Rows ``(cluster_id, id, similarity)``: connected look-alikes, each with its greatest similarity to another member."""
    edges = checkpointed(visual_edges(media, threshold, k))
    best = edges.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("similarity"))
    return components(edges).join(best, "id").select("cluster_id", "id", "similarity")


def cross_video_pairs(media: DataFrame, threshold: float = THRESHOLD, k: int = VIDEO_NEIGHBOURS) -> DataFrame:
    """Rows ``(video_a, video_b, shared, total_a, total_b, overlap_ratio)``: videos with similar frames.

    Each frame's ``k`` nearest rows are ranked first; then those count that are frames of another video and similar enough. Distinct
    pairs of frames are counted, and the ratio is to the smaller number of frames, so it can exceed 1.
    """
    video = F.coalesce("source_video_path", "file_path")
    frames = media.where("media_type = 'video_frame'").select("id", "embedding", video.alias("video"))
    near = knn_within(frames.select("id", "embedding"), media.select("id", "embedding"), k, 2 * (1 - threshold) + 1e-9).where(1 - F.col("distance") / 2 >= threshold)
    own = frames.select("id", "video")
    pairs = near.join(own.select(F.col("id").alias("q"), F.col("video").alias("va")), "q").join(own.select(F.col("id").alias("n"), F.col("video").alias("vb")), "n").where("va <> vb")
    frame_pairs = pairs.select(F.least("va", "vb").alias("video_a"), F.greatest("va", "vb").alias("video_b"), F.least("q", "n").alias("fa"), F.greatest("q", "n").alias("fb")).distinct()
    shared = frame_pairs.groupBy("video_a", "video_b").agg(F.count("*").alias("shared"))
    totals = frames.groupBy("video").agg(F.count("*").alias("total"))
    rows = shared.join(totals.select(F.col("video").alias("video_a"), F.col("total").alias("total_a")), "video_a").join(totals.select(F.col("video").alias("video_b"), F.col("total").alias("total_b")), "video_b")
    return rows.select("video_a", "video_b", "shared", "total_a", "total_b", (F.col("shared") / F.least("total_a", "total_b")).alias("overlap_ratio"))


def duplicates(tier: str, files: DataFrame, media: DataFrame, threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """The results of a tier: 'exact', 'visual', 'cross-video' or 'all'."""
    tiers = {"exact": lambda: exact_duplicate_sets(files), "visual": lambda: visual_clusters(media, threshold), "cross-video": lambda: cross_video_pairs(media, threshold)}
    if tier != "all" and tier not in tiers:
        raise QueryError(f"no tier {tier}: one of {', '.join(tiers)}, all")
    return {name: run() for name, run in tiers.items() if tier in (name, "all")}


#: By tier: the order of a report's rows, and the totals of its first line.
REPORT = {
    "exact": (("file_hash",), "count(*) || ' sets, ' || sum(n - 1) || ' extra files'"),
    "visual": (("cluster_id", "id"), "count(distinct cluster_id) || ' clusters, ' || count(*) || ' items'"),
    "cross-video": (("video_a", "video_b"), "count(*) || ' pairs'"),
}


def report_lines(tier: str, result: DataFrame) -> Iterator[str]:
    """All rows of a tier's result as lines of text in a fixed order, after their totals; the driver holds one partition at a time."""
    order, totals = REPORT[tier]
    rows = result.orderBy(*order).persist()
    try:
        n, total = rows.agg(F.count("*"), F.expr(totals)).first()
        if not n:
            yield f"No {tier} duplicates found."
            return
        yield f"{tier} duplicates: {total}"
        for r in rows.toLocalIterator():
            if tier == "exact":
                yield f"  {r['file_hash'][:12]}: {r['n']} files, {r['bytes']} bytes, from {r['first_path']} to {r['last_path']}"
            elif tier == "visual":
                yield f"  {r['cluster_id']}: {r['id']} ({r['similarity']:.3f})"
            else:
                yield f"  {r['video_a']} and {r['video_b']}: {r['shared']} frames, {100 * r['overlap_ratio']:.1f} %"
    finally:
        rows.unpersist()


def duplicate_report(tier: str, result: DataFrame) -> str:
    """All of ``report_lines`` as one text."""
    return "".join(line + "\n" for line in report_lines(tier, result))
