"""Exact k nearest neighbours in blocks, and an inverted-file index for collections where exactness costs too much."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shutterstack.functions.vectors import l2sq, literal
from shutterstack.session import drawn, ship_package

#: Vectors of one side of a block pair, and the least and the most of one side where only what lies within a radius counts.
BLOCK, LEAST_BLOCK, MOST_BLOCK = 8192, 2048, 32_768
#: Most lists of an inverted file, and the rows its centroids are fitted on: in all, and for each list.
MOST_LISTS, SAMPLE, PER_LIST = 4096, 20_000, 16


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def block_nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each left vector its ``k`` nearest right ones by squared distance, ties by id."""
    if not len(left) or not len(right):
        return pd.DataFrame({"q": [], "n": [], "distance": []}, dtype=object)
    right = right.sort_values("id", kind="stable")
    x, y = _stack(left["embedding"]), _stack(right["embedding"])
    ids, others = left["id"].to_numpy(object), right["id"].to_numpy(object)
    parts = []
    for i in range(0, len(x), 512):
        a = x[i : i + 512]
        rough = (a * a).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * a @ y.T
        n = min(k, len(y))
        # everything that ties with the k-th within rounding is kept and measured exactly
        limit = np.partition(rough, n - 1, axis=1)[:, n - 1 : n]
        row, col = np.nonzero(rough <= limit + 1e-9 * (1 + np.abs(limit)))
        d = np.square(a[row] - y[col]).sum(1)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < k
        parts.append(pd.DataFrame({"q": ids[i + row[keep]], "n": others[col[keep]], "distance": d[keep]}))
    return pd.concat(parts)


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Rows ``(q, n, rank, distance)``: for every query the ``k`` nearest of ``vectors`` by squared distance, itself included if it is among them.

    Both sides ``(id string, embedding)`` are hashed into blocks and every pair of blocks is one task, so memory is
    bounded whatever the size; a task keeps its best ``k`` and the ranks of a query are settled at the end. Ties
    go to the smaller id. The work is the product of both sizes: for more than some ten million vectors use ``ivf_search``.
    """
    ship_package(queries.sparkSession)
    schema = "q string, n string, distance double"
    sides = []
    for df in (queries, vectors):
        blocks = max(1, -(-df.count() // block))
        sides.append((df.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")), blocks))
    (left, nl), (right, nr) = sides
    left = left.select("id", "embedding", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("nb"))
    right = right.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("qb"), F.col("b").alias("nb"))
    best = left.groupBy("qb", "nb").cogroup(right.groupBy("qb", "nb")).applyInPandas(lambda a, b: block_nearest(a, b, k), schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "n"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "n", "rank", "distance")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    vectors = column.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def block_within(left: pa.Table, right: pa.Table, k: int, reach: float) -> pa.Table:
    """For each left vector its ``k`` nearest right ones of a squared distance of ``reach`` or less, ties by id."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    right = right.sort_by("id")
    if left.num_rows and right.num_rows:
        x, y = _flat(left["embedding"]), _flat(right["embedding"])
        small, own = y.astype(np.float32), (y * y).sum(1)
        for i in range(0, len(x), 256):
            a = x[i : i + 256]
            norm = (a * a).sum(1)
            # single precision with room for its rounding; what passes is measured exactly
            rough = (a.astype(np.float32) @ small.T) * np.float32(-2)
            rough += own.astype(np.float32)[None]
            row, col = np.nonzero(rough <= (reach - norm + 1e-5 * (1 + norm + own.max())).astype(np.float32)[:, None])
            d = np.square(a[row] - y[col]).sum(1)
            near = d <= reach
            row, col, d = row[near], col[near], d[near]
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            found.append((i + row[first], col[first], d[first]))
    q, n, d = (np.concatenate(c) for c in zip(*found))
    return pa.table([left["id"].take(pa.array(q)), right["id"].take(pa.array(n)), pa.array(d)], names=["q", "n", "distance"])


def knn_within(queries: DataFrame, vectors: DataFrame, k: int, reach: float, block: int | None = None) -> DataFrame:
    """Rows ``(q, n, rank, distance)`` of ``knn`` whose squared distance is ``reach`` or less: whatever lies beyond ranks after all of them.

    Exact. A block pair only looks at what may be near enough, and gives at most ``k`` rows for a query, however many copies
    a vector has. All vectors need the same length. Each vector is copied to the blocks of the other side, of up to ``MOST_BLOCK``, so work and copies are
    still the product of both sides: in 64 dimensions no partition by distance is both exact and selective at such radii (cells around 3,000
    pivots with the tightest test, the distance to the bisecting planes, still need half of all vectors each).
    """
    ship_package(queries.sparkSession)
    side = max(1, int(np.ceil(np.sqrt(queries.sparkSession.sparkContext.defaultParallelism))))
    blocked = []
    for df in (queries, vectors):
        n = df.count()
        size = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // side)))
        blocks = max(1, -(-n // size))
        blocked.append((df.where("embedding is not null").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")), blocks))
    (left, nl), (right, nr) = blocked
    left = left.select("id", "embedding", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("nb"))
    right = right.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("qb"), F.col("b").alias("nb"))
    keyed = [df.select((F.col("qb") * nr + F.col("nb")).alias("pair"), "id", "embedding").repartitionById(nl * nr, "pair").groupBy("pair") for df in (left, right)]
    best = keyed[0].cogroup(keyed[1]).applyInArrow(lambda a, b: block_within(a, b, k, reach), "q string, n string, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "n"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "n", "rank", "distance")


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = (centres * centres).sum(1)[None]
    return np.concatenate([(own - 2 * x[i : i + 2048] @ centres.T).argmin(1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


def fit_centroids(vectors: DataFrame, partitions: int | None = None, rounds: int = 8) -> np.ndarray:
    """Centroids of an inverted file; by default the root of the number of rows, ``MOST_LISTS`` at most.

    Fitted on ``SAMPLE`` rows drawn by hash, or ``PER_LIST`` for each centroid if that is more, so the driver holds 65,536 vectors at most.
    """
    n = vectors.count()
    wanted = min(MOST_LISTS, partitions or max(1, int(n**0.5)))
    x = _stack(drawn(vectors.select("id", "embedding"), F.xxhash64("id"), max(SAMPLE, PER_LIST * wanted), n).toPandas()["embedding"])
    centres = x[: min(len(x), wanted)].copy()
    for _ in range(rounds if len(centres) else 0):
        label = _nearest_centre(x, centres)
        order = np.argsort(label, kind="stable")
        present, start = np.unique(label[order], return_index=True)
        centres[present] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None]
    return centres


def probes_for(lists: int) -> int:
    """Lists to search by default: an eighth of them, 32 at least."""
    return max(32, lists // 8)


def ivf_assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with ``centroid_id``, the nearest centroid. Write it partitioned by that column and a probe reads only the lists it names."""
    ship_package(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for batch in batches:
            yield batch.assign(centroid_id=_nearest_centre(_stack(batch["embedding"]), c).astype(np.int32))

    return vectors.mapInPandas(nearest, StructType([*vectors.schema.fields, StructField("centroid_id", IntegerType())])) if len(centres) else vectors.withColumn("centroid_id", F.lit(0))


def nearest_lists(centres: np.ndarray, vector: Sequence[float], probes: int | None = None) -> list[int]:
    return np.argsort(np.square(centres - np.asarray(vector)).sum(1), kind="stable")[: probes or probes_for(len(centres))].tolist()


def ivf_search(index: DataFrame, centres: np.ndarray, vector: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
    """Rows ``(id, distance)`` of the ``k`` nearest in the ``probes`` lists nearest to the query: an ordinary filter on the partition column."""
    rows = index.where(F.col("centroid_id").isin(nearest_lists(centres, vector, probes))).select("id", l2sq(F.col("embedding"), literal(vector)).alias("distance"))
    return rows.orderBy("distance", "id").limit(k)


def ivf_join(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """Rows ``(q, n, rank, distance)``: for every query the ``k`` nearest of ``index`` found in its ``probes`` nearest lists. Distances are exact.

    A query is copied to its lists, the index to nowhere; a list is one group.
    """
    ship_package(queries.sparkSession)
    held, most = queries.sparkSession.sparkContext.broadcast(centres), probes or probes_for(len(centres))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                d = (c * c).sum(1)[None] - 2 * _stack(part["embedding"]) @ c.T
                near = np.argpartition(d, min(most, len(c)) - 1, axis=1)[:, :most]
                out = part.iloc[np.repeat(np.arange(len(part)), near.shape[1])]
                yield out.assign(centroid_id=near.reshape(-1).astype(np.int32))

    if not len(centres):
        return queries.sparkSession.createDataFrame([], "q string, n string, rank int, distance double")
    asked = queries.select("id", "embedding").mapInPandas(spread, "id string, embedding array<float>, centroid_id int")
    best = asked.groupBy("centroid_id").cogroup(index.select("id", "embedding", "centroid_id").groupBy("centroid_id")).applyInPandas(lambda a, b: block_nearest(a, b, k), "q string, n string, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "n"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "n", "rank", "distance")
