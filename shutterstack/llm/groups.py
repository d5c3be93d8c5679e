"""Connected groups of pairwise matches, by union-find on the blocks of a two-dimensional grid."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.functions.text import folded
from shutterstack.session import broadcast_if_small, checkpointed, ship_package

#: Edges aimed at per grid block; most blocks per side.
BLOCK_EDGES, MOST_BLOCKS = 100_000, 128


def local_representatives(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over some edges: all their vertices, and for each the smallest vertex it is linked to."""
    names, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(names)))
    half = len(left)
    for a, b in zip(codes[:half].tolist(), codes[half:].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    roots = np.array(parent, dtype=np.int64)
    while True:
        up = roots[roots]
        if (up == roots).all():
            return names, names[roots]
        roots = up


def _represent(frame: pd.DataFrame) -> pd.DataFrame:
    vertex, representative = local_representatives(frame["a"].to_numpy(np.int64), frame["b"].to_numpy(np.int64))
    return pd.DataFrame({"vertex": vertex, "representative": representative})


def _placed(edges: DataFrame, n: int, block_edges: int) -> DataFrame:
    """Edges with their grid block: row and column from the hashes of their ends, in either order one block, and a salt.

    A hot vertex makes its row heavy. A block with more than twice ``block_edges`` edges is split by a
    salt; union-find on any part of the edges is right, so no task gets an unbounded block.
    """
    side = max(1, min(MOST_BLOCKS, math.ceil(math.sqrt(2 * n / block_edges))))
    row, column = (F.pmod(c, F.lit(side)).cast("int") for c in ("a", "b"))
    placed = edges.select("a", "b", F.least(row, column).alias("row"), F.greatest(row, column).alias("column"))
    # side * side rows at most, so this side of the join is always small
    parts = placed.groupBy("row", "column").agg(F.ceil(F.count("*") / (2 * block_edges)).cast("int").alias("parts"))
    salted = placed.join(F.broadcast(parts), ["row", "column"])
    return salted.withColumn("salt", F.pmod(F.xxhash64("a", "b", F.lit(7)), F.col("parts")).cast("int"))


#: The bit that labels by hash have cleared, and labels given to colliding ids have set.
_GIVEN = 1


def _labelled(ids: DataFrame, labels: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> tuple[DataFrame, DataFrame]:
    """``ids(id)`` with a label of 64 bits each, no label twice, and the few ids whose label isn't their hash.

    The hash of an id, made even, is its label. Ids with the same one (of n ids about n squared over 2 ** 63) all get odd numbers instead, so
    only those are dealt with, however many ids there are.
    """
    hashed = checkpointed(ids.withColumn("vertex", labels(F.col("id")).bitwiseAND(F.lit(~_GIVEN))))
    again = hashed.groupBy("vertex").agg(F.count("*").alias("n")).where("n > 1").select("vertex")
    odd = checkpointed(hashed.join(again, "vertex", "left_semi").select("id"))
    if odd.isEmpty():
        return hashed, odd.withColumn("given", F.lit(0).cast("long"))
    order = odd.repartition(64, "id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("k"))
    given = checkpointed(order.select("id", (F.col("k") * 2 + _GIVEN).alias("given")))
    settled = hashed.join(broadcast_if_small(given), "id", "left").select("id", F.coalesce("given", "vertex").alias("vertex"))
    return checkpointed(settled), given


def match_groups(edges: DataFrame, block_edges: int = BLOCK_EDGES, labels: Callable[[Column], Column] = lambda c: F.xxhash64(c)) -> DataFrame:
    """Rows ``(id, group_id)`` for every id linked to another by the undirected ``edges(a, b)``; group_id is the smallest id of the group.

    Links with a null end and links of an id with itself join nothing; repeated links and either direction
    are one link. An empty table gives an empty result.

    Ids are hashed to labels (colliding ones get others), whose order is as good as random: along a chain of any order of ids
    about a third of the vertices is smaller than both neighbours, so every round shortens it. A round
    runs union-find locally on every block of the grid, then the row and column blocks of a vertex exchange their representatives: the
    smallest becomes its parent, and the others are linked to that one. Those links are the next round's edges, a
    contraction of the graph. A round without new links ends the loop, and the parents of the rounds are
    composed from the last to the first. Every round is written to the shared checkpoint folder; the driver holds counts only.
    """
    ship_package(edges.sparkSession)
    links = checkpointed(edges.where("a <> b").select("a", "b"))
    ids, given = _labelled(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), labels)
    ended = links.select("a", "b", *(labels(F.col(c)).bitwiseAND(F.lit(~_GIVEN)).alias(f"_{c}") for c in ("a", "b")))
    if not given.isEmpty():
        for c in ("a", "b"):
            few = broadcast_if_small(given.select(F.col("id").alias(c), F.col("given").alias("_given")))
            ended = ended.join(few, c, "left").withColumn(f"_{c}", F.coalesce("_given", f"_{c}")).drop("_given")
    current = checkpointed(ended.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while n := current.count():
        local = _placed(current, n, block_edges).groupBy("row", "column", "salt").applyInPandas(_represent, "vertex long, representative long")
        parent = F.min("representative").over(Window.partitionBy("vertex"))
        exchanged = checkpointed(local.distinct().withColumn("parent", parent))
        rounds.append(exchanged.where("representative = parent").select("vertex", "parent"))
        current = checkpointed(exchanged.where("representative <> parent").select(F.col("parent").alias("a"), F.col("representative").alias("b")).distinct())
    if not rounds:
        return ids.select("id", F.col("id").alias("group_id"))
    roots = rounds[-1].select("vertex", F.col("parent").alias("root"))
    for parents in reversed(rounds[:-1]):
        upper = broadcast_if_small(roots.where("vertex <> root").select(F.col("vertex").alias("parent"), "root"))
        roots = checkpointed(parents.join(upper, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("root")))
    placed = checkpointed(ids.join(roots, "vertex").select("id", "root"))
    named = broadcast_if_small(placed.groupBy("root").agg(F.min("id").alias("group_id")))
    return placed.join(named, "root").select("id", "group_id")


def visual_match_groups(matches: DataFrame, least: float = 0.92, most: float = 1.0, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``match_groups`` of the rows with two ids and a similarity from ``least`` to ``most``.

    Ids compare trimmed and in lower case; an id that is blank is an id like any other. A null or NaN similarity is no link.
    """
    valid = matches.where(F.col("similarity").between(F.lit(least).cast("float"), F.lit(most).cast("float")))
    return match_groups(valid.select(folded("id_a").alias("a"), folded("id_b").alias("b")), block_edges)
