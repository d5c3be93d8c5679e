"""Filling fixed-capacity containers by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterstack.llm.tokens import TOKENIZER, token_sizes
from shutterstack.session import checkpointed, ship_package

#: Items that one task packs at a time. More items fill containers better, at most a task's memory bounds them.
SHARD_ITEMS = 4096
#: Most capacities packed for in one call.
MOST_CAPACITIES = 1000

#: Tasks of one level of packing; each packs two shards, or more beyond that.
MOST_TASKS = 20_000
_PLACED = "capacity_id long, capacity_tokens int, bin string, doc_id long, first_token long, n_tokens long"


def fullest(lengths: list[int], room: int) -> list[int]:
    """Of ``lengths`` (descending, with repetition) those that fill ``room`` best: subset sums as the bits of one integer.

    After each length the reachable sums are kept, so the chosen items are read back from the last to the
    first. A sum equal to ``room`` ends the search at once.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    sums, steps, reach = [1], [], 1
    for length in lengths:
        if length > room:
            continue
        wider = reach | (reach << length & mask)
        if wider == reach:
            continue
        reach = wider
        sums.append(reach)
        steps.append(length)
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, []
    for i in range(len(steps) - 1, -1, -1):
        if not total:
            break
        if not sums[i] >> total & 1:
            chosen.append(steps[i])
            total -= steps[i]
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> Iterator[list[int]]:
    """Containers as lists of item numbers, each item of at most ``capacity`` in exactly one.

    Per container the largest item left is taken and the room that remains is filled as full as
    the others allow; that combination is removed. Equal lengths are interchangeable, the lower item number goes first.
    """
    left: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        left.setdefault(int(lengths[i]), []).append(i)
    order = sorted((n for n in left if n), reverse=True)
    while order:
        chosen = [order[0]]
        room = capacity - order[0]
        if room:
            available = []
            for n in order:
                if n <= room:
                    available += [n] * min(len(left[n]) - (n == order[0]), room // n)
            chosen += fullest(available, room)
        yield [left[n].pop() for n in chosen]
        order = [n for n in order if left[n]] if any(not left[n] for n in chosen) else order
    if left.get(0):
        yield left[0]


def _pack(frame: pd.DataFrame, prefix: str) -> pd.DataFrame:
    """Pack the rows of one shard; a row is an item, or a whole container if it is as long as the capacity."""
    frame = frame.sort_values(["doc_id", "first_token"], kind="stable").reset_index(drop=True)
    capacity = int(frame["capacity_tokens"].iat[0])
    bins = np.empty(len(frame), dtype=np.int64)
    for b, items in enumerate(minimum_bin_slack(frame["n_tokens"].to_numpy(), capacity)):
        bins[items] = b
    # documents without tokens take no room: they go where the first container of the shard is
    bins[frame["n_tokens"].to_numpy() == 0] = 0
    frame["bin"] = [f"{prefix}-{frame['shard'].iat[0]}-{b}" for b in bins]
    return frame[[c.split()[0] for c in _PLACED.split(", ")]]


def _packer(prefix: str):
    return lambda frame: _pack(frame, prefix)


def pack(items: DataFrame, capacities: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows ``(capacity_id, capacity_tokens, bin, doc_id, first_token, n_tokens)``: where each item, or piece of one, goes, for every capacity.

    ``items(doc_id, n_tokens)``: an item longer than the capacity is cut into pieces as long as the capacity, which
    are full containers, and a rest; no other item is split. The pieces of an item cover it exactly. Items without tokens
    take no room and go into some container. Rows without doc_id are left out, repeated rows of one id are one item, and if they
    disagree the longest counts. Capacities that are null or below 1 are left out; two capacity_ids of the same size are packed
    alike. An empty table on either side gives an empty result.

    Items are dealt evenly, by hash, to shards of about ``shard_items``; each shard is packed on its own. Containers that
    a shard couldn't fill to 98 % are opened again and packed in wider shards, until what is left fits
    into one shard for each capacity or no longer shrinks.
    """
    spark = items.sparkSession
    ship_package(spark)
    # written down: measuring the items may be most of the work, and they are needed twice
    sizes = checkpointed(items.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").cast("long").alias("n_tokens")))
    usable = capacities.where("capacity_id is not null and capacity_tokens >= 1").select(F.col("capacity_id").cast("long").alias("capacity_id"), F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    asked = usable.limit(MOST_CAPACITIES + 1).collect()
    if len(asked) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    sets = F.array(*(F.struct(F.lit(r[0]).alias("capacity_id"), F.lit(r[1]).alias("capacity_tokens")) for r in asked))
    each = sizes.select("*", F.inline(sets)) if asked else sizes.join(usable, sizes.doc_id == usable.capacity_id)
    cap = F.col("capacity_tokens")
    whole, rest = F.floor(F.col("n_tokens") / cap), F.col("n_tokens") % cap
    full = each.where(F.col("n_tokens") >= cap).select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("capacity_id", cap, F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin"), "doc_id", (F.col("piece") * cap).alias("first_token"), cap.cast("long").alias("n_tokens"))
    open_items = each.where((rest > 0) | (F.col("n_tokens") == 0)).select("capacity_id", cap, "doc_id", (whole * cap).alias("first_token"), rest.alias("n_tokens"))
    todo, done, level, before = checkpointed(open_items), [full], 0, None
    while n := todo.groupBy("capacity_id").count().agg(F.max("count")).first()[0] or 0:
        shards = max(1, -(-n // shard_items))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(shards)).cast("int"))
        # as many tasks as the shards need: by their few bytes they would all be merged into some
        tasks = min(MOST_TASKS, -(-shards * len(asked) // 2))
        placed = checkpointed(dealt.repartition(tasks, "capacity_id", "shard").groupBy("capacity_id", "shard").applyInPandas(_packer(f"r{level}"), _PLACED))
        if shards == 1 or n == before:
            done.append(placed)
            break
        slack = placed.groupBy("capacity_id", "bin").agg((F.sum("n_tokens") < 0.98 * F.first("capacity_tokens")).alias("_open"))
        marked = placed.join(slack, ["capacity_id", "bin"])
        done.append(marked.where("not _open").select(*placed.columns))
        before, level, todo = n, level + 1, checkpointed(marked.where("_open").drop("_open", "bin"))
    out = done[0].select(*(c.split()[0] for c in _PLACED.split(", ")))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``pack`` of whole documents, sized in tokens; null and empty texts have size 0."""
    return pack(token_sizes(documents, "doc_id", path=path), capacities, shard_items)


def packing_report(placed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, and the share of their room that is used."""
    bins = placed.groupBy("capacity_id", "capacity_tokens", "bin").agg(F.sum("n_tokens").alias("used"))
    return bins.groupBy("capacity_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("fill")
    )
