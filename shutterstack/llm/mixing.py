"""Mixing sources to target token shares, with capped repetition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.functions.text import folded
from shutterstack.llm.tokens import TOKENIZER, encoding, token_sizes
from shutterstack.session import broadcast_if_small, checkpointed, ship_package

#: Tokens of a block, blocks of an output shard, shards drawn by one task, documents cut into blocks by one task, and the most sources.
BLOCK, SHARD, DRAWN, BUCKET, MOST_SOURCES = 512, 256, 1024, 8192, 10_000

_PIECE = "source string, bucket int, block long, piece int, doc_id long, first_token long, n_tokens long"


def permuted(position: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, evaluated at some positions: a four-round Feistel network, walked until it falls below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(position.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def drawn_counts(group: int, shards: int, slots: int, shares: np.ndarray, seed: int) -> np.ndarray:
    """Source counts of the ``shards`` output shards of one group, each with ``slots`` slots.

    Every shard gets the whole part of each source's expectation; the slots that remain are a multinomial
    draw over the fractional parts, so the expectation is exact and the variance small.
    """
    whole = np.floor(shares * slots + 1e-9).astype(np.int64)
    rest, part = slots - int(whole.sum()), np.maximum(shares * slots - whole, 0)
    if rest <= 0 or part.sum() <= 0:
        return np.tile(whole, (shards, 1))
    return whole + np.random.default_rng([seed, group, slots]).multinomial(rest, part / part.sum(), size=shards)


def _cut(frame: pd.DataFrame, block: int) -> pd.DataFrame:
    """Cut a bucket's stream of pieces, in a pseudorandom order of documents, into blocks; the tail that fills none has block -1."""
    frame = frame.iloc[np.lexsort((frame["first_token"], frame["doc_id"], pd.util.hash_array(frame["doc_id"].to_numpy(np.int64))))]
    length = frame["n_tokens"].to_numpy(np.int64)
    start = np.cumsum(length) - length
    total = int(length.sum())
    cuts = np.unique(np.concatenate([start, np.arange(0, total, block)]))
    item = np.searchsorted(start, cuts, side="right") - 1
    number = cuts // block
    out = pd.DataFrame({"source": frame["source"].iat[0], "bucket": int(frame["bucket"].iat[0]), "block": np.where(number < total // block, number, -1)})
    out["piece"] = (np.arange(len(cuts)) - np.searchsorted(number, number, side="left")).astype(np.int32)
    out["doc_id"] = frame["doc_id"].to_numpy(np.int64)[item]
    out["first_token"] = frame["first_token"].to_numpy(np.int64)[item] + cuts - start[item]
    out["n_tokens"] = np.diff(np.append(cuts, total))
    return out


@dataclass
class Source:
    """A source as it is used: its share among the sources that have blocks, its cap and its number of blocks."""

    name: str
    share: float
    repeats: int
    blocks: int


def plan_slots(sources: list[Source]) -> int:
    """The most slots with which every source can have its share within its cap."""
    return int(min((s.repeats * s.blocks / s.share for s in sources), default=0) + 1e-9)


def group_counts(group: int, before: np.ndarray, sources: list[Source], total: int, shard: int, seed: int) -> np.ndarray:
    """Source counts of the output shards of one group, a row each, after ``before`` draws of every source; none passes its cap.

    Where a source is used up, what the draw wanted of it beyond that is drawn again from those that are left, in proportion, and so are all later shards. The
    slots run short only if no source has anything left.
    """
    shares, room = np.array([s.share for s in sources]), np.array([s.repeats * s.blocks for s in sources]) - before
    whole, rest = divmod(total, shard)
    sizes = [shard] * min(DRAWN, max(0, whole - group * DRAWN)) + ([rest] if rest and group == whole // DRAWN else [])
    done, retry = [], 0
    while sizes and (room > 0).any():
        left = np.where(room > 0, shares, 0.0)
        full = sum(n == sizes[0] for n in sizes)
        counts = drawn_counts(group + (retry << 32), full, sizes[0], left / left.sum(), seed)
        within = (np.cumsum(counts, axis=0) <= room).all(axis=1)
        good = full if within.all() else int(within.argmin())
        done.append(counts[:good])
        room, sizes, retry = room - counts[:good].sum(axis=0), sizes[good:], retry + 1
        if good < full:
            # the shard in which a source runs out
            row, open_slots = np.minimum(counts[good], room), sizes[0]
            while (missing := open_slots - int(row.sum())) and (row < room).any():
                left = np.where(row < room, shares, 0.0)
                row = np.minimum(row + drawn_counts(group + (retry << 32), 1, missing, left / left.sum(), seed)[0], room)
                retry += 1
            done.append(row[None])
            room, sizes = room - row, sizes[1:]
    return np.concatenate(done) if done else np.zeros((0, len(sources)), np.int64)


def _slots(batches: Iterator[pd.DataFrame], sources: list[Source], total: int, shard: int, seed: int) -> Iterator[pd.DataFrame]:
    """The slots of groups ``(id, before)``: of each source the next draws, each mapped to a block by the permutation of its repetition, in random places of their shards."""
    names = np.array([s.name for s in sources], dtype=object)
    for batch in batches:
        for group, before in zip(batch["id"].tolist(), batch["before"]):
            before = np.asarray(before, np.int64)
            counts = group_counts(group, before, sources, total, shard, seed)
            parts = []
            for k, s in enumerate(sources):
                nth = before[k] + np.arange(counts[:, k].sum())
                repeat, within = np.divmod(nth, s.blocks)
                # draws of one repetition are consecutive
                cuts = np.append(np.unique(repeat, return_index=True)[1], len(nth))
                blocks = [permuted(within[i:j], s.blocks, seed * 1_000_003 + k * 1009 + int(repeat[i])) for i, j in zip(cuts[:-1], cuts[1:])]
                parts.append((np.repeat(np.arange(len(counts)), counts[:, k]), np.full(len(nth), k), np.concatenate(blocks or [nth]), repeat))
            at, kind, block, repeat = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((np.random.default_rng([seed, group, 1]).random(len(at)), at))
            at = at[order]
            place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            yield pd.DataFrame({"shard_no": group * DRAWN + at, "slot_no": place, "source": names[kind[order]], "block_no": block[order], "repeat_no": repeat[order]})


def blocks_of(sizes: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Rows ``(source, block_no, n_tokens, pieces)`` of all whole blocks of ``sizes(source, doc_id, n_tokens)``, numbered from 0 in each source.

    Documents are dealt by hash to buckets of about ``bucket``, so that a source of any size is cut by many
    tasks. Tails of buckets are cut again together; in the end less than one block is left of each source.
    """
    n = sizes.count()
    buckets, level, parts = max(1, -(-n // bucket)), 0, []
    todo = sizes.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", F.lit(0).cast("long").alias("first_token"), "n_tokens")
    while True:
        pieces = checkpointed(todo.groupBy("source", "bucket").applyInPandas(lambda frame: _cut(frame, block), _PIECE))
        parts.append(pieces.where("block >= 0").withColumn("level", F.lit(level)))
        if buckets == 1:
            break
        buckets, level = max(1, buckets // 64), level + 1
        todo = pieces.where("block < 0").select("source", F.pmod(F.col("bucket"), F.lit(buckets)).alias("bucket"), "doc_id", "first_token", "n_tokens")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    made = whole.groupBy("source", "level", "bucket", "block").agg(
        F.sum("n_tokens").alias("n_tokens"), F.transform(F.sort_array(F.collect_list(F.struct("piece", "doc_id", "first_token", "n_tokens"))), lambda p: F.struct(p.doc_id.alias("doc_id"), p.first_token.alias("first_token"), p.n_tokens.alias("n_tokens"))).alias("pieces")
    )
    counts = whole.groupBy("source", "level", "bucket").agg((F.max("block") + 1).alias("n"))
    order = Window.partitionBy("source").orderBy("level", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "level", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    return made.join(broadcast_if_small(offsets), ["source", "level", "bucket"]).select("source", (F.col("block") + F.col("offset")).alias("block_no"), "n_tokens", "pieces")


def mixture(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, block: int = BLOCK, shard: int = SHARD, seed: int = 1, tokens: int | None = None) -> DataFrame:
    """The mixture: rows ``(shard_no, slot_no, source, block_no, repeat_no, n_tokens, pieces)``, a block of ``block`` tokens each.

    ``pieces`` names, in order, the tokens of the block: doc_id, first token and number of tokens
    (``block_tokens`` reads them). Of each source the documents are
    cut into blocks, and no block, so no token of a document, is used more than max_repeats times; ``repeat_no``
    counts from 0. Of every source less than one block is in no block.

    The mixture is as long as every source can keep its share within its cap. With ``tokens`` it has that many, less than a block less:
    a source that is used up before falls behind, the others fill its slots in proportion, and ``mixture_shares`` shows the gap. It is never longer than
    all sources used up. Every slot of every output shard is filled but those of the last shard.

    Sources compare trimmed and in lower case. Documents of a null or unlisted source, without doc_id or
    without tokens take no part; of repeated rows of one doc_id the longest counts. Targets with a null or
    non-positive share or max_repeats are left out, and of a source listed twice the larger share counts. A
    listed source without a whole block can't be delivered: the others keep their proportions, and
    ``mixture_shares`` reports it with 0. With no source left the result is empty.
    """
    spark = documents.sparkSession
    ship_package(spark)
    wanted = _targets(targets)
    sizes = token_sizes(documents.where("doc_id is not null"), "doc_id", "source", path=path).where("n_tokens > 0")
    listed = sizes.select("doc_id", folded("source").alias("source"), "n_tokens").join(broadcast_if_small(wanted.select("source")), "source", "left_semi")
    blocks = checkpointed(blocks_of(checkpointed(listed.groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens"))), block))
    # one row for each listed source
    rows = blocks.groupBy("source").count().join(wanted, "source").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shares = sum(r["target_share"] for r in rows)
    sources = [Source(r["source"], r["target_share"] / shares, r["max_repeats"], r["count"]) for r in rows]
    total = plan_slots(sources) if tokens is None else min(max(0, tokens) // block, sum(r.repeats * r.blocks for r in sources))
    # how many draws of each source come before a group follows from those before it: a small row for each 262,144 slots
    before, starts = np.zeros(len(sources), np.int64), []
    for group in range(-(-total // (shard * DRAWN))):
        starts.append((group, before.tolist()))
        before = before + group_counts(group, before, sources, total, shard, seed).sum(axis=0)
    groups = spark.createDataFrame(starts, "id long, before array<long>").repartition(max(1, len(starts)), "id")
    slots = groups.mapInPandas(lambda batches: _slots(batches, sources, total, shard, seed), "shard_no long, slot_no long, source string, block_no long, repeat_no long")
    # the slots' size can't be told from the group numbers they are made of, so neither side may be broadcast
    return slots.hint("merge").join(blocks, ["source", "block_no"]).select("shard_no", "slot_no", "source", "block_no", "repeat_no", "n_tokens", "pieces")


def _targets(targets: DataFrame) -> DataFrame:
    fine = targets.where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats >= 1")
    best = F.max(F.struct("target_share", "max_repeats"))
    rows = fine.groupBy(folded("source").alias("source")).agg(best.alias("t"))
    return rows.select("source", F.col("t.target_share").cast("double").alias("target_share"), F.col("t.max_repeats").cast("int").alias("max_repeats"))


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: rows ``(source, target_share, max_repeats, tokens, actual_share, share_gap, most_repeats)``, a row for each usable target. The gap is the share reached less the target."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    rows = _targets(targets).join(used, "source", "left").na.fill(0, ["tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    actual = F.coalesce(F.try_divide("tokens", whole), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", "tokens", F.round(actual, 6).alias("actual_share"), F.round(actual - F.col("target_share"), 6).alias("share_gap"), "most_repeats")


def block_tokens(mixed: DataFrame, documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Rows ``(shard_no, slot_no, tokens)``: the token ids of every block of a mixture."""
    ship_package(documents.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.array(encode(t), np.int32) for t in batch["text"]]})

    # of repeated rows the one that the mixture was measured by
    whole = documents.where("doc_id is not null and text <> ''").select("doc_id", "text").mapInPandas(encoded, "doc_id long, ids array<int>")
    ids = whole.groupBy("doc_id").agg(F.max(F.struct(F.size("ids"), "ids"))["ids"].alias("ids"))
    pieces = mixed.select("shard_no", "slot_no", F.posexplode("pieces").alias("at", "p")).select("shard_no", "slot_no", "at", "p.*")
    cut = pieces.join(ids, "doc_id").select("shard_no", "slot_no", "at", F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "part")))
    return cut.groupBy("shard_no", "slot_no").agg(F.flatten(F.transform(ordered, lambda x: x.part)).alias("tokens"))
