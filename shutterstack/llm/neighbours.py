"""The most similar vectors for every vector, by beam search on robust-pruned graphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterstack.llm.graph import RobustGraph
from shutterstack.operators.current import live_rows
from shutterstack.session import broadcast_if_small, checkpointed, ship_package

#: Distinct vectors aimed at per shard before replication, the most indexed and the most searched for in one graph, and the most centres of one level.
SHARD, SHARD_MOST, SEARCHED_MOST, CENTRES_MOST = 48_000, 192_000, 768_000, 8192
#: The centres that route vectors to shards are fitted on this many distinct vectors, or ``PER_CENTRE`` for each centre if that is more.
SAMPLE, PER_CENTRE = 20_000, 16
#: A vector is searched for in every shard that has a centre at most a margin less similar than its best, and indexed in those of the ``REPLICAS``
#: nearest of these centres. The margin is ``MARGIN`` for neighbours of cosine 0.5, and shrinks with the chord to the least similar neighbour wanted.
#: Centres within ``MERGED`` of a cosine of 1 to a common one make one shard.
MARGIN, REPLICAS, MERGED = 0.16, 2, 0.08
#: Points kept of every member's search, and points that a search from outside the index keeps.
QUERY_BEAM, OUTER_BEAM = 8, 16
#: Rows of a heavy shard that one task routes.
ROUTED = 65_536

_ROUTED = "shard long, id string, n long, class binary, unit binary, best float, indexed boolean, single boolean"
_FOUND = "id string, n long, single boolean, near array<struct<c double, other string, other_n long>>"


def margin_for(least: float) -> float:
    """How much less similar than a vector's best centre another may be to be searched, for neighbours of cosine ``least`` or more."""
    return MARGIN * float(np.sqrt(2 * (1 - min(0.995, max(0.5, least)))))


def _unit_batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors (float32 bytes) and the digest of their bits, for the rows that have ``dim`` finite numbers, not all zero."""
    for batch in batches:
        vectors = batch.column(1)
        fits = np.nan_to_num(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)) == dim
        kept = batch.filter(pa.array(fits))
        flat = kept.column(1).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(all="ignore"):
            norm = np.sqrt(np.square(x).sum(axis=1))
            u = (x / norm[:, None]).astype(np.float32) + np.float32(0)
        fine = np.isfinite(u).all(axis=1) & (norm > 0)
        units = [row.tobytes() for row in u[fine]]
        digests = [hashlib.blake2b(b, digest_size=16).digest() for b in units]
        yield pa.RecordBatch.from_arrays([kept.column(0).filter(pa.array(fine)), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["id", "class", "unit"])


def _matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float32).reshape(-1, dim)


def fit_centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on a sample whose order is random; a centre without members stays where it is."""
    centres = sample[:n].copy()
    for _ in range(rounds):
        label = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(label, kind="stable")
        present, start = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(sample[order], start, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[present] = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres[present])
    return centres


def merged(centres: np.ndarray) -> np.ndarray:
    """The shard of each centre: centres within ``MERGED`` of a common one, the one with the most such neighbours first, make one shard."""
    near = np.concatenate([(centres[i : i + 1024] @ centres.T >= 1 - MERGED).sum(axis=1) for i in range(0, len(centres), 1024)])
    shard, n = np.full(len(centres), -1), 0
    for i in np.argsort(-near, kind="stable"):
        if shard[i] < 0:
            shard[(shard < 0) & (centres @ centres[i] >= 1 - MERGED)] = n
            shard[i] = n
            n += 1
    return shard


def places_of(x: np.ndarray, centres: np.ndarray, merge: np.ndarray, margin: float, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (row, shard, indexed, similarity of the best centre): every shard a vector is searched for in, and whether it is indexed there too.

    ``best`` is what its best centre of the level above gave; a vector whose best centre is elsewhere may need no shard here.
    """
    found, take, n = [], min(REPLICAS, len(centres)), int(merge.max()) + 1
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ centres.T
        top = s.max(axis=1) if best is None else np.maximum(s.max(axis=1), best[i : i + 4096])
        row, centre = np.nonzero(s >= top[:, None] - margin)
        searched = np.unique(row * n + merge[centre])
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        row, slot = np.nonzero(np.take_along_axis(s, near, 1) >= top[:, None] - margin)
        found.append((searched // n + i, searched % n, np.isin(searched, row * n + merge[near[row, slot]]), top[searched // n].astype(np.float32)))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0, bool), np.empty(0, np.float32))


def shards_of(x: np.ndarray, centres: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, shard): the shards a vector is searched for in."""
    return places_of(x, centres, merged(centres), margin)[:2]


def _routed(batches: Iterator[pa.RecordBatch], centres: np.ndarray, merge: np.ndarray, margin: float, dim: int) -> Iterator[pa.RecordBatch]:
    """Every vector once for each shard it is searched for in; ``single`` if that is one."""
    for batch in batches:
        row, shard, indexed, best = places_of(_matrix(batch.column("unit").to_pylist(), dim), centres, merge, margin)
        of = pa.array(row)
        single = np.bincount(row, minlength=batch.num_rows)[row] == 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int64()), *(batch.column(c).take(of) for c in ("id", "n", "class", "unit")), pa.array(best), pa.array(indexed), pa.array(single)], names=["shard", "id", "n", "class", "unit", "best", "indexed", "single"]
        )


def _sizes(routed: DataFrame) -> dict[int, tuple[int, int]]:
    """Indexed and searched vectors of each shard: a small row for each ``SHARD`` vectors or so."""
    rows = routed.groupBy("shard").agg(F.count_if("indexed").alias("indexed"), F.count("*").alias("searched"))
    return {r["shard"]: (r["indexed"], r["searched"]) for r in rows.toLocalIterator()}


def _split(heavy: DataFrame, sizes: dict[int, tuple[int, int]], margin: float, dim: int) -> tuple[DataFrame, set[int]]:
    """Rows of heavy shards routed to shards of their own, and the heavy shards that have no structure to split them by.

    Each heavy shard fits its own centres, one for ``SHARD`` members, on a sample of bounded size, in a task of its own; then its
    rows, salted, meet the centres. What had a better centre in another shard is searched for only in the new shards within the margin of that.
    """
    spark = heavy.sparkSession
    wanted = {g: min(CENTRES_MOST, -(-m // SHARD)) for g, (m, _) in sizes.items()}
    table = [(g, min(1.0, max(1024, 2 * PER_CENTRE * wanted[g]) / m), -(-n // ROUTED)) for g, (m, n) in sizes.items()]
    held = broadcast_if_small(spark.createDataFrame(table, "shard long, share double, salts long"))
    rows = heavy.join(held, "shard")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class", kind="stable")
        shard = int(frame["shard"].iat[0])
        centres = fit_centres(_matrix(frame["unit"], dim), wanted[shard])
        return pd.DataFrame({"shard": [shard], "centres": [centres.tobytes()], "merge": [merged(centres).tolist()]})

    drawn_rows = rows.where(F.col("indexed") & (F.xxhash64("class", F.lit(3)) <= (F.col("share") * 2.0**64 - 2.0**63)))
    fitted = checkpointed(drawn_rows.select("shard", "class", "unit").groupBy("shard").applyInPandas(fit, "shard long, centres binary, merge array<long>"))
    split = fitted.where(F.array_max("merge") > 0)
    dense = set(wanted) - {r["shard"] for r in split.select("shard").toLocalIterator()}

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0].drop(columns="salt")
        row, shard, indexed, best = places_of(_matrix(left["unit"], dim), _matrix(right["centres"], dim), np.asarray(right["merge"].iat[0]), margin, left["best"].to_numpy(np.float32))
        out = left.iloc[row].drop(columns="salt")
        # shards are numbered below the one they come from; 16,384 is above the number of centres
        single = out["single"].to_numpy() & (np.bincount(row, minlength=len(left))[row] == 1)
        return out.assign(shard=(out["shard"] + 1) * 16_384 + shard, best=best, indexed=out["indexed"].to_numpy() & indexed, single=single)

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class", F.lit(4)), F.col("salts"))).select("shard", "salt", "id", "n", "class", "unit", "best", "indexed", "single")
    asked = split.join(held, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "centres", "merge")
    return checkpointed(salted.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInPandas(route, _ROUTED)), dense


def _graphs(routed: DataFrame, sizes: dict[int, tuple[int, int]]) -> tuple[DataFrame, int]:
    """``routed`` with ``slot``, the number of the graph a row goes to, largest first, and the number of graphs.

    A shard that could not be split by its structure has parts: each member is indexed in one and searched for in all. A part that is asked
    too much has slices, each with all that the part indexes and a share of its queries.
    """
    table, slots = [], 0
    for shard, (indexed, searched) in sorted(sizes.items(), key=lambda s: (-s[1][0], s[0])):
        parts, slices = max(1, -(-indexed // SHARD_MOST)), max(1, -(-searched // SEARCHED_MOST))
        table.append((shard, slots, parts, slices))
        slots += parts * slices
    held = broadcast_if_small(routed.sparkSession.createDataFrame(table, "shard long, slot long, parts long, slices long"))
    digest = F.xxhash64("class", F.lit(5))
    own, home = F.pmod(digest, F.col("parts")), F.pmod(F.shiftright(digest, 20), F.col("slices"))
    rows = routed.join(held, "shard").withColumns({"own": own, "home": home})
    whole = F.struct(F.col("own").alias("part"), F.col("home").alias("slice"), F.col("indexed").alias("kept"))
    asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.col("home").alias("slice"), (F.col("indexed") & (p == F.col("own"))).alias("kept")))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda s: F.struct(F.col("own").alias("part"), s.alias("slice"), F.lit(True).alias("kept")))
    places = F.when((F.col("parts") == 1) & (F.col("slices") == 1), F.array(whole)).otherwise(F.when(F.col("indexed"), F.array_distinct(F.concat(asked, again))).otherwise(asked))
    single = F.col("single") & (F.col("parts") == 1) & (F.col("slices") == 1)
    placed = rows.select("id", "n", "unit", single.alias("single"), "slot", "slices", F.explode(places).alias("p"))
    return placed.select((F.col("slot") + F.col("p.part") * F.col("slices") + F.col("p.slice")).cast("int").alias("slot"), "id", "n", "unit", "single", F.col("p.kept").alias("indexed")), slots


def search_shard(x: np.ndarray, indexed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Build the graph over the indexed rows and search it for every row: batches of (query row, found row, distance), k others at most.

    A member was searched for when it entered the graph, and has been told since of later ones that found it; its beam search goes on from those, so it is
    short. What the nearest points found have found themselves is measured too: a point that one search missed is
    seldom missed by all its neighbours' searches.
    """
    base = np.nonzero(indexed)[0]
    if not len(base):
        return
    graph = RobustGraph(x[base])
    beam = max(QUERY_BEAM, k + 1)
    found = np.full((len(base), beam), -1, np.int32)
    for i in range(0, len(base), 1024):
        own = np.arange(i, min(i + 1024, len(base)), dtype=np.int32)
        found[own] = graph.search(graph.x[own], beam, own=own)[0]
    place = np.full(len(x), -1, np.int32)
    place[base] = np.arange(len(base))
    for rows in (base, np.nonzero(~indexed)[0]):
        for i in range(0, len(rows), 1024):
            q = rows[i : i + 1024]
            own = place[q]
            ids = found[own] if own[0] >= 0 else graph.search(x[q], max(OUTER_BEAM, k))[0]
            ids, dist = nearest_of(graph.x, x[q], np.concatenate([ids, found[ids[:, : k + 1]].reshape(len(q), -1)], axis=1), own, k)
            row, slot = np.nonzero(np.isfinite(dist))
            yield q[row], base[ids[row, slot]], dist[row, slot]


def nearest_of(x: np.ndarray, queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row of candidates, which may repeat; -1 and a query's own point don't count."""
    c = np.sort(candidates, axis=1)
    keep = (c >= 0) & (c != own[:, None])
    keep[:, 1:] &= c[:, 1:] != c[:, :-1]
    row, slot = np.nonzero(keep)
    d = np.full(c.shape, np.inf, np.float32)
    d[row, slot] = 1 - np.einsum("kd,kd->k", x[c[row, slot]], queries[row])
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)


def similar_classes(vectors: DataFrame, rows: int, dim: int, k: int, least: float) -> DataFrame:
    """Rows ``(id, n, near)``: for each of the distinct ``vectors(id, n, class, unit)`` that has any its up to ``k`` most similar others found, of at least ``least``.

    ``near`` is an array of (negative cosine, other, other_n) in order. What was searched for in one shard is complete there; only the lists of the others are shuffled together.
    """
    spark, margin = vectors.sparkSession, margin_for(least)
    shards = min(CENTRES_MOST, max(1, -(-rows // SHARD)))
    # about as many rows as wanted, in the order of their hashes
    few = vectors.select("unit", F.xxhash64("unit").alias("by")).where(F.col("by") <= min(2**63 - 1, int(2.0**64 * max(SAMPLE, PER_CENTRE * shards) / max(1, rows) - 2.0**63)))
    sample = _matrix([r[1] for r in sorted((r["by"], bytes(r["unit"])) for r in few.toLocalIterator())], dim)
    centres = fit_centres(sample, shards) if len(sample) else np.zeros((1, dim), np.float32)
    held = spark.sparkContext.broadcast((centres, merged(centres)))
    routed = vectors.select("id", "n", "class", "unit").mapInArrow(lambda batches: _routed(batches, *held.value, margin, dim), _ROUTED)
    sizes = _sizes(routed)
    heavy = {g: s for g, s in sizes.items() if s[0] > SHARD_MOST}
    while heavy:
        few = broadcast_if_small(spark.createDataFrame([(g,) for g in heavy], "shard long"))
        moved, dense = _split(routed.join(few, "shard", "left_semi"), heavy, margin, dim)
        split = set(heavy) - dense
        gone = broadcast_if_small(spark.createDataFrame([(g,) for g in split], "shard long"))
        routed, inner = routed.join(gone, "shard", "left_anti").unionByName(moved), _sizes(moved)
        sizes = {g: s for g, s in sizes.items() if g not in split} | inner
        heavy = {g: s for g, s in inner.items() if s[0] > SHARD_MOST}

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _matrix(table["unit"].to_pylist(), dim)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, p, d in search_shard(x, table["indexed"].to_numpy(), k):
            near = d <= 1 - least + 1e-4
            q, p = q[near], p[near]
            # the same pair found in two shards has to compare equal
            cosine = np.round(np.einsum("kd,kd->k", x[q].astype(np.float64), x[p].astype(np.float64)), 12)
            found.append(tuple(a[cosine >= least] for a in (q, p, cosine)))
        q, p, cosine = (np.concatenate(a) for a in zip(*found))
        order = np.lexsort((p, -cosine, q))
        q, p, cosine = q[order], p[order], cosine[order]
        rows, start = np.unique(q, return_index=True)
        near = pa.StructArray.from_arrays([pa.array(-cosine), *(table[c].take(pa.array(p)).combine_chunks() for c in ("id", "n"))], names=["c", "other", "other_n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)), pa.int32()), near)
        return pa.table([*(table[c].take(pa.array(rows)) for c in ("id", "n", "single")), lists], names=["id", "n", "single", "near"])

    placed, slots = _graphs(routed, sizes)
    found = checkpointed(placed.repartitionById(max(1, slots), "slot").groupBy("slot").applyInArrow(search, _FOUND))
    several = found.where("not single").groupBy("id", "n").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return found.where("single").select("id", "n", "near").unionByName(several)


def most_similar(vectors: DataFrame, k: int = 5, least: float = -1.0, dim: int = 64) -> DataFrame:
    """Rows ``(id, other, cosine)``: for every row of ``vectors(id, embedding)`` the ``k`` other rows with the most similar vectors, of cosine ``least`` or more.

    Rows whose embedding hasn't ``dim`` finite numbers or is all zero, and rows without an id, take no part. Ties go to the smaller
    id. An id should be there once; other columns are never read. Empty tables give an empty result.

    Equal vectors are one node of the index, so copies can't crowd out neighbours and a hot vector can't fill
    a shard: a row's other copies come first, and only ``k`` + 1 members of a vector are ever needed to answer for all. The
    distinct vectors go to the shards of their nearest centres; in each a robust-pruned graph is built, and a
    beam search from every member finds its neighbours. A shard that counts more than ``SHARD_MOST`` members is split by centres of its own, again and
    again; only where its vectors lie so close together that no centres tell them apart is it cut into parts, each
    member indexed in one and searched for in all, which costs its size squared over ``SHARD_MOST``. The centres are fitted on bounded samples,
    but every vector is indexed and searched for. The search is approximate; the cosines are exact.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.where("id is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == dim)
    units = checkpointed(rows.mapInArrow(lambda batches: _unit_batches(batches, dim), "id string, class binary, unit binary"))
    members = units.select("class", "id")
    shared = checkpointed(members.groupBy("class").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    copies = checkpointed(members.join(broadcast_if_small(shared), "class").select("id", "lead", "n"))
    # of equal vectors the row with the smallest id stands in the index for all
    leading = units.join(broadcast_if_small(copies), "id", "left").where("lead is null or id = lead").select("id", F.coalesce("n", F.lit(1)).alias("n"), "class", "unit")
    near = similar_classes(leading, units.count(), dim, k, least)
    plain = (F.col("n") == 1) & F.forall("near", lambda x: x["other_n"] == 1)
    alone = near.where(plain).select("id", F.inline("near")).select("id", "other", (-F.col("c")).alias("cosine"))
    # where copies are involved they have to be counted among the k
    rank = F.row_number().over(Window.partitionBy("lead").orderBy("id"))
    first = copies.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).select("lead", F.col("id").alias("_member"))
    own = copies.join(first, "lead").where("id <> _member").select("id", F.col("_member").alias("other"), F.lit(1.0).alias("cosine"))
    mixed = near.where(~plain)
    few = mixed.where(F.col("n").between(2, k)).join(copies.select(F.col("id").alias("_id"), F.col("lead").alias("id")), "id").select(F.col("_id").alias("id"), "near")
    seekers = mixed.where("n = 1").select("id", "near").unionByName(few).select("id", F.inline("near"))
    apart = seekers.where("other_n = 1").select("id", "other", "c").unionByName(seekers.where("other_n > 1").join(first, F.col("other") == F.col("lead")).select("id", F.col("_member").alias("other"), "c"))
    both = own.unionByName(apart.select("id", "other", (-F.col("c")).alias("cosine"))).withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return alone.unionByName(both.where((F.col("_rank") <= k) & (F.col("cosine") >= least)).drop("_rank"))


def similar_media(media: DataFrame, k: int = 5, least: float = 0.88, dim: int = 64) -> DataFrame:
    """Rows ``(id_a, id_b)``, smaller id first: live media rows of cosine ``least`` or more, one of which is among the ``k`` most similar of the other."""
    found = most_similar(live_rows(media, "embedding"), k, least, dim)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
