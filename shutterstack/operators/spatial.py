"""Points near other points, and the regions that contain points.

Locations are partitioned into the Voronoi cells of pivots drawn from the data. The triangle inequality
says into which other cells a point (or a region's bounding circle) has to be replicated so that each
cell can be joined on its own; in a cell a vantage-point tree with the exact great-circle metric answers
the radius searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterstack.functions.vptree import VPTree, unit_vectors
from shutterstack.operators.current import live_rows
from shutterstack.session import broadcast_if_small, checkpointed, drawn, ship_package

#: Radius of the sphere, in metres.
EARTH_M = 6371008.8
#: Distinct locations aimed at per cell, the most pivots of one level, and the points and regions beyond which a cell is split by pivots of its own.
CELL, MOST_PIVOTS, CELL_MOST = 4000, 8192, 40_000
#: Points and regions that one task joins, if its cells allow, and rows of a heavy cell that one task places.
TASK, PLACED = 16_000, 65_536
#: Entries of a distance matrix computed at once.
BLOCK = 2_000_000
QUERIES = 4096

_CELL_SCHEMA = "cell long, kind string, key long, lat double, lon double, reach double, ring_lat array<double>, ring_lon array<double>"
_COLUMNS = [c.split()[0] for c in _CELL_SCHEMA.split(", ")]
_FOUND = ["relation", "lat", "lon", "lat_b", "lon_b", "key"]


def locations(points: DataFrame, lat: str = "exif_gps_lat", lon: str = "exif_gps_lon") -> DataFrame:
    """The rows that are locations: both coordinates finite, latitude within +-90, longitude within +-180, not both 0."""
    return points.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0)))


def assign_cells(batches: Iterator[pd.DataFrame], pivots: np.ndarray, slack: float) -> Iterator[pd.DataFrame]:
    """Each point or region with its home cell and the cells it is replicated to.

    A point is needed in the home cell of any partner within ``slack`` / 2, and the home pivot of such a
    partner is at most its own least pivot distance plus ``slack`` away. For the bounding circle of a
    region (``reach``) the same holds with twice its radius. ``kind`` is 'home', 'copy' or 'region'; what is a copy
    already, in a cell that is split again, is at home nowhere.
    """
    step = max(1, BLOCK // max(1, len(pivots)))
    for frame in batches:
        for start in range(0, len(frame), step):
            part = frame.iloc[start : start + step]
            v = unit_vectors(part["lat"], part["lon"])
            d = 2 * np.arcsin(np.minimum(np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0)) / 2, 1))
            home = d.argmin(axis=1)
            reach = part["reach"].to_numpy(np.float64)
            limit = d[np.arange(len(part)), home] + np.where(reach > 0, 2 * reach, slack) + 1e-7
            row, cell = np.nonzero(d <= limit[:, None])
            out = part.iloc[row].copy()
            stays = (cell == home[row]) & (out["kind"] != "copy").to_numpy()
            out["cell"] = cell.astype(np.int64)
            out["kind"] = np.where(reach[row] > 0, "region", np.where(stays, "home", "copy"))
            yield out[_COLUMNS]


def _pieces(n: int) -> Iterator[slice]:
    return (slice(i, i + QUERIES) for i in range(0, n, QUERIES))


def near_in_cell(frame: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Pairs of different locations within ``radius`` radians, smaller coordinates first, each where the first is at home."""
    frame = frame.sort_values(["lat", "lon"], kind="stable")
    lat, lon, home = frame["lat"].to_numpy(), frame["lon"].to_numpy(), np.nonzero((frame["kind"] == "home").to_numpy())[0]
    v = unit_vectors(lat, lon)
    tree, left, right = VPTree(v), [], []
    for piece in _pieces(len(home)):
        q, p = tree.within(v[home[piece]], np.full(len(home[piece]), radius))
        own = home[piece][q]
        keep = own < p
        left.append(own[keep])
        right.append(p[keep])
    a, b = (np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in (left, right))
    return pd.DataFrame({"relation": "near", "lat": lat[a], "lon": lon[a], "lat_b": lat[b], "lon_b": lon[b], "key": 0})


def in_ring(lat: np.ndarray, lon: np.ndarray, ring_lat: np.ndarray, ring_lon: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon whose sides are straight in latitude and longitude (even-odd rule).

    Longitudes are tried a full turn lower and higher too, as a ring may run on past 180. Of the points
    exactly on a side, those on a lower or left one are inside, those on an upper or right one outside.
    """
    a, b = (ring_lat, ring_lon), (np.roll(ring_lat, -1), np.roll(ring_lon, -1))
    inside = np.zeros(len(lat), bool)
    for turn in (-360.0, 0.0, 360.0):
        x = lon + turn
        near = np.nonzero((x >= ring_lon.min()) & (x <= ring_lon.max()) & (lat >= ring_lat.min()) & (lat <= ring_lat.max()))[0]
        odd = np.zeros(len(near), bool)
        y, x = lat[near], x[near]
        for ay, ax, by, bx in zip(*a, *b):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside[near] |= odd
    return inside


def inside_in_cell(frame: pd.DataFrame) -> pd.DataFrame:
    """The locations at home in this cell with the keys of the regions that contain them."""
    points, regions = frame[frame["kind"] == "home"], frame[frame["kind"] == "region"]
    lat, lon = points["lat"].to_numpy(), points["lon"].to_numpy()
    at, key = [], []
    if len(points) and len(regions):
        tree = VPTree(unit_vectors(lat, lon))
        q, p = tree.within(unit_vectors(regions["lat"], regions["lon"]), regions["reach"].to_numpy())
        for i, region in enumerate(regions.itertuples()):
            near = p[q == i]
            hits = near[in_ring(lat[near], lon[near], np.asarray(region.ring_lat, float), np.asarray(region.ring_lon, float))]
            at.append(hits)
            key.append(np.full(len(hits), region.key))
    at, key = (np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in (at, key))
    return pd.DataFrame({"relation": "inside", "lat": lat[at], "lon": lon[at], "lat_b": 0.0, "lon_b": 0.0, "key": key})


def region_circles(regions: DataFrame, key: str = "place_id", ring_lat: str = "ring_lat", ring_lon: str = "ring_lon") -> DataFrame:
    """Regions with a centre and a radius in radians that surely covers them.

    The way along a meridian and then along a parallel is no shorter than the great circle, so half the
    extent in latitude plus half the extent in longitude at its widest parallel is such a radius. Rings
    with fewer than three corners, with missing or infinite coordinates or of unequal lengths are left out.
    """
    lats, lons = F.col(ring_lat), F.col(ring_lon)
    fine = (F.size(lats) == F.size(lons)) & (F.size(lats) >= 3)
    for c in (lats, lons):
        fine = fine & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(1e6)))
    south, north, west, east = F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)
    widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(F.abs(south), F.abs(north)))))
    reach = F.radians((north - south) / 2) + F.radians((east - west) / 2) * widest + 1e-9
    return regions.where(F.col(key).isNotNull() & fine).select(
        F.col(key).cast("long").alias("key"), ((south + north) / 2).alias("lat"), ((west + east) / 2).alias("lon"), reach.alias("reach"), lats.alias("ring_lat"), lons.alias("ring_lon")
    )


def choose_pivots(places: DataFrame, per_cell: int = CELL, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit vectors of pivots: the distinct locations with the smallest hashes, one for each ``per_cell``, ``most`` at most.

    Drawn evenly from distinct locations they follow the density, so a city gets as many cells as its
    share of locations; copies of one location count once. The driver holds at most ``most`` rows; beyond that cells
    grow and are split again.
    """
    total = places.count()
    n = min(most, max(1, -(-total // per_cell)))
    found = drawn(places.select("lat", "lon"), F.xxhash64("lat", "lon"), n, total).toPandas()
    if total and not len(found):  # all but impossible, but without a pivot there is no cell
        found = places.select("lat", "lon").limit(1).toPandas()
    return unit_vectors(found["lat"], found["lon"])


def _cell_sizes(placed: DataFrame) -> dict[int, int]:
    """Points and regions of each cell: a small row for each cell."""
    return {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}


def _split_cells(heavy: DataFrame, sizes: dict[int, int], slack: float, per_cell: int, most: int) -> DataFrame:
    """Rows of heavy cells in smaller cells of their own: each draws its pivots from the locations at home in it, and its rows, salted, meet them."""
    spark = heavy.sparkSession
    # pivots are drawn by hash, so their number is about the one wanted
    table = [(c, min(most, max(2, n // per_cell)) / n, -(-n // PLACED)) for c, n in sizes.items()]
    held = broadcast_if_small(spark.createDataFrame(table, "cell long, share double, salts long"))
    rows = heavy.join(held, "cell")
    chosen = rows.where((F.col("kind") == "home") & (F.xxhash64("lat", "lon", F.lit(1)) <= (F.col("share") * 2.0**64 - 2.0**63)))
    pivots = checkpointed(chosen.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "lat", "lon"))

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["lat", "lon"])
        centres = unit_vectors(right["lat"], right["lon"]) if len(right) else unit_vectors([0.0], [0.0])
        parts = [part.assign(cell=(left["cell"].iat[0] + 1) * 16_384 + part["cell"]) for part in assign_cells(iter([left]), centres, slack)] if len(left) else []
        return pd.concat(parts) if parts else left[_COLUMNS]

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("lat", "lon", F.lit(2)), F.col("salts"))).select("salt", *_COLUMNS)
    return checkpointed(salted.groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt")).applyInPandas(place, _CELL_SCHEMA))


def _cells(placed: DataFrame, slack: float, per_cell: int, most: int, cell_most: int) -> tuple[DataFrame, dict[int, int]]:
    """``placed`` with every heavy cell split, again and again, as long as that makes cells smaller, and the sizes of the cells.

    Where a cell's locations lie within the radius of each other its parts hold them all, and so does its result.
    """
    spark, sizes = placed.sparkSession, _cell_sizes(placed)
    heavy = {c: n for c, n in sizes.items() if n > cell_most}
    while heavy:
        few = broadcast_if_small(spark.createDataFrame([(c,) for c in heavy], "cell long"))
        moved = _split_cells(placed.join(few, "cell", "left_semi"), heavy, slack, per_cell, most)
        inner = _cell_sizes(moved)
        largest: dict[int, int] = {}
        for c, n in inner.items():
            largest[c // 16_384 - 1] = max(n, largest.get(c // 16_384 - 1, 0))
        split = {c for c, n in heavy.items() if largest.get(c, n) < 0.8 * n}
        gone = broadcast_if_small(spark.createDataFrame([(c,) for c in split], "cell long"))
        placed = placed.join(gone, "cell", "left_anti").unionByName(moved.join(gone, F.floor(moved["cell"] / 16_384) - 1 == gone["cell"], "left_semi"))
        inner = {c: n for c, n in inner.items() if c // 16_384 - 1 in split}
        sizes = {c: n for c, n in sizes.items() if c not in split} | inner
        heavy = {c: n for c, n in inner.items() if n > cell_most}
    return placed, sizes


def spatial_join(
    points: DataFrame, regions: DataFrame | None, radius_m: float, key: str = "id", lat: str = "exif_gps_lat", lon: str = "exif_gps_lon", region_key: str = "place_id", per_cell: int = CELL, copies: str = "pairs",
    most: int = MOST_PIVOTS, cell_most: int = CELL_MOST,
) -> DataFrame:
    """Rows ``(relation, left_key, right_key)``: `near` pairs of points, smaller key first, and `inside` pairs (point, region key as text).

    Points that are no location (see ``locations``) or have no key take no part; repeated
    rows of a key at one location count once. A key should have one location; if it has several, a pair is
    given for each pair of locations that is near, and no key is near itself. Equal locations are joined as one, and
    their members come back at the end, so a hot location is never searched for more than once. With ``copies`` 'pairs' they
    come back as all pairs that are near; with 'members' a location is represented by its smallest key, and rows `same` (representative, member) name
    the others, so the result doesn't grow with the square of the copies. A region
    may overlap others; a location in several gives a row for each. Unusable rings contain nothing. Empty
    tables give an empty result; other columns are never read.

    Cells that count more than ``cell_most`` points are split by pivots of their own. The coordinates themselves are what
    finds are joined back by, so no two locations can be taken for one.
    """
    spark = points.sparkSession
    ship_package(spark)
    # -0.0 and 0.0 are one coordinate, and so is the meridian at 180 from either side.
    x = F.when(F.col(lon) == -180, 180.0).otherwise(F.col(lon) + 0.0)
    members = locations(points.where(F.col(key).isNotNull()), lat, lon).select(F.col(key).cast("string").alias("member"), (F.col(lat) + 0.0).alias("lat"), x.alias("lon"))
    members = checkpointed(members.distinct())
    spots = checkpointed(members.groupBy("lat", "lon").agg(F.min("member").alias("lead"), F.count("*").alias("n")))
    pivots = choose_pivots(spots, per_cell, most)
    if not len(pivots):
        return spark.createDataFrame([], "relation string, left_key string, right_key string")
    angle_of = radius_m / EARTH_M
    none = F.lit(None).cast("array<double>")
    cells = spots.select(F.lit(0).cast("long").alias("key"), "lat", "lon", F.lit(0.0).alias("reach"), none.alias("ring_lat"), none.alias("ring_lon"))
    if regions is not None:
        cells = cells.unionByName(region_circles(regions, region_key))
    held = spark.sparkContext.broadcast(pivots)
    placed = cells.withColumn("kind", F.lit("home")).mapInPandas(lambda batches: assign_cells(batches, held.value, 2 * angle_of), _CELL_SCHEMA)
    placed, sizes = _cells(placed, 2 * angle_of, per_cell, most, cell_most)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([near_in_cell(frame[frame["kind"] != "region"], angle_of), inside_in_cell(frame)])[_FOUND]

    # cells go to tasks by their sizes, largest first, not by the bytes they have
    tasks = max(1, -(-sum(sizes.values()) // TASK))
    table = [(c, i % tasks) for i, (c, _) in enumerate(sorted(sizes.items(), key=lambda s: (-s[1], s[0])))]
    dealt = placed.join(broadcast_if_small(spark.createDataFrame(table, "cell long, task int")), "cell").repartitionById(tasks, "task")
    found = checkpointed(dealt.groupBy("task", "cell").applyInPandas(join, "relation string, lat double, lon double, lat_b double, lon_b double, key long"))
    near, inside = found.where("relation = 'near'").drop("key"), found.where("relation = 'inside'").select("lat", "lon", "key")
    at = ["lat", "lon"]
    if copies == "members":
        leads = spots.select(*at, F.col("lead").alias("a"))
        same = members.join(spots.where("n > 1").drop("n"), at).where("member <> lead").select(F.lit("same").alias("relation"), F.col("lead").alias("left_key"), F.col("member").alias("right_key"))
    else:
        leads = members.select(*at, F.col("member").alias("a"))
        shared = members.join(spots.where("n > 1").select(*at), at, "left_semi").select(*at, F.col("member").alias("a"))
        same = shared.join(shared.withColumnRenamed("a", "b"), at).where("a < b").select(F.lit("near").alias("relation"), F.col("a").alias("left_key"), F.col("b").alias("right_key"))
    other = leads.select(F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("a").alias("b"))
    apart = near.join(leads, at).join(other, ["lat_b", "lon_b"]).where("a <> b")
    pairs = apart.select(F.lit("near").alias("relation"), F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key")).unionByName(same)
    return pairs.unionByName(inside.join(leads, at).select(F.lit("inside").alias("relation"), F.col("a").alias("left_key"), F.col("key").cast("string").alias("right_key")))


def media_near_and_inside(media: DataFrame, places: DataFrame, radius_m: float = 60.0, copies: str = "pairs") -> DataFrame:
    """``spatial_join`` of the locations of the live media rows and the places."""
    return spatial_join(live_rows(media, "exif_gps_lat", "exif_gps_lon"), places, radius_m, copies=copies)
