"""Points near other points, and the region that holds a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import stream_groups

#: Edge of the blocks that near pairs are searched in, metres.
BLOCK_M = 2.0
#: Blocks of more points than this are cut into smaller ones, so that no task holds or pairs a hot one alone.
BLOCK_POINTS = 100_000
#: So many hot blocks are sent to every task (20 bytes each); beyond that points meet them in a shuffled join.
HOT_LIST = 100_000
#: Zones up to this many go to every task (64 bytes each, so under 4 MB); beyond it slabs are distributed.
BROADCAST_ZONES = 50_000
#: Distributed slabs: zone edges of one slab, slabs of one sensor at most, and points of a slab for one task.
SLAB_EDGES, MOST_SLABS, SLAB_POINTS = 256, 1024, 1_000_000
#: Points times zones that are compared at once.
COMPARED = 1 << 18


def valid_points(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are there, finite, not all zero and within 100 m of the origin."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    d = x * x + y * y + z * z
    # NaN is greater than any number in Spark, so one comparison drops NaN and infinities too; null fails it.
    return points.filter((d <= 10_000.0) & (d > 0.0))


def near_pairs(points: DataFrame, radius: float = 0.0305, group: str = "session_id", key: str = "point_id", block_points: int = BLOCK_POINTS, hot_list: int = HOT_LIST) -> DataFrame:
    """(key_a, key_b), key_a < key_b: points of one group at most ``radius`` apart.

    A point goes to its block and, if it lies within the radius of the block's lower face, to the block below too; a
    pair belongs to the one block of its lower corner, so it comes out once. In a block a point is compared only with
    the points of its own and the 13 following cells of radius size. Blocks with more than ``block_points`` points are
    cut into blocks of half the edge, a quarter and so on, by the same rule. Rows with one key and place count once.
    Blocks are named by a 64-bit and a 32-bit hash of group and position. Invalid points must be gone; rows with a
    null key or group take no part. A radius over a quarter of BLOCK_M is refused.
    """
    if not 0 <= radius <= BLOCK_M / 4:
        raise ValueError(f"radius {radius} is not within 0 and {BLOCK_M / 4}")
    rows = points.filter(F.col(key).isNotNull() & F.col(group).isNotNull())
    subsets = F.array(*[F.array(*[F.lit(s) for s in range(8) if s & m == s]) for m in range(8)])
    bit = lambda c, k: F.shiftright(F.col(c), k).bitwiseAND(1)
    wide = lambda c: F.col(c).cast("double")
    edge = [(F.floor((wide(c) - radius) / BLOCK_M) < F.floor(wide(c) / BLOCK_M)).cast("int") for c in "xyz"]
    named = rows.select(F.col(key).cast("bigint").alias("id"), F.col(group).alias("g"), "x", "y", "z", (edge[0] + edge[1] * 2 + edge[2] * 4).alias("m"))
    copies = named.select("id", "g", "x", "y", "z", F.explode(F.element_at(subsets, F.col("m") + 1)).alias("f"))
    at = [F.floor(wide(c) / BLOCK_M) - bit("f", k) for k, c in enumerate("xyz")]
    blocks = copies.select(F.xxhash64("g", *at).alias("b"), F.hash("g", *at).alias("b2"), "id", "x", "y", "z", F.col("f").cast("byte").alias("f"), F.lit(0).cast("byte").alias("k"))

    # points lie on surfaces: half the edge leaves about a quarter of them
    deepest = int(np.floor(np.log2(BLOCK_M / max(2 * radius, 1e-3))))
    home = [F.floor(wide(c) / BLOCK_M) for c in "xyz"]
    counted = rows.groupBy(F.xxhash64(group, *home).alias("b"), F.hash(group, *home).alias("b2")).agg(F.count("*").alias("n"))
    hot = counted.filter(F.col("n") > block_points).select("b", "b2", F.least(F.ceil(F.log2(F.col("n") / block_points) / 2), F.lit(deepest)).cast("byte").alias("cut"))
    listed = hot.limit(hot_list + 1).collect()
    if listed:
        small = points.sparkSession.createDataFrame(listed, hot.schema)
        marked = blocks.join(F.broadcast(small) if len(listed) <= hot_list else hot, ["b", "b2"], "left")
        e = F.lit(BLOCK_M) / F.pow(F.lit(2.0), "cut")
        # above the block's top a copy keeps its place; else it also goes below where that is in the same block
        fine = [F.floor(wide(c) / e) for c in "xyz"]
        lowest = [F.floor(wide(c) / BLOCK_M) * F.pow(F.lit(2.0), "cut") for c in "xyz"]
        free = [((bit("f", k) == 0) & (F.floor((wide(c) - radius) / e) < fine[k]) & (fine[k] > lowest[k])).cast("int") for k, c in enumerate("xyz")]
        cut = marked.filter("cut is not null").select("*", F.explode(F.element_at(subsets, free[0] + free[1] * 2 + free[2] * 4 + 1)).alias("s"))
        cut = cut.withColumn("f", F.col("f").bitwiseOR(F.col("s")).cast("byte"))
        place = [fine[k] - bit("f", k) for k in range(3)]
        cut = cut.select(F.xxhash64("b", "b2", *place).alias("b"), F.hash("b", "b2", *place).alias("b2"), "id", "x", "y", "z", "f", F.col("cut").alias("k"))
        blocks = marked.filter("cut is null").select(blocks.columns).unionByName(cut)
    cell = radius * (1 + 1e-9)

    def search(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cuts = group_starts_fast(pdf["b"].to_numpy(), pdf["b2"].to_numpy())
        seq = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        f = pdf["f"].to_numpy().astype("int64")
        p = pdf[["x", "y", "z"]].to_numpy("float64")
        side = (BLOCK_M / 2.0 ** pdf["k"].to_numpy())[:, None]
        bits = np.stack([f & 1, f >> 1 & 1, f >> 2 & 1], 1)
        rel = p - (np.floor(p / side) - bits) * side
        c = np.floor(rel / cell).astype("int64") + 1
        n = int(2 ** np.ceil(np.log2(BLOCK_M / cell + 4)))
        k = ((seq * n + c[:, 0]) * n + c[:, 1]) * n + c[:, 2]
        ids = pdf["id"].to_numpy()
        o = np.lexsort((ids, k))
        k, ids, p, f = k[o], ids[o], p[o], f[o]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (ids[1:] != ids[:-1]) | (p[1:] != p[:-1]).any(1)
        k, ids, p, f = k[keep], ids[keep], p[keep], f[keep]
        me = np.arange(len(k))
        spans = [(me + 1, np.searchsorted(k, k + 1, "right"))]
        for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
            mid = k + (dx * n + dy) * n
            spans.append((np.searchsorted(k, mid - 1, "left"), np.searchsorted(k, mid + 1, "right")))
        aa, bb, held = [], [], 0
        for lo, hi in spans:
            m = np.maximum(hi - lo, 0)
            busy = np.flatnonzero(m)
            # in slices, and given out as they come, so a dense block needs no more memory than a slice
            ends = np.cumsum(m[busy])
            for part in np.split(busy, np.searchsorted(ends, np.arange(4_000_000, ends[-1], 4_000_000)) if len(ends) else []):
                q = m[part]
                i = np.repeat(part, q)
                j = np.arange(q.sum()) - np.repeat(np.cumsum(q) - q, q) + np.repeat(lo[part], q)
                d = p[i] - p[j]
                ok = ((d * d).sum(1) <= radius * radius) & (f[i] & f[j] == 0) & (ids[i] != ids[j])
                aa.append(np.minimum(ids[i][ok], ids[j][ok]))
                bb.append(np.maximum(ids[i][ok], ids[j][ok]))
                held += len(aa[-1])
                if held >= 1_000_000:
                    yield pd.DataFrame({"key_a": np.concatenate(aa), "key_b": np.concatenate(bb)})
                    aa, bb, held = [], [], 0
        if held:
            yield pd.DataFrame({"key_a": np.concatenate(aa), "key_b": np.concatenate(bb)})

    return stream_groups(blocks, ["b", "b2"], [], search, "key_a bigint, key_b bigint")


def group_starts_fast(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


class Slabs:
    """Axis-aligned boxes of several owners (sensors), located through the slabs that their ordered edges cut space into.

    The points of a call go through the edges together: the middle edge of those that run through a part of space halves
    it into two slabs, and each point falls into one, as in a binary search. In a part only boxes with an edge through it
    stay; the largest zone_id that covers it settles it against all smaller ones. So a call never holds more than points
    and boxes, however the boxes overlap (the full decomposition is cubic in them).
    """

    def __init__(self, zones: pd.DataFrame):
        low, high = (np.stack([zones[f"{c}_{m}"].to_numpy("float64") for c in "xyz"], 1) for m in ("min", "max"))
        ok = (low < high).all(1) & zones["zone_id"].notna().to_numpy() & zones["sensor_id"].notna().to_numpy()
        ids, owner = zones["zone_id"].to_numpy()[ok].astype("int64"), zones["sensor_id"].to_numpy()[ok]
        codes, self.owners = pd.factorize(owner, sort=True)
        order = np.lexsort((-ids, codes))
        self.low, self.high, self.ids = low[ok][order], high[ok][order], ids[order]
        self.start = np.append(np.searchsorted(codes[order], np.arange(len(self.owners))), len(order))
        self.owners = pd.Index(self.owners)

    def locate(self, owner: pd.Series, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Largest zone_id that holds each point, -1 outside all."""
        out = np.full(len(x), -1, "int64")
        if not len(self.owners) or not len(x):
            return out
        at = self.owners.get_indexer(owner)
        p = np.stack([x, y, z], 1)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(self.owners) + 1))
        for k in range(len(self.owners)):
            if cuts[k] < cuts[k + 1]:
                self._descend(p, order[cuts[k] : cuts[k + 1]], np.arange(self.start[k], self.start[k + 1]), out)
        return out

    def _descend(self, p: np.ndarray, rows: np.ndarray, boxes: np.ndarray, out: np.ndarray) -> None:
        parts = [(rows, boxes, -1)]
        while parts:
            rows, boxes, best = parts.pop()
            q = p[rows]
            a, b = q.min(0), q.max(0)
            low, high = self.low[boxes], self.high[boxes]
            meet = ((low <= b) & (high > a)).all(1)
            boxes, low, high = boxes[meet], low[meet], high[meet]
            # boxes are in order of falling zone_id: behind one that covers the part none counts
            over = np.flatnonzero(((low <= a) & (high > b)).all(1))
            if len(over):
                best, boxes = max(best, int(self.ids[boxes[over[0]]])), boxes[: over[0]]
                low, high = low[: over[0]], high[: over[0]]
            if not len(boxes):
                out[rows] = best
            elif len(rows) * len(boxes) <= COMPARED or (a == b).all():
                inside = ((low[None] <= q[:, None]) & (q[:, None] < high[None])).all(2)
                first = inside.argmax(1)
                hit = inside[np.arange(len(rows)), first]
                out[rows] = np.where(hit, self.ids[boxes[first]], best)
            else:
                edges = [np.concatenate([low[:, c], high[:, c]]) for c in range(3)]
                edges = [e[(e > a[c]) & (e <= b[c])] for c, e in enumerate(edges)]
                c = int(np.argmax([len(e) for e in edges]))
                middle = np.partition(edges[c], len(edges[c]) // 2)[len(edges[c]) // 2]
                right = q[:, c] >= middle
                parts += [(rows[~right], boxes, best), (rows[right], boxes, best)]


_ZONE_COLS = ["zone_id", "sensor_id", *[f"{c}_{m}" for c in "xyz" for m in ("min", "max")]]


def zone_of_points(spark: SparkSession, points: DataFrame, zones: DataFrame, limit: int = BROADCAST_ZONES) -> DataFrame:
    """(key_a, key_b): point_id and the largest zone_id among the zones of its sensor that hold it (low side in, high
    side out). Repeated points give one row. Zones with a null, NaN or empty extent hold nothing.

    Up to ``limit`` zones all of them go to every task; with more, slabs and points meet by sensor and slab.
    """
    rows = points.select(F.col("point_id").cast("bigint").alias("key_a"), "sensor_id", *[F.col(c).cast("double") for c in "xyz"]).filter("key_a is not null")
    few = zones.select(*_ZONE_COLS).limit(limit + 1).toPandas()
    if len(few) <= limit:
        shared = spark.sparkContext.broadcast(Slabs(few))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _placed(shared.value, pdf)

        held = rows.mapInPandas(place, "key_a bigint, key_b bigint")
    else:
        held = zone_by_slabs(spark, rows, zones)
    return held.groupBy("key_a").agg(F.max("key_b").alias("key_b"))


def _placed(slabs: Slabs, pdf: pd.DataFrame) -> pd.DataFrame:
    zone = slabs.locate(pdf["sensor_id"], *(pdf[c].to_numpy() for c in "xyz"))
    ok = zone >= 0
    return pd.DataFrame({"key_a": pdf["key_a"].to_numpy()[ok], "key_b": zone[ok]})


def zone_by_slabs(
    spark: SparkSession, rows: DataFrame, zones: DataFrame, slab_edges: int = SLAB_EDGES, most_slabs: int = MOST_SLABS, slab_points: int = SLAB_POINTS
) -> DataFrame:
    """The path for many zones. The edges of a sensor's zones along x are put in order; every so many-th is a border
    between slabs. A zone goes to all slabs it meets, a point to its one, and a slab with many points to several tasks.

    Only the borders come to the driver: one of ``slab_edges`` edges, at most ``most_slabs`` a sensor.
    """
    from pyspark.sql import Window as W

    z = zones.select(*_ZONE_COLS).filter("zone_id is not null and sensor_id is not null and x_min < x_max and y_min < y_max and z_min < z_max and not isnan(x_max)")
    edges = z.select("sensor_id", F.explode(F.array("x_min", "x_max")).alias("x")).distinct()
    by = W.partitionBy("sensor_id")
    ranked = edges.select("sensor_id", "x", F.row_number().over(by.orderBy("x")).alias("r"), F.count("*").over(by).alias("n"))
    step = F.greatest(F.lit(slab_edges), F.ceil(F.col("n") / most_slabs))
    borders = {r["sensor_id"]: np.array(sorted(r["x"])) for r in ranked.filter(F.col("r") % step == 0).groupBy("sensor_id").agg(F.collect_list("x").alias("x")).collect()}
    shared = spark.sparkContext.broadcast(borders)

    def slab_of(sensor: pd.Series, x: pd.Series, side: str) -> np.ndarray:
        out = np.zeros(len(x), "int32")
        for s, at in sensor.groupby(sensor).indices.items():
            known = shared.value.get(s)
            if known is not None:
                out[at] = np.searchsorted(known, x.to_numpy()[at], side)
        return out

    @F.pandas_udf("int")
    def slab(sensor: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(slab_of(sensor, x, "right"))

    @F.pandas_udf("int")
    def last_slab(sensor: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(slab_of(sensor, x, "left"))

    keys = ["sensor_id", "slab", "salt"]
    p = rows.filter("sensor_id is not null").withColumn("slab", slab("sensor_id", "x"))
    size = p.groupBy("sensor_id", "slab").agg(F.ceil(F.count("*") / slab_points).cast("int").alias("salts"))
    meet = z.withColumn("slab", F.explode(F.sequence(slab("sensor_id", "x_min"), last_slab("sensor_id", "x_max"))))
    again = size.select(*[F.col(c).alias(f"{c}_") for c in size.columns])
    meet = meet.join(again, (F.col("sensor_id") == F.col("sensor_id_")) & (F.col("slab") == F.col("slab_")))
    meet = meet.select(*_ZONE_COLS, "slab", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1)).alias("salt"))
    salted = p.join(size, ["sensor_id", "slab"]).select(*rows.columns, "slab", F.pmod(F.xxhash64("key_a"), F.col("salts")).cast("int").alias("salt"))
    return salted.groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInPandas(lambda a, b: _placed(Slabs(b), a), "key_a bigint, key_b bigint")


def near_and_zone(spark: SparkSession, points: DataFrame, zones: DataFrame, radius: float = 0.0305) -> DataFrame:
    """(relation, key_a, key_b): 'near' pairs within a session and the 'zone' of each point."""
    ok = valid_points(points)
    near = near_pairs(ok, radius).select(F.lit("near").alias("relation"), "key_a", "key_b")
    zone = zone_of_points(spark, ok, zones).select(F.lit("zone").alias("relation"), "key_a", "key_b")
    return near.unionByName(zone)


__all__ = ["Slabs", "near_and_zone", "near_pairs", "valid_points", "zone_by_slabs", "zone_of_points"]
