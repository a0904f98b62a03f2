"""Components, clusters and graph closures.

Points are reduced to distinct cells before anything is linked. Cells of one key (a frame, a session's room) are few and
are solved together, thousands of keys to a call; edges that span keys go through the distributed components.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import ensure_checkpoint_dir, group_starts, stream_groups


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            break
    return label


def cell_edges(cells: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of neighbouring rows of an integer cell table of distinct rows."""
    import itertools

    n, k = cells.shape
    c = cells - cells.min(0) + 1
    span = c.max(0) + 2
    key = np.ravel_multi_index(tuple(c.T), tuple(span))
    order = np.argsort(key, kind="stable")
    key = key[order]
    aa, bb = [], []
    for o in itertools.product((-1, 0, 1), repeat=k):
        if o <= (0,) * k or (not diagonal and sum(map(abs, o)) != 1):
            continue
        want = key + int(np.ravel_multi_index(tuple(np.array(o) + 1), tuple(span)) - np.ravel_multi_index((1,) * k, tuple(span)))
        at = np.minimum(np.searchsorted(key, want), n - 1)
        hit = key[at] == want
        aa.append(order[hit])
        bb.append(order[at[hit]])
    return np.concatenate(aa) if aa else np.zeros(0, int), np.concatenate(bb) if bb else np.zeros(0, int)


def compact(labels: np.ndarray) -> np.ndarray:
    """Component numbers 0, 1, ... in the order of their first member."""
    return np.unique(labels, return_inverse=True)[1]


def cell_components(cells: DataFrame, keys: Sequence[str], coords: Sequence[str], diagonal: bool = True, link: tuple[str, float, float] | None = None) -> DataFrame:
    """(keys, coords, component): connected cells of each key, numbered by their lowest cell. ``link`` (column, base,
    share) also asks for |a - b| <= max(base, share * min(a, b)). cells: distinct rows."""
    keys, coords = list(keys), list(coords)
    kinds = dict(cells.dtypes)
    cols = [*keys, *coords, *([link[0]] if link else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = group_starts(pdf, keys)
        xyz = pdf[coords].to_numpy("int64")
        out = np.empty(len(pdf), "int64")
        v = pdf[link[0]].to_numpy("float64") if link else None
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            a, b = cell_edges(xyz[lo:hi], diagonal)
            if link:
                va, vb = v[lo:hi][a], v[lo:hi][b]
                ok = np.abs(va - vb) <= np.maximum(link[1], link[2] * np.minimum(va, vb))
                a, b = a[ok], b[ok]
            out[lo:hi] = compact(min_labels(hi - lo, a, b))
        return pdf[[*keys, *coords]].assign(component=out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *coords]) + ", component bigint"
    return stream_groups(cells.select(*cols), keys, coords, run, schema)


def voxel_components(points: DataFrame, keys: Sequence[str], size: float, dims: Sequence[str] = ("x", "y", "z"), diagonal: bool = True) -> DataFrame:
    """points with component: voxels of ``size`` that touch (by face, edge or corner) belong together."""
    cells = [f"c{c}" for c in dims]
    p = points.withColumns({f"c{c}": F.floor(F.col(c) / size).cast("bigint") for c in dims})
    comp = cell_components(p.select(*keys, *cells).distinct(), keys, cells, diagonal)
    return p.join(comp, [*keys, *cells]).drop(*cells)


def radius_graph(p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most ``radius`` apart, by cells of that size."""
    n, k = p.shape
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    import itertools

    c = np.floor(p / radius).astype("int64")
    c = c - c.min(0) + 1
    span = c.max(0) + 2
    key = np.ravel_multi_index(tuple(c.T), tuple(span))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    base = np.ravel_multi_index((1,) * k, tuple(span))
    aa, bb = [], []
    for o in itertools.product((-1, 0, 1), repeat=k):
        want = key + int(np.ravel_multi_index(tuple(np.array(o) + 1), tuple(span)) - base)
        lo, hi = np.searchsorted(sorted_key, want, "left"), np.searchsorted(sorted_key, want, "right")
        m = hi - lo
        i = np.repeat(np.arange(n), m)
        j = order[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        ok = (i < j) & (((p[i] - p[j]) ** 2).sum(1) <= radius * radius)
        aa.append(i[ok])
        bb.append(j[ok])
    return np.concatenate(aa), np.concatenate(bb)


def dbscan(p: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Cluster of each point, -1 for noise. A point with min_samples points within eps (itself included) is core; a
    border point joins the cluster of its lowest core neighbour."""
    n = len(p)
    a, b = radius_graph(p, eps)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1
    core = degree >= min_samples
    ok = core[a] & core[b]
    label = min_labels(n, a[ok], b[ok])
    out = np.where(core, label, n)
    for x, y in ((a, b), (b, a)):
        edge = ~core[x] & core[y]
        np.minimum.at(out, x[edge], label[y[edge]])
    res = np.full(n, -1)
    res[out < n] = compact(out[out < n])
    return res


def group_clusters(points: DataFrame, keys: Sequence[str], pid: str, method, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(keys, pid, cluster) with method(array of one key's points) -> labels; for keys of bounded size (a frame)."""
    keys, kinds = list(keys), dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, xyz = group_starts(pdf, keys), pdf[list(dims)].to_numpy("float64")
        out = np.concatenate([method(xyz[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]) if len(pdf) else np.zeros(0, "int64")
        return pdf[[*keys, pid]].assign(cluster=out.astype("int64"))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, pid]) + ", cluster bigint"
    return stream_groups(points.select(*keys, pid, *dims), keys, [pid], run, schema)


def single_link(radius: float):
    return lambda p: compact(min_labels(len(p), *radius_graph(p, radius)))


def coarse_then_fine(coarse: float, fine: float):
    """Clusters at ``coarse``, each split again at ``fine``."""

    def run(p: np.ndarray) -> np.ndarray:
        first = single_link(coarse)(p)
        out = np.zeros(len(p), "int64")
        for c in np.unique(first):
            at = np.flatnonzero(first == c)
            out[at] = at[0] * (len(p) + 1) + single_link(fine)(p[at])
        return compact(out)

    return run


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (a, b) over any number of partitions: every node takes its neighbours' least
    label, then its label's label, until a sum over all labels stands still. Each round is checkpointed."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    every = both.select(F.col("a").alias("node"))
    every = (every.unionByName(nodes.select("node")) if nodes is not None else every).distinct()
    labels = every.withColumn("component", F.col("node")).checkpoint()
    before = None
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = hooked.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")).checkpoint()
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def best_shift(now: DataFrame, past: DataFrame, keys: Sequence[str], penalty: float) -> DataFrame:
    """The integer shift of a key's past cells (26 neighbours or none) that explains most of its present ones: common
    cells minus the penalty for moving."""
    from .filters import NEAR_3D

    keys, c = list(keys), ["cx", "cy", "cz"]
    shifts = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in zip("xyz", o)]) for o in NEAR_3D]))
    moved = past.withColumn("s", shifts).select(*keys, *[(F.col(f"c{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in "xyz"], "s")
    n = now.join(moved, [*keys, *c]).groupBy(*keys, "s").agg(F.count("*").alias("common"))
    still = (F.col("s.sx") == 0) & (F.col("s.sy") == 0) & (F.col("s.sz") == 0)
    scored = n.withColumn("score", F.col("common") - F.when(still, 0.0).otherwise(penalty))
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("s.sx")).alias("a"), (-F.col("s.sy")).alias("b"), (-F.col("s.sz")).alias("c"), "common")).alias("m"))
    return best.select(*keys, (-F.col("m.a")).alias("sx"), (-F.col("m.b")).alias("sy"), (-F.col("m.c")).alias("sz"), F.col("m.common").alias("common"), F.col("m.score").alias("score"))


def closure(pairs: DataFrame) -> DataFrame:
    """Fixpoint over a two-sided relation (l, r): (side, id, block) of everything joined directly or through others."""
    e = pairs.select(F.concat(F.lit("l:"), F.col("l").cast("string")).alias("a"), F.concat(F.lit("r:"), F.col("r").cast("string")).alias("b"))
    return connected_components(e).select(F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 3)").alias("id"), F.col("component").alias("block"))


def axis_nodes(points: DataFrame, keys: Sequence[str], slabs: Sequence[tuple[str, float, float]], support: int, least_span: float, least: int) -> DataFrame:
    """(keys, node, n, x, y, z, joined_to): skeleton of each key's points. Slabs (name, from, to) are shares of the stretch
    between the 2nd and 98th percentile along the main axis; a node is the median of a slab with enough points, joined to
    the next slab's node if that is there. No node where the axis is ambiguous, short or the points are few."""
    from pyspark.sql import Window as W

    from .aggregates import covariance, with_eigen

    keys = list(keys)
    axis = with_eigen(covariance(points, keys).filter(F.col("n") >= least)).filter("v1x is not null").select(*keys, "v1x", "v1y", "v1z")
    mid = points.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"c{c}") for c in "xyz"])
    u = sum(((F.col(c) - F.col(f"c{c}")) * F.col(f"v1{c}") for c in "yz"), (F.col("x") - F.col("cx")) * F.col("v1x"))
    l = points.join(axis.join(mid, keys), keys).withColumn("__u", u)
    ends = l.groupBy(*keys).agg(F.percentile("__u", [0.02, 0.98]).alias("__q")).filter(F.get("__q", 1) - F.get("__q", 0) >= least_span)
    f = (F.col("__u") - F.get("__q", 0)) / (F.get("__q", 1) - F.get("__q", 0))
    k = F.lit(None).cast("int")
    for i, (_, a, b) in reversed(list(enumerate(slabs))):
        k = F.when((f >= a) & (f < b), i).otherwise(k)
    g = l.join(ends, keys).withColumn("__k", k).filter("__k is not null").groupBy(*keys, "__k").agg(F.count("*").alias("n"), *[F.percentile(c, 0.5).alias(c) for c in "xyz"]).filter(F.col("n") >= support)
    names = F.array(*[F.lit(s[0]) for s in slabs])
    nxt = F.lead("__k").over(W.partitionBy(*keys).orderBy("__k"))
    return g.withColumn("joined_to", F.when(nxt == F.col("__k") + 1, F.get(names, nxt))).withColumn("node", F.get(names, F.col("__k"))).drop("__k")


def slab_nodes(points: DataFrame, keys: Sequence[str], axis: Column, slabs: int, support: int) -> DataFrame:
    """Skeleton: per key the points cut into equal slabs along an axis; the median of each slab with enough points."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    d = points.withColumn("__s", axis)
    lo, hi = F.min("__s").over(w), F.max("__s").over(w)
    slab = F.least(F.floor((F.col("__s") - lo) / F.nullif(hi - lo, F.lit(0.0)) * slabs), F.lit(slabs - 1))
    g = d.withColumn("slab", F.coalesce(slab, F.lit(0))).groupBy(*keys, "slab").agg(F.count("*").alias("n"), *[F.percentile(c, 0.5).alias(c) for c in "xyz"])
    return g.filter(F.col("n") >= support)
