"""Feature vectors of frames and of windows of frames, and shape evidence of point groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import with_eigen

#: Edges of the height layers (metres above ground) and of the height bands of a frame vector.
LAYERS = [-0.3, 0.0, 0.3, 0.6, 0.9, 1.2, 1.5, 1.8, 2.1, 2.7]
BANDS = [(-1, 0.3), (0.3, 0.6), (0.6, 0.9), (0.9, 1.2), (1.2, 1.5), (1.5, 1.8), (1.8, 2.2), (2.2, 2.6), (2.6, 1e9)]


def _moments(ddof: int = 0) -> list[Column]:
    var, cov = (F.var_samp, F.covar_samp) if ddof else (F.var_pop, F.covar_pop)
    return [(var(p[0]) if p[0] == p[1] else cov(p[0], p[1])).alias(p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")]


def structure_evidence(points: DataFrame, keys: Sequence[str], height: str | None = None) -> DataFrame:
    """Per key: n, spans, eigenvalues, linearity, planarity and scattering against the largest eigenvalue (null for a mere
    point), verticality |v_z| of the main axis (null where it is ambiguous), and with ``height`` the points in each layer
    of LAYERS (the last one closed) and outside all."""
    aggs = [F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in "xyz"], *_moments()]
    if height:
        h = F.col(height)
        inside = [(h >= a) & ((h <= b) if k == len(LAYERS) - 2 else (h < b)) for k, (a, b) in enumerate(zip(LAYERS, LAYERS[1:]))]
        aggs += [F.count_if(c).alias(f"layer_{k}") for k, c in enumerate(inside)]
        aggs.append(F.count_if(~h.between(LAYERS[0], LAYERS[-1])).alias("layer_out"))
    e = with_eigen(points.groupBy(*keys).agg(*aggs))
    l = [F.greatest(F.col(f"l{i}"), F.lit(0.0)) for i in (1, 2, 3)]
    big = F.when(l[0] > 1e-12, l[0])
    return e.withColumns({"linearity": (l[0] - l[1]) / big, "planarity": (l[1] - l[2]) / big, "scattering": l[2] / big, "verticality": F.abs("v1z"), "axis_ambiguous": F.col("v1z").isNull()})


def frame_vector(points: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys, f0 ... f50) of every frame with at least ``least`` points: counts and intensity (0-4), percentiles of place
    (5-13), height bands (14-22), centre and sample covariance (23-31), eigenvalues falling, their ratios and the
    vertical parts of the axes from the smallest eigenvalue up (32-40), and shape scalars (41-50). The vertical part
    of an axis that is not clear of its neighbour is null."""
    pct = [0.1, 0.5, 0.9]
    z = F.col("z")
    r = F.hypot("x", "y")
    a = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("intensity").alias("im"), F.stddev_pop("intensity").alias("is"), *[F.percentile(c, pct).alias(f"p{c}") for c in "xyz"], F.percentile("intensity", pct).alias("pi"),
        *[(F.count_if((z >= lo) & (z < hi)) / F.count("*")).alias(f"b{k}") for k, (lo, hi) in enumerate(BANDS)], *[F.avg(c).alias(f"m{c}") for c in "xyz"], *_moments(1),
        F.stddev_pop(r).alias("rs"), F.count_if((z > 1.2) & (z < 2.2)).alias("up"), F.count_if((z >= 0.4) & (z < 1.2)).alias("mid"), (F.count_if(r < 3.0) / F.count("*")).alias("close"),
    ).filter(F.col("n") >= least)
    e = with_eigen(a)
    l1, l2, l3 = (F.col(f"l{i}") for i in (1, 2, 3))
    floor = lambda c: F.greatest(c, F.lit(1e-9))
    span = F.get("pz", 2) - F.get("pz", 0)
    # the three axes are orthonormal, so their vertical parts squared add up to one
    middle = F.sqrt(F.greatest(1 - F.col("v1z") ** 2 - F.col("v3z") ** 2, F.lit(0.0)))
    f = [F.col("n").cast("double"), F.lit(10.0), F.greatest(F.col("n"), F.lit(2000)).cast("double"), F.coalesce("im", F.lit(0.0)), F.log10(F.coalesce("is", F.lit(0.0)) + 1)]
    f += [F.get(f"p{c}", k) for c in "xyz" for k in range(3)] + [F.col(f"b{k}") for k in range(9)] + [F.col(f"m{c}") for c in "xyz"] + [F.col(p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")]
    f += [l1, l2, l3, l1 / floor(l2), l2 / floor(l3), F.abs("v3z"), middle, F.abs("v1z"), l1 / floor(l3)]
    f += [F.col("rs"), span, F.when(span > 0.01, F.log10(F.abs(span))).otherwise(0.0), F.when(F.col("mid") > 0, F.col("up") / F.col("mid")).otherwise(0.0), *[F.get("pi", k) for k in range(3)], F.col("close"), F.get("pz", 2), l1 + l2 + l3]
    return e.select(*keys, *[c.alias(f"f{k}") for k, c in enumerate(f)])


def frame_extension(pdf: pd.DataFrame, sample: int = 300) -> np.ndarray:
    """17 further numbers of one frame's points (x, y, z, intensity): shape shares, chord radii, occupied 10 cm layers and
    the fullest one's share, root mean square distance to the nine nearest points for about ``sample`` of them, kurtosis
    of height, ratio of the ground-plane eigenvalues, distance and direction, intensity span, log of the count,
    shares above 1.3 m and 0.1 m. Memory is bounded: distances are taken for a few points at a time."""
    p, i = pdf[["x", "y", "z"]].to_numpy("float64"), pdf["intensity"].to_numpy("float64")
    n, c = len(p), p.mean(0)
    z = p[:, 2]
    w = np.clip(np.linalg.eigvalsh(np.cov((p - c).T)), 0, None)
    total = w.sum()
    shares = [(w[2] - w[1]) / total, (w[1] - w[0]) / total, w[0] / total] if total > 0 else [0.0] * 3
    r = np.hypot(p[:, 0] - c[0], p[:, 1] - c[1])
    layers = np.bincount(np.floor((z - z.min()) / 0.10).astype(int))
    some, k = p[:: max(1, n // sample)], min(9, n - 1)
    square = 0.0
    for lo in range(0, len(some), 64):
        d = ((some[lo : lo + 64, None] - p[None]) ** 2).sum(2)
        square += np.partition(d, k, axis=1)[:, : k + 1].sum()
    zc = z - z.mean()
    flat = np.linalg.eigvalsh(np.cov((p[:, :2] - c[:2]).T))
    known = i[~np.isnan(i)]
    spread = float(np.percentile(known, 90) - np.percentile(known, 10)) if len(known) else 0.0
    return np.array([
        *shares, r.max(), r.mean(), r.std(), float(len(layers)), layers.max() / n, np.sqrt(square / (len(some) * k)), (zc**4).mean() / max((zc**2).mean() ** 2, 1e-12),
        flat[0] / max(flat[1], 1e-9), np.hypot(c[0], c[1]), np.arctan2(c[1], c[0]), spread, np.log10(n), (z > 1.3).mean(), (z > 0.1).mean(),
    ])


def sequence_vector(points: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys, v0 ... v18) of every frame with enough points: log of the count, median centre, 10th, 50th and 90th percentiles
    about it (by percentile, then axis), eigenvalues falling, and their shares."""
    pct = [0.1, 0.5, 0.9]
    a = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile(c, pct).alias(f"p{c}") for c in "xyz"], *_moments(1)).filter(F.col("n") >= least)
    e = with_eigen(a)
    l = [F.greatest(F.col(f"l{i}"), F.lit(0.0)) for i in (1, 2, 3)]
    total = F.greatest(l[0] + l[1] + l[2], F.lit(1e-12))
    f = [F.log1p("n"), *[F.get(f"p{c}", 1) for c in "xyz"], *[F.get(f"p{c}", k) - F.get(f"p{c}", 1) for k in range(3) for c in "xyz"], *l, *[x / total for x in l]]
    return e.select(*keys, *[c.alias(f"v{k}") for k, c in enumerate(f)])


def window_summary(vectors: DataFrame, keys: Sequence[str], order: str, width: int, size: int = 19) -> DataFrame:
    """(keys, window, feature, mean, std, p10, p90, mean_step, change): windows of ``width`` frames in a row, whole ones only;
    centres (features 1 to 3) count from the window's first frame. Six statistics of 19 features make 114 numbers."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    d = vectors.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("window", F.floor(F.col("__r") / width))
    long = d.select(*keys, "window", "__r", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(size)])).alias("feature", "v"))
    in_window = W.partitionBy(*keys, "window", "feature").orderBy("__r")
    first = F.first("v").over(in_window)
    v = long.withColumn("v", F.when(F.col("feature").between(1, 3), F.col("v") - first).otherwise(F.col("v")))
    v = v.withColumn("step", F.abs(F.col("v") - F.lag("v").over(in_window)))
    p = F.percentile("v", [0.1, 0.9])
    g = v.groupBy(*keys, "window", "feature").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), p.alias("p"), F.avg("step").alias("mean_step"), (F.max_by("v", "__r") - F.min_by("v", "__r")).alias("change")
    )
    return g.filter(F.col("n") == width).select(*keys, "window", "feature", "mean", "std", F.get("p", 0).alias("p10"), F.get("p", 1).alias("p90"), "mean_step", "change")
