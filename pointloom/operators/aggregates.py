"""Robust statistics, moments, histograms, coverage and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import ensure_checkpoint_dir
from ..functions.arrays import bind


def nearest_return(df: DataFrame, cell: Sequence[str], dist: str, row: str) -> DataFrame:
    """The nearest row of each cell (ties: the smaller row number) with the number of rows it beat."""
    rest = [c for c in df.columns if c not in cell]
    g = df.groupBy(*cell).agg(F.min(F.struct(dist, row, *[c for c in rest if c not in (dist, row)])).alias("s"), (F.count("*") - 1).alias("duplicates"))
    return g.select(*cell, *[F.col(f"s.{c}").alias(c) for c in rest], "duplicates")


def robust_background(df: DataFrame, cell: Sequence[str], value: str, min_count: int, floor: float = 0.005) -> DataFrame:
    """Per cell: n, median, deviation max(floor, 1.4826 MAD) and known = n >= min_count."""
    cell = list(cell)
    m = df.groupBy(*cell).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"))
    mad = df.join(m, cell).groupBy(*cell).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return m.join(mad, cell).select(*cell, "n", "median", F.greatest(F.lit(floor), 1.4826 * F.col("mad")).alias("sigma"), (F.col("n") >= min_count).alias("known"))


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """The value at floor(n q) in ascending order (the last for q = 1): an element, never a mean of two."""
    w = W.partitionBy(*keys)
    r = df.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return r.filter(F.col("r") == F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1).select(*keys, value)


def percentile_linear(c: str, q: float) -> Column:
    return F.percentile(c, q)


def percentile_nearest(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Elements at round(q (n - 1)), half to even, one row a key and q."""
    w = W.partitionBy(*keys)
    r = df.filter(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    r = r.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    return r.filter(F.col("r") == F.bround(F.col("q") * (F.col("n") - 1)).cast("bigint")).select(*keys, "q", value)


def voxel_centroids(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    cells = {f"c{c}": F.floor(F.col(c) / size).cast("bigint") for c in "xyz"}
    return df.withColumns(cells).groupBy(*keys, *cells).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str], frame: str) -> DataFrame:
    """Sums that merge: n, sum, sum of squares, least and greatest of each column, frames seen, first and last frame."""
    per = [f for c in cols for f in (F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sq"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *per, F.count_distinct(frame).alias("frames"), F.min(frame).alias("first"), F.max(frame).alias("last"))


def merge_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    per = [f for c in cols for f in (F.sum(f"{c}_sum").alias(f"{c}_sum"), F.sum(f"{c}_sq").alias(f"{c}_sq"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"))]
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), *per, F.min("first").alias("first"), F.max("last").alias("last"))


def component_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, median centre, box and span."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.percentile(c, 0.5).alias(f"{c}_mid") for c in "xyz"], *[F.min(c).alias(f"{c}_min") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"{c}_span") for c in "xyz"]
    )


def height_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, p10, median, p90, max (linear) and the robust span p95 - p5."""
    p = F.percentile(value, [0.05, 0.1, 0.5, 0.9, 0.95])
    a = df.groupBy(*keys).agg(F.min(value).alias("min"), p.alias("p"), F.max(value).alias("max"))
    return a.select(*keys, "min", F.get("p", 1).alias("p10"), F.get("p", 2).alias("median"), F.get("p", 3).alias("p90"), "max", (F.get("p", 4) - F.get("p", 0)).alias("span"))


def covariance(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """n, centre and the six population covariances, weighted if asked, in one pass of mergeable sums."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    if weight is None:
        second = [(F.var_pop(p[0]) if p[0] == p[1] else F.covar_pop(p[0], p[1])).alias(p) for p in pairs]
        return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *second)
    # sensor coordinates lie within some hundred metres of the origin, so plain sums keep ten digits
    b = df.withColumn("__w", weight)
    w, total = F.col("__w"), F.sum("__w")
    m = b.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.sum(w * F.col(c)) / total).alias(f"m{c}") for c in "xyz"], *[(F.sum(w * F.col(p[0]) * F.col(p[1])) / total).alias(p) for p in pairs])
    return m.withColumns({p: F.col(p) - F.col(f"m{p[0]}") * F.col(f"m{p[1]}") for p in pairs})


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in closed form, greatest first: no Python, no iteration."""
    q = (xx + yy + zz) / 3
    p2 = ((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    p = F.sqrt(p2)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    l1 = F.when(p2 > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    l3 = F.when(p2 > 0, q + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3)).otherwise(q)
    return [l1, 3 * q - l1 - l3, l3]


def eigenvector(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column, value: Column) -> list[Column]:
    """Unit eigenvector of an eigenvalue: the longest cross product of two rows of A - value I; null if all vanish."""
    r = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    cands = [F.struct((v[0] ** 2 + v[1] ** 2 + v[2] ** 2).alias("n"), *[c.alias(k) for k, c in zip("xyz", v)]) for v in (cross(r[0], r[1]), cross(r[0], r[2]), cross(r[1], r[2]))]
    best = F.array_max(F.array(*cands))
    n = F.sqrt(best["n"])
    return [F.when(n > 0, best[k] / n) for k in "xyz"]


def shape_features(l1: Column, l2: Column, l3: Column) -> dict[str, Column]:
    ok = l1 > 1e-12
    return {"linearity": F.when(ok, (l1 - l2) / l1), "planarity": F.when(ok, (l2 - l3) / l1), "scattering": F.when(ok, l3 / l1)}


def with_eigen(df: DataFrame, gap: float = 1.1) -> DataFrame:
    """Adds to covariances (xx ... zz) the eigenvalues l1 >= l2 >= l3 and the unit eigenvectors of the first and last (v1x ...
    v3z, their greatest part positive); null where the middle eigenvalue is within ``gap`` of theirs: such an axis is
    ambiguous."""
    a = [F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")]

    def system(l: Column) -> Column:
        parts = [l["l1"].alias("l1"), l["l2"].alias("l2"), l["l3"].alias("l3")]
        for i, clear in ((1, l["l1"] > gap * l["l2"]), (3, l["l2"] > gap * l["l3"])):
            x, y, z = eigenvector(*a, l[f"l{i}"])
            axis = bind(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), _positive)
            parts.append(F.when(clear, axis).alias(f"v{i}"))
        return F.struct(*parts)

    values = F.struct(*[v.alias(f"l{i}") for i, v in enumerate(eigenvalues(*a), 1)])
    e = df.withColumn("__e", bind(values, system))
    cols = {f"l{i}": F.col(f"__e.l{i}") for i in (1, 2, 3)} | {f"v{i}{k}": F.col(f"__e.v{i}.{k}") for i in (1, 3) for k in "xyz"}
    return e.withColumns(cols).drop("__e")


def _positive(v: Column) -> Column:
    """The vector or its opposite, so that its greatest part is positive."""
    big = F.greatest(*[F.abs(v[k]) for k in "xyz"])
    sign = F.when((v["x"] == big) | (v["y"] == big) | (v["z"] == big), 1.0).otherwise(-1.0)
    return F.struct(*[(v[k] * sign).alias(k) for k in "xyz"])


def vertical_plane(covariances: DataFrame, name: str) -> DataFrame:
    """(session_id, <name>x, <name>y, <name>z, <name>d): unit upward plane of the least-squares height over x and y, from centres
    and covariances; none where the points lie on a line."""
    xx, xy, xz, yy, yz = (F.col(k) for k in ("xx", "xy", "xz", "yy", "yz"))
    det = xx * yy - xy * xy
    s = covariances.filter(det > 1e-9).select("session_id", "mx", "my", "mz", ((xz * yy - yz * xy) / det).alias("p"), ((yz * xx - xz * xy) / det).alias("q"))
    p, q = F.col("p"), F.col("q")
    n = F.sqrt(1 + p * p + q * q)
    return s.select("session_id", (-p / n).alias(f"{name}x"), (-q / n).alias(f"{name}y"), (1 / n).alias(f"{name}z"), ((p * F.col("mx") + q * F.col("my") - F.col("mz")) / n).alias(f"{name}d"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """(keys, bin, rows) over n equal bins of [lo, hi]; the last takes hi, the rest is left out."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    return df.filter(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("rows"))


def occupied_cells(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Distinct 2-D and 3-D cells, footprint area and vertical fill, by two aggregates on distinct cells."""
    c3 = df.select(*keys, *[F.floor(F.col(c) / size).cast("bigint").alias(f"c{c}") for c in "xyz"]).distinct()
    c2 = c3.groupBy(*keys, "cx", "cy").agg(F.count("*").alias("high"), (F.max("cz") - F.min("cz") + 1).alias("tall"))
    return c2.groupBy(*keys).agg(F.count("*").alias("cells_2d"), F.sum("high").alias("cells_3d"), (F.count("*") * size * size).alias("area_m2"), (F.sum("high") / F.sum("tall")).alias("vertical_fill"))


def residual_stats(value: Column) -> list[Column]:
    """count, zero count, rms, p95 |r|, median, min, max; null without rows."""
    return [
        F.count(value).alias("n"), F.count_if(value == 0).alias("zeros"), F.sqrt(F.avg(value * value)).alias("rms"), F.percentile(F.abs(value), 0.95).alias("p95_abs"),
        F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def ratio(num: Column, den: Column) -> Column:
    """Sum over sum; null when the denominator is 0."""
    return F.sum(num) / F.nullif(F.sum(den), F.lit(0))


def confusion(truth: Column, said: Column) -> dict[str, Column]:
    tp, fp = F.count_if(truth & said), F.count_if(~truth & said)
    fn, tn = F.count_if(truth & ~said), F.count_if(~truth & ~said)
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": p, "recall": r, "f1": 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))}


def _running(g: DataFrame, score: str, cols: Sequence[str], parts: int = 256) -> DataFrame:
    """Adds run_<c>: the sum of each column from the greatest score down to the row's, and the row before's as prev_<c>.

    Scores are cut at ``parts`` quantiles; a stretch is summed in its own task, and what the stretches above it hold, one
    row each, is added. So no task holds all scores."""
    cuts = g.agg(F.percentile_approx(score, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>"), lambda x: x <= F.col(score)))
    h = g.withColumn("__part", at)
    totals = h.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    above = W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(above), F.lit(0)).alias(f"__{c}") for c in cols])
    own = W.partitionBy("__part").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    j = h.join(F.broadcast(before), "__part")
    j = j.withColumns({f"run_{c}": F.sum(c).over(own) + F.col(f"__{c}") for c in cols})
    return j.withColumns({f"prev_{c}": F.col(f"run_{c}") - F.col(c) for c in cols}).drop("__part", *[f"__{c}" for c in cols])


def threshold_sweep(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, tp, fp, precision, recall, step) at every distinct score, greatest first; step is the recall gained there.
    Scores are counted before they are ordered, so the running sums see distinct scores, not rows."""
    g = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(score).agg(F.count_if(truth).alias("pos"), F.count("*").alias("n"))
    ensure_checkpoint_dir(df.sparkSession)
    g = g.checkpoint()  # it is read for the cuts, for the stretches above, and for the sums
    s = _running(g, score, ["pos", "n"]).crossJoin(F.broadcast(g.agg(F.nullif(F.sum("pos"), F.lit(0)).alias("positives"))))
    return s.select(
        score, F.col("run_pos").alias("tp"), (F.col("run_n") - F.col("run_pos")).alias("fp"), (F.col("run_pos") / F.col("run_n")).alias("precision"),
        (F.col("run_pos") / F.col("positives")).alias("recall"), (F.col("pos") / F.col("positives")).alias("step"),
    )


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    return threshold_sweep(df, truth, score).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def best_f1(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, f1) of the threshold with the greatest F1 (ties: the greater score)."""
    s = threshold_sweep(df, truth, score).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    return s.agg(F.max(F.struct("f1", score)).alias("b")).select(f"b.{score}", "b.f1")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of k of n; null for n = 0."""
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    mid, half = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d, z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) ** 2)) / d
    return mid - half, mid + half


def poisson_interval(k: int, coverage: float = 0.95) -> tuple[float, float]:
    """Exact bounds of a Poisson mean for k events: the means at which k or more, and k or fewer, have half the rest of the
    probability. Newton's method on the tail sums, whose derivative is the term at the bound."""
    import math

    rest = (1 - coverage) / 2

    def bound(n: int, below: float) -> float:
        # the mean m with P(N <= n) = below; its derivative in m is -P(N = n)
        m = n + 1.0 + (math.sqrt(n + 1.0) if below < 0.5 else -math.sqrt(n + 1.0) / 2)
        m = max(m, 0.05)
        for _ in range(100):
            term, total = math.exp(-m), math.exp(-m)
            for i in range(1, n + 1):
                term *= m / i
                total += term
            step = (total - below) / term
            new = m + max(min(step, 2 + m), -m / 2)
            if abs(new - m) <= 1e-13 * m:
                break
            m = new
        return m

    return (0.0 if k == 0 else bound(k - 1, 1 - rest)), bound(k, rest)


def sampled_stride(df: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """Every ceil(n / budget)-th row of a key in order: deterministic, unlike sample()."""
    w = W.partitionBy(*keys)
    r = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    return r.filter(F.col("__r") % F.ceil(F.col("__n") / budget) == 0).drop("__r", "__n")
