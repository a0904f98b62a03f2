"""Gates, directions, gaps and summaries that tell why: every outcome comes with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import bind
from .filters import NEAR_3D, finite


def direction_lookup(df: DataFrame, grid: DataFrame, tol_az: float, tol_el: float, row_id: str = "point_id") -> DataFrame:
    """Adds col: the grid direction of the row's ring within both tolerances, the nearest in azimuth (ties: the smaller
    column), or null. grid: (ring, col, az_deg, el_deg). Three buckets of the azimuth tolerance hold every candidate, so
    no nearer one is missed however the directions lie. df needs ring, azimuth_deg and elevation_deg."""
    g = grid.select(F.col("ring").alias("__ring"), "col", "az_deg", "el_deg", F.explode(F.array(*[F.floor(F.col("az_deg") / tol_az) + k for k in (-1, 0, 1)])).alias("__b"))
    slim = df.select(row_id, "ring", "azimuth_deg", "elevation_deg", F.floor(F.col("azimuth_deg") / tol_az).alias("__b"))
    off = F.abs(F.col("azimuth_deg") - F.col("az_deg"))
    hit = slim.join(g, (F.col("ring") == F.col("__ring")) & (slim["__b"] == g["__b"])).filter((off <= tol_az) & (F.abs(F.col("elevation_deg") - F.col("el_deg")) <= tol_el))
    best = hit.groupBy(row_id).agg(F.min(F.struct(off.alias("o"), "col")).alias("b")).select(row_id, F.col("b.col").alias("col"))
    return df.join(best, row_id, "left")


def account_returns(df: DataFrame, grid: DataFrame, frame: Sequence[str], rings: int, tol_az: float, tol_el: float, near: float = 0.1) -> DataFrame:
    """Adds class to every row: nonfinite, zero_or_near, bad_ring, unknown_direction, duplicate (beaten in its frame's
    direction by a nearer return; ties: the smaller source_row, then point_id) or accepted."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    dist = F.sqrt(x * x + y * y + z * z)
    early = F.when(~(finite("x") & finite("y") & finite("z")), "nonfinite").when(dist <= near, "zero_or_near").when(F.col("ring").isNull() | (F.col("ring") < 0) | (F.col("ring") >= rings), "bad_ring")
    base = df.withColumns({"class": early, "range_m": dist, "azimuth_deg": F.degrees(F.atan2("y", "x")), "elevation_deg": F.degrees(F.atan2(z, F.hypot("x", "y")))})
    seen = direction_lookup(base.filter("class is null").drop("class"), grid, tol_az, tol_el)
    w = W.partitionBy(*frame, "ring", "col").orderBy("range_m", "source_row", "point_id")
    known = seen.filter("col is not null").withColumn("class", F.when(F.row_number().over(w) > 1, "duplicate").otherwise("accepted"))
    lost = seen.filter("col is null").withColumn("class", F.lit("unknown_direction"))
    gone = base.filter("class is not null").withColumn("col", F.lit(None).cast(seen.schema["col"].dataType))
    return known.unionByName(lost).unionByName(gone)


def boundary_gaps(cells: DataFrame, keys: Sequence[str], label: str, base: float, share: float) -> DataFrame:
    """(keys, label_a, label_b, gap): least distance between measured points of two labels in grid cells at most two apart,
    where it is within max(base, share * the nearer range). cells: keys, ring, col, label, range_m, x, y, z."""
    keys = list(keys)
    after = [(0, 1), (0, 2)] + [(a, b) for a in (1, 2) for b in range(-2, 3)]
    offsets = F.explode(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in after]))
    cols = ["ring", "col", label, "range_m", "x", "y", "z"]
    left = cells.select(*keys, *cols).withColumn("__o", offsets).withColumns({"__r": F.col("ring") + F.get("__o", 0), "__c": F.col("col") + F.get("__o", 1)})
    right = cells.select(*keys, *[F.col(c).alias("__r" if c == "ring" else "__c" if c == "col" else f"{c}_r") for c in cols])
    d2 = sum(((F.col(c) - F.col(f"{c}_r")) ** 2 for c in "yz"), (F.col("x") - F.col("x_r")) ** 2)
    j = left.join(right, [*keys, "__r", "__c"]).filter(F.col(label) != F.col(f"{label}_r")).withColumn("gap", F.sqrt(d2))
    j = j.filter(F.col("gap") <= F.greatest(F.lit(base), share * F.least("range_m", "range_m_r")))
    a, b = F.col(label), F.col(f"{label}_r")
    return j.groupBy(*keys, F.least(a, b).alias("label_a"), F.greatest(a, b).alias("label_b")).agg(F.min("gap").alias("gap"))


def exact_set_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], sample: int = 48) -> DataFrame:
    """(keys, gap): the least distance between two point sets of each key, however far apart. ``sample`` points of each side
    give an upper bound; cells of that size then hold every nearer pair, and only neighbouring cells meet."""
    keys = list(keys)
    xyz = F.struct("x", "y", "z")
    # one point of each of ``sample`` hash classes: at most so many a key, by partial aggregates
    some = lambda df, name: df.groupBy(*keys, F.pmod(F.xxhash64("x", "y", "z"), F.lit(sample)).alias("__k")).agg(F.min(xyz).alias("__p")).groupBy(*keys).agg(F.collect_list("__p").alias(name))
    far = lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2)
    most = some(a, "pa").join(some(b, "pb"), keys).select(*keys, F.array_min(F.transform("pa", lambda p: F.array_min(F.transform("pb", lambda q: far(p, q))))).alias("bound"))
    size = F.greatest(F.col("bound"), F.lit(1e-6))
    cells = [F.floor(F.col(c) / size).cast("bigint").alias(f"__{c}") for c in "xyz"]
    around = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in NEAR_3D]))
    left = a.join(most, keys).select(*keys, *cells, xyz.alias("p"))
    right = b.join(most, keys).select(*keys, *cells, xyz.alias("q")).withColumn("__o", around)
    right = right.select(*keys, *[(F.col(f"__{c}") + F.get("__o", k)).alias(f"__{c}") for k, c in enumerate("xyz")], "q")
    near = left.join(right, [*keys, "__x", "__y", "__z"]).groupBy(*keys).agg(F.min(far(F.col("p"), F.col("q"))).alias("near"))
    return most.join(near, keys, "left").select(*keys, F.least("bound", F.coalesce("near", "bound")).alias("gap"))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, samples, min, p05, median, p95, max) of the values that are there; NaN or an infinity is an error."""
    v = F.col(value)
    bad = v.isNotNull() & ~finite(v)
    checked = F.when(bad, F.raise_error(F.lit(f"{value} is not finite")).cast("double")).otherwise(v)
    p = F.percentile(checked, [0.05, 0.5, 0.95])
    g = df.groupBy(*keys).agg(F.count(value).alias("samples"), F.min(checked).alias("min"), p.alias("p"), F.max(checked).alias("max"))
    return g.select(*keys, "samples", "min", F.get("p", 0).alias("p05"), F.get("p", 1).alias("median"), F.get("p", 2).alias("p95"), "max")


def class_scores(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1, macro_f1, accuracy) of several classes; rows without either are left out.
    macro_f1 is the plain mean over the classes, a class never hit counting 0."""
    m = df.filter(F.col(truth).isNotNull() & F.col(said).isNotNull()).groupBy(truth, said).agg(F.count("*").alias("n"))
    sides = m.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("s")), F.struct(F.col(said).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("s")))).alias("e"), "n", (F.col(truth) == F.col(said)).alias("hit"))
    g = sides.groupBy(F.col("e.c").alias("class")).agg(F.sum(F.when(F.col("hit"), F.col("n") * F.col("e.t")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("e.t")).alias("t"), F.sum(F.col("n") * F.col("e.s")).alias("s"))
    tp = F.col("tp")
    g = g.withColumns({"fp": F.col("s") - tp, "fn": F.col("t") - tp, "precision": tp / F.nullif("s", F.lit(0)), "recall": tp / F.nullif("t", F.lit(0)), "f1": 2 * tp / F.nullif(F.col("s") + F.col("t"), F.lit(0))})
    every = g.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"), (F.sum("tp") / F.nullif(F.sum("t"), F.lit(0))).alias("accuracy"))
    return g.crossJoin(F.broadcast(every)).drop("s", "t")


def digest_number(c: Column) -> Column:
    """A number from a text's MD5 that adds up: the sum over rows is a digest of a set that needs no order."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def admission(df: DataFrame, keys: Sequence[str], order: str, time: str, upright: Column, low: Column, usable: Column, max_gap: float) -> DataFrame:
    """(keys, verdict) of each track: does it go from upright to low in one unbroken run?

    OK: an upright row, then rows between, then a low one, in a run without an unusable row or a gap over ``max_gap``
    seconds; TOO_SHORT: the same without a row between; EVENT_IN_GAP: upright and later low, never in one run; NEVER_LOW:
    no low row after an upright one; NEVER_UPRIGHT, NO_VALID_FRAME: none at all."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumns({"__ok": F.coalesce(usable, F.lit(False)), "__up": F.coalesce(upright & usable, F.lit(False)), "__low": F.coalesce(low & usable, F.lit(False))})
    step = F.col(time) - F.lag(time).over(w)
    cut = ~F.col("__ok") | ~F.coalesce(F.lag("__ok").over(w), F.lit(False)) | ~F.coalesce((step > 0) & (step <= max_gap), F.lit(False))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__run", F.sum(cut.cast("int")).over(upto))
    in_run = W.partitionBy(*keys, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__leg", F.sum(F.col("__up").cast("int")).over(in_run)).withColumn("__before", F.max("__up").over(upto))
    since = W.partitionBy(*keys, "__run", "__leg").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    between = F.max(F.col("__ok") & ~F.col("__up") & ~F.col("__low")).over(since)
    d = d.withColumn("__mid", between)
    went = F.col("__low") & (F.col("__leg") > 0)
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    g = d.groupBy(*keys).agg(any_("__ok").alias("ok"), any_("__up").alias("up"), any_(F.col("__low") & F.col("__before")).alias("later"), any_(went).alias("went"), any_(went & F.col("__mid")).alias("mid"))
    v = F.when(~F.col("ok"), "NO_VALID_FRAME").when(~F.col("up"), "NEVER_UPRIGHT").when(~F.col("later"), "NEVER_LOW").when(F.col("mid"), "OK").when(F.col("went"), "TOO_SHORT").otherwise("EVENT_IN_GAP")
    return g.select(*keys, v.alias("verdict"))


def timed_latch(df: DataFrame, keys: Sequence[str], order: str, time: str, value: Column, high: float, low: float, seconds: float) -> DataFrame:
    """Adds latched: set once ``value`` has been at least ``high`` for ``seconds`` on end, released by as long at most
    ``low``; between the two, and where it is missing, it stays."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(order)
    side = F.when(value >= high, 1).when(value <= low, -1).otherwise(0)
    d = df.withColumn("__s", side)
    d = d.withColumn("__new", (~F.col("__s").eqNullSafe(F.lag("__s").over(w))).cast("int"))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    held = F.col(time) - F.min(time).over(W.partitionBy(*keys, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__d", F.when((F.col("__s") != 0) & (held >= seconds), F.col("__s") > 0))
    return d.withColumn("latched", F.coalesce(F.last("__d", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(False))).drop("__s", "__new", "__run", "__d")


def motion_evidence(df: DataFrame, keys: Sequence[str], time: str, window_s: float, least_m: float) -> DataFrame:
    """Adds net_m, progress (net over path), moved, direct and consistent over the last ``window_s`` seconds: moved has
    gone ``least_m`` in 0.18 s or more, direct also has progress of 0.7, consistent also keeps its direction (cosine of
    0.7) from the window's first half to its second, over 0.5 s or more. df: keys, time, x, y."""
    span = W.partitionBy(*keys).orderBy(F.round(F.col(time) * 1000).cast("bigint")).rangeBetween(-round(window_s * 1000), 0)
    d = df.withColumn("__h", F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), "x", "y")).over(span)))
    h = F.col("__h")
    first, last = F.get(h, 0), F.element_at(h, -1)
    gone = lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    path = F.aggregate(F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), gone), F.lit(0.0), lambda s, v: s + v)
    half = (first["t"] + last["t"]) / 2
    mid = F.array_min(F.transform(h, lambda p: F.struct(F.abs(p["t"] - half).alias("o"), p["t"].alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    d = d.withColumns({"net_m": gone(first, last), "__path": path, "__mid": mid, "__t": last["t"] - first["t"]})
    d = d.withColumn("progress", F.when(F.col("__path") > 0, F.col("net_m") / F.col("__path")).otherwise(0.0))
    ax, ay, bx, by = F.col("__mid.x") - first["x"], F.col("__mid.y") - first["y"], last["x"] - F.col("__mid.x"), last["y"] - F.col("__mid.y")
    norms = F.hypot(ax, ay) * F.hypot(bx, by)
    moved = (F.size(h) >= 2) & (F.col("__t") >= 0.18) & (F.col("net_m") >= least_m)
    direct = moved & (F.col("progress") >= 0.7)
    same = F.coalesce((ax * bx + ay * by) / F.nullif(norms, F.lit(0.0)) >= 0.7, F.lit(False))
    d = d.withColumns({"moved": moved, "direct": direct, "consistent": direct & (F.col("__t") >= 0.5 - 1e-6) & same})
    return d.drop("__h", "__path", "__mid", "__t")


class KeepChoice:
    """Step that keeps the item chosen before while its score is at least ``ratio`` of the best one's."""

    def __init__(self, ratio: float):
        self.ratio = ratio

    def __call__(self, state, items, scores):
        items, scores = list(items) if items is not None else [], list(scores) if scores is not None else []
        if not items:
            return state, (None, False)
        keep = state in items and scores[items.index(state)] >= self.ratio * scores[0]
        chosen = state if keep else items[0]
        return chosen, (chosen, keep)


def oversample(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Rows with copy (0, 1, ...): every class is repeated to the size of the largest, whole rounds first, the rest by the
    digest of row_id, so the result is the same anywhere. Rows without a label are left out."""
    d = df.filter(F.col(label).isNotNull())
    n = d.groupBy(label).agg(F.count("*").alias("__n"))
    most = n.agg(F.max("__n").alias("__m"))
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.col(row_id).cast("string")), row_id))
    j = d.withColumn("__r", rank).join(F.broadcast(n.crossJoin(most)), label)
    times = F.floor(F.col("__m") / F.col("__n")) + (F.col("__r") <= F.col("__m") % F.col("__n")).cast("int")
    return j.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).drop("__n", "__m", "__r")


def agreement(levels: Sequence[Column], names: Sequence[str], confidence: Sequence[Column], cap: float, good: float, least: float) -> Column:
    """Consensus of three estimates from the levels of their pairs (0-1, 0-2, 1-2; GOOD, DEGRADED, CONFLICT or null): a struct
    of status, support (names of the one maximal clique) and confidence (the least of it, capped when degraded).

    GOOD if all pairs are; DEGRADED if exactly one maximal clique of agreeing estimates stands; else BAD. Too little
    confidence lowers the status."""
    ok = [F.coalesce(l.isin("GOOD", "DEGRADED"), F.lit(False)) for l in levels]
    pairs = [(0, 1), (0, 2), (1, 2)]
    all_good = levels[0].eqNullSafe("GOOD") & levels[1].eqNullSafe("GOOD") & levels[2].eqNullSafe("GOOD")
    triple = ok[0] & ok[1] & ok[2]
    only = [ok[k] & ~ok[(k + 1) % 3] & ~ok[(k + 2) % 3] for k in range(3)]
    support = F.when(triple, F.array(*[F.lit(n) for n in names]))
    sure = F.when(triple, F.least(*confidence))
    for k, (a, b) in enumerate(pairs):
        support = support.when(only[k], F.array(F.lit(names[a]), F.lit(names[b])))
        sure = sure.when(only[k], F.least(confidence[a], confidence[b]))
    first = F.when(all_good, "GOOD").when(support.isNotNull(), "DEGRADED").otherwise("BAD")

    def lowered(s: Column) -> Column:
        status = F.when((s["status"] == "GOOD") & (s["sure"] < good), "DEGRADED").otherwise(s["status"])
        status = F.when((status == "DEGRADED") & (s["sure"] < least), "BAD").otherwise(status)
        return bind(
            F.struct(status.alias("status"), s["support"].alias("support"), s["sure"].alias("sure")),
            lambda t: F.struct(
                t["status"].alias("status"), F.when(t["status"] != "BAD", t["support"]).alias("support"),
                F.when(t["status"] == "GOOD", t["sure"]).when(t["status"] == "DEGRADED", F.least(t["sure"], F.lit(cap))).otherwise(0.0).alias("confidence"),
            ),
        )

    return bind(F.struct(first.alias("status"), support.alias("support"), F.coalesce(sure, F.lit(0.0)).alias("sure")), lowered)


def envelope_reason(now: DataFrame, envelope: DataFrame, keys: Sequence[str], tau: Column, near: float, occupied: int, support: int, row_id: str = "point_id") -> DataFrame:
    """Adds reason to each point: occupied (its own voxel holds ``occupied`` points or more), near_centroid (one of 27
    centroids within ``near``), adaptive (a centroid of ``support`` points within ``tau``) or new. Envelope voxels are
    copied to their neighbours, points are not. now: cx, cy, cz, x, y, z; envelope: the same and n."""
    keys = list(keys)
    offsets = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in NEAR_3D]))
    e = envelope.withColumn("__o", offsets).select(*keys, *[(F.col(f"c{c}") + F.get("__o", k)).alias(f"c{c}") for k, c in enumerate("xyz")], (F.aggregate("__o", F.lit(0), lambda s, v: s + F.abs(v)) == 0).alias("__own"), *[F.col(c).alias(f"e{c}") for c in "xyz"], F.col("n").alias("en"))
    packed = e.groupBy(*keys, "cx", "cy", "cz").agg(F.collect_list(F.struct("__own", "ex", "ey", "ez", "en")).alias("around"))
    j = now.withColumn("__tau", tau).join(packed, [*keys, "cx", "cy", "cz"], "left")
    d2 = lambda v: (F.col("x") - v["ex"]) ** 2 + (F.col("y") - v["ey"]) ** 2 + (F.col("z") - v["ez"]) ** 2
    a = F.coalesce("around", F.array().cast(packed.schema["around"].dataType))
    reason = (
        F.when(F.exists(a, lambda v: v["__own"] & (v["en"] >= occupied)), "occupied")
        .when(F.exists(a, lambda v: d2(v) <= near * near), "near_centroid")
        .when(F.exists(a, lambda v: (v["en"] >= support) & (d2(v) <= F.col("__tau") ** 2)), "adaptive")
        .otherwise("new")
    )
    return j.withColumn("reason", reason).drop("around", "__tau")


def first_failing(gates: Sequence[tuple[str, Column]], passed: str) -> Column:
    """Name of the first gate whose condition holds (null counts as not holding), else ``passed``."""
    out = F.when(F.coalesce(gates[0][1], F.lit(False)), gates[0][0])
    for name, fails in gates[1:]:
        out = out.when(F.coalesce(fails, F.lit(False)), name)
    return out.otherwise(passed)


def suspended(df: DataFrame, keys: Sequence[str], region: str, residual: str, least: int, tol: float, need: int) -> DataFrame:
    """(keys, passed, seen, trusted, height_m): a region passes with ``least`` rows whose median absolute residual is within
    ``tol``; the median height is given only where ``need`` regions pass, never refitted."""
    keys = list(keys)
    r = df.groupBy(*keys, region).agg(F.count("*").alias("n"), F.percentile(F.abs(residual), 0.5).alias("m"))
    s = r.groupBy(*keys).agg(F.count_if((F.col("n") >= least) & (F.col("m") <= tol)).alias("passed"), F.count("*").alias("seen"))
    h = df.groupBy(*keys).agg(F.percentile(residual, 0.5).alias("h"))
    j = s.join(h, keys).withColumn("trusted", F.col("passed") >= need)
    return j.select(*keys, "passed", "seen", "trusted", F.when(F.col("trusted"), F.col("h")).alias("height_m"))


def all_finite(values: Column, size: int) -> Column:
    """Whether an array has ``size`` values, all there and finite."""
    return (F.size(values) == size) & F.coalesce(F.forall(values, lambda v: finite(v)), F.lit(False))
