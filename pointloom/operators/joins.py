"""Joins by place, time and interval: every theta condition rides on an equality of cells or bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _offsets(dims: int, span: int = 1) -> Column:
    import itertools

    return F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product(range(-span, span + 1), repeat=dims)])


def with_cells(df: DataFrame, cols: Sequence[str], size: float) -> DataFrame:
    return df.withColumns({f"__c{i}": F.floor(F.col(c) / size).cast("bigint") for i, c in enumerate(cols)})


def radius_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], radius: float, suffix: str = "_r") -> DataFrame:
    """Pairs of one key at most ``radius`` apart; right columns other than the keys get the suffix, dist the distance.
    The smaller side should be right: it is copied to the cells around it."""
    keys, n = list(keys), len(cols)
    cells = [f"__c{i}" for i in range(n)]
    r = with_cells(right, cols, radius).withColumn("__o", F.explode(_offsets(n)))
    r = r.select(*keys, *[(F.col(c) + F.get("__o", i)).alias(c) for i, c in enumerate(cells)], *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys])
    j = with_cells(left, cols, radius).join(r, [*keys, *cells]).drop(*cells)
    d2 = sum(((F.col(c) - F.col(c + suffix)) ** 2 for c in cols[1:]), (F.col(cols[0]) - F.col(cols[0] + suffix)) ** 2)
    return j.withColumn("dist", F.sqrt(d2)).filter(F.col("dist") <= radius)


def radius_self_join(df: DataFrame, keys: Sequence[str], row_id: str, cols: Sequence[str], radius: float, suffix: str = "_r") -> DataFrame:
    """Pairs of different rows of one key at most ``radius`` apart, each once, with row_id < row_id_r; dist is the distance.
    A row meets its own cell and half of the cells around, so half the copies of ``radius_join``."""
    import itertools

    keys, n = list(keys), len(cols)
    cells = [f"__c{i}" for i in range(n)]
    half = [o for o in itertools.product((-1, 0, 1), repeat=n) if o >= (0,) * n]
    offsets = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in half]))
    own = with_cells(df, cols, radius)
    r = own.withColumn("__o", offsets).select(*keys, *[(F.col(c) + F.get("__o", i)).alias(c) for i, c in enumerate(cells)], (F.aggregate("__o", F.lit(0), lambda a, x: a + F.abs(x)) == 0).alias("__same"), *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys])
    a, b = F.col(row_id), F.col(row_id + suffix)
    j = own.join(r, [*keys, *cells]).filter(~F.col("__same") | (a < b)).drop(*cells, "__same")
    d2 = sum(((F.col(c) - F.col(c + suffix)) ** 2 for c in cols[1:]), (F.col(cols[0]) - F.col(cols[0] + suffix)) ** 2)
    j = j.withColumn("dist", F.sqrt(d2)).filter((F.col("dist") <= radius) & (a != b))
    pairs = [(c, c + suffix) for c in df.columns if c not in keys]
    ordered = [F.when(a < b, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in pairs] + [F.when(a < b, F.col(y)).otherwise(F.col(x)).alias(y) for x, y in pairs]
    return j.select(*keys, *ordered, "dist")


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], radius: float, left_id: str, right_id: str) -> DataFrame:
    """left_id, nearest right_id within the radius (ties: the smaller id) and its distance; left rows without one keep
    null."""
    pairs = radius_join(left.select(*keys, left_id, *cols), right.select(*keys, right_id, *cols), keys, cols, radius)
    rid = right_id + "_r"
    best = pairs.groupBy(left_id).agg(F.min(F.struct("dist", rid)).alias("b")).select(left_id, F.col(f"b.{rid}").alias("nearest"), F.col("b.dist").alias("dist"))
    return left.select(left_id).distinct().join(best, left_id, "left")


def k_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], radius: float, row_id: str, k: int) -> DataFrame:
    """(row_id, k, row_id_r, dist): the k nearest right rows of each left row within the radius, ties by the smaller id."""
    pairs = radius_join(left.select(*keys, row_id, *cols), right.select(*keys, row_id, *cols), keys, cols, radius)
    w = W.partitionBy(row_id).orderBy("dist", f"{row_id}_r")
    return pairs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select(row_id, "k", f"{row_id}_r", "dist")


def band_lookup(df: DataFrame, grid: DataFrame, tol: float) -> DataFrame:
    """Each row's direction cell: the grid column of its ring whose azimuth is nearest within ``tol`` degrees (ties: the
    smaller column). Three buckets of tol wide hold every candidate; rows without one keep null."""
    g = grid.withColumn("__b", F.explode(F.array(*[F.floor(F.col("az_deg") / tol) + k for k in (-1, 0, 1)])))
    hit = df.select("point_id", "ring", "azimuth_deg", F.floor(F.col("azimuth_deg") / tol).alias("__b")).join(g, ["ring", "__b"])
    off = F.abs(F.col("azimuth_deg") - F.col("az_deg"))
    best = hit.filter(off <= tol).groupBy("point_id").agg(F.min(F.struct(off.alias("o"), "col")).alias("b")).select("point_id", F.col("b.col").alias("col"))
    return df.join(best, "point_id", "left")


def grid_neighbours(cells: DataFrame, keys: Sequence[str], row: str = "ring", col: str = "col") -> DataFrame:
    """Pairs of neighbouring cells (8 around), each pair once; the later cell's columns end in _r."""
    keys = list(keys)
    after = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    left = cells.withColumn("__o", F.explode(after)).withColumns({f"{row}_r": F.col(row) + F.get("__o", 0), f"{col}_r": F.col(col) + F.get("__o", 1)}).drop("__o")
    right = cells.select(*keys, *[F.col(c).alias(c + "_r") for c in cells.columns if c not in keys])
    return left.join(right, [*keys, f"{row}_r", f"{col}_r"])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, direction: str = "backward", out: str = "matched") -> DataFrame:
    """Adds to each left row the right ``value`` (and time) last at or before its time ('backward'), first at or after
    ('forward'), or nearest (ties: backward). Both sides are laid into one ordered stream per key and the last or first
    right row is carried along: one shuffle and sort, no pair is formed. At equal times the greater value counts."""
    keys = list(keys)
    cols = left.columns
    l = left.select(*keys, F.col(left_time).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.filter(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).cast("double").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    u = l.unionByName(r)
    mark = F.when(F.col("__side") == 0, F.struct("__t", "__v"))
    back = F.last(mark, True).over(W.partitionBy(*keys).orderBy("__t", "__side", "__v").rowsBetween(W.unboundedPreceding, 0))
    # forward: the same order read from the end, right rows of the same time before left ones, the greater value first
    fore = F.last(mark, True).over(W.partitionBy(*keys).orderBy(F.desc("__t"), "__side", "__v").rowsBetween(W.unboundedPreceding, 0))
    if direction == "backward":
        u = u.withColumn("__m", back)
    elif direction == "forward":
        u = u.withColumn("__m", fore)
    else:
        u = u.withColumns({"__a": back, "__f": fore})
        da, df_ = F.col("__t") - F.col("__a.__t"), F.col("__f.__t") - F.col("__t")
        u = u.withColumn("__m", F.when(F.col("__f").isNull() | (da <= df_), F.col("__a")).otherwise(F.col("__f")))
    u = u.filter((F.col("__side") == 1))
    return u.select(*[F.col(f"__row.{c}").alias(c) for c in cols], F.col("__m.__v").alias(out), F.col("__m.__t").alias(f"{out}_time"))


def interval_join(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows with each interval of their key that holds them (both ends in). An interval lies in bins of ``width`` times the
    power of two that spans it, two at most however long it is; a row meets the bins of the powers that occur (at most
    some forty), so the join is an equality on bins of the right size."""
    keys = list(keys)
    span = F.col(end) - F.col(start) + 1
    power = F.when(span > width, F.ceil(F.log2(span / width))).otherwise(0).cast("int")
    size = lambda p: F.lit(width) * F.pow(F.lit(2.0), p)
    good = intervals.filter(F.col(start) <= F.col(end)).withColumn("__p", power)
    powers = sorted(r[0] for r in good.select("__p").distinct().collect())
    i = good.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / size("__p")), F.floor(F.col(end) / size("__p")))))
    r = rows.withColumn("__p", F.explode(F.array(*[F.lit(p) for p in powers]) if powers else F.array().cast("array<int>")))
    j = r.withColumn("__b", F.floor(F.col(at) / size("__p"))).join(i, [*keys, "__p", "__b"])
    return j.filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b", "__p")


def csr_membership(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], row: str, offset: str, count: str, frame: str) -> DataFrame:
    """The frame whose [offset, offset + count) holds each global row number; rows past the last end have none."""
    o = offsets.withColumn("__f", F.struct(frame, offset, count))
    j = asof_join(rows, o, keys, row, offset, "__f", out="m")
    inside = F.col(row) < F.col(f"m.{offset}") + F.col(f"m.{count}")
    return j.select(*rows.columns, F.when(inside, F.col(f"m.{frame}")).alias(frame))


def gated_association(tracks: DataFrame, candidates: DataFrame, keys: Sequence[str], gate: float, margin: float, size: tuple[str, float] | None = None) -> DataFrame:
    """(keys, track_id, candidate_id, dist, status): nearest candidate of each track within the gate. 'ambiguous' if the
    second nearest is within ``margin`` or two tracks want one candidate - nobody gets it then; 'unmatched' without any.
    size (column, ratio): the two sides may differ in it by that ratio at most."""
    keys = list(keys)
    pairs = radius_join(tracks, candidates, keys, ["x", "y"], gate)
    if size:
        a, b = F.col(size[0]), F.col(f"{size[0]}_r")
        pairs = pairs.filter(F.greatest(a, b) / F.least(a, b) <= size[1])
    w = W.partitionBy(*keys, "track_id").orderBy("dist", "candidate_id_r")
    near = pairs.select(*keys, "track_id", "candidate_id_r", "dist", F.row_number().over(w).alias("rn"), (F.lead("dist").over(w) - F.col("dist")).alias("lead")).filter("rn = 1")
    rivals = F.count("*").over(W.partitionBy(*keys, "candidate_id_r"))
    chosen = near.withColumn("status", F.when((F.col("lead") < margin) | (rivals > 1), "ambiguous").otherwise("matched"))
    j = tracks.select(*keys, "track_id").join(chosen, [*keys, "track_id"], "left")
    return j.select(*keys, "track_id", F.when(F.col("status") == "matched", F.col("candidate_id_r")).alias("candidate_id"), "dist", F.coalesce("status", F.lit("unmatched")).alias("status"))


def overlap_links(cells: DataFrame, keys: Sequence[str], frame: str, member: str, share: float) -> DataFrame:
    """Links of members in consecutive frames that share at least ``share`` of the smaller one's cells; split and merge
    tell members with several links. cells: keys, frame, member, cell."""
    keys = list(keys)
    c = cells.distinct()
    size = c.groupBy(*keys, frame, member).agg(F.count("*").alias("n"))
    now, past = c.alias("a"), c.withColumn(frame, F.col(frame) + 1).withColumnRenamed(member, "was")
    both = now.join(past, [*keys, frame, "cell"]).groupBy(*keys, frame, member, "was").agg(F.count("*").alias("common"))
    sized = both.join(size, [*keys, frame, member]).join(size.select(*keys, (F.col(frame) + 1).alias(frame), F.col(member).alias("was"), F.col("n").alias("was_n")), [*keys, frame, "was"])
    link = sized.withColumn("overlap", F.col("common") / F.least("n", "was_n")).filter(F.col("overlap") >= share)
    return link.withColumns({"merge": F.count("*").over(W.partitionBy(*keys, frame, member)) > 1, "split": F.count("*").over(W.partitionBy(*keys, frame, "was")) > 1})


def touching_links(cells: DataFrame, keys: Sequence[str], frame: str, member: str, share: float) -> DataFrame:
    """(keys, frame, member, was, overlap, overlapping): members of consecutive frames that have cells in common or side by
    side; overlap is the common part of the smaller one. cells: keys, frame, member, cx, cy, distinct. The earlier frame's
    cells are copied to their eight neighbours."""
    keys = list(keys)
    size = cells.groupBy(*keys, frame, member).agg(F.count("*").alias("n"))
    around = F.explode(_offsets(2))
    past = cells.withColumn("__o", around).select(*keys, (F.col(frame) + 1).alias(frame), F.col(member).alias("was"), (F.col("cx") + F.get("__o", 0)).alias("cx"), (F.col("cy") + F.get("__o", 1)).alias("cy"), ((F.get("__o", 0) == 0) & (F.get("__o", 1) == 0)).alias("__same"))
    both = cells.join(past, [*keys, frame, "cx", "cy"]).groupBy(*keys, frame, member, "was").agg(F.count_if("__same").alias("common"))
    sized = both.join(size, [*keys, frame, member]).join(size.select(*keys, (F.col(frame) + 1).alias(frame), F.col(member).alias("was"), F.col("n").alias("was_n")), [*keys, frame, "was"])
    o = F.col("common") / F.least("n", "was_n")
    return sized.select(*keys, frame, member, "was", o.alias("overlap"), (o >= share).alias("overlapping"))


def footprint_members(points: DataFrame, regions: DataFrame, owner: str, also: Column) -> DataFrame:
    """Points with each region of their owner whose footprint (x_min <= x < x_max, the same for y) holds them, if ``also``. A
    region is laid into cells as wide as the power of two that spans it, four at most, so no point meets all regions."""
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    r = regions.filter("x_min < x_max and y_min < y_max").withColumn("__p", F.ceil(F.log2(side)).cast("int"))
    powers = sorted(x[0] for x in r.select("__p").distinct().collect())
    size = F.pow(F.lit(2.0), "__p")
    span = lambda c: F.sequence(F.floor(F.col(f"{c}_min") / size), F.floor(F.col(f"{c}_max") / size))
    r = r.withColumn("__x", F.explode(span("x"))).withColumn("__y", F.explode(span("y")))
    p = points.withColumn("__p", F.explode(F.array(*[F.lit(k) for k in powers]) if powers else F.array().cast("array<int>")))
    p = p.withColumns({"__x": F.floor(F.col("x") / size), "__y": F.floor(F.col("y") / size)})
    j = p.join(r, [owner, "__p", "__x", "__y"])
    inside = (F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")) & (F.col("y") >= F.col("y_min")) & (F.col("y") < F.col("y_max"))
    return j.filter(inside & also).drop("__p", "__x", "__y")


def strict_binding(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose whole binding stands on the right; one null in it and the row is rejected."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def manifest_diff(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of what differs: added, removed or changed."""
    l, r = a.select(key, F.col(digest).alias("__a"), F.lit(1).alias("__l")), b.select(key, F.col(digest).alias("__b"), F.lit(1).alias("__r"))
    j = l.join(r, key, "full_outer")
    s = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(key, s.alias("status")).filter("status is not null")


def velocity_hypotheses(points: DataFrame, keys: Sequence[str], frame: str, pid: str, lo: float, hi: float) -> DataFrame:
    """Pairs of points in consecutive frames whose step is within [lo, hi] metres: candidates of a motion."""
    past = points.withColumn(frame, F.col(frame) + 1)
    j = radius_join(points.select(*keys, frame, pid, "x", "y"), past.select(*keys, frame, pid, "x", "y"), [*keys, frame], ["x", "y"], hi)
    return j.filter(F.col("dist") >= lo)


def set_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], bound: float) -> DataFrame:
    """Per key the smallest distance between two point sets, if at most ``bound``."""
    return radius_join(a.select(*keys, "x", "y", "z"), b.select(*keys, "x", "y", "z"), keys, ["x", "y", "z"], bound).groupBy(*keys).agg(F.min("dist").alias("gap"))
