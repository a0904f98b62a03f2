"""Predicates and classifications of point rows, planes, components and records. Unknown stays null, never false."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The eight and twenty-six neighbours of a cell.
NEAR_2D = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
NEAR_3D = [(a, b, c) for a, b in NEAR_2D for c in (-1, 0, 1)]


def finite(c: str | Column) -> Column:
    """Not null, not NaN, not infinite; NaN sorts above all numbers, so two comparisons do."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False))


def valid_row(max_range: float | None = None) -> Column:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    ok = finite("x") & finite("y") & finite("z") & ~((x == 0) & (y == 0) & (z == 0))
    return ok & (x * x + y * y + z * z <= max_range * max_range) if max_range else ok


def rejection_class(rings: int, near: float = 0.1) -> Column:
    """One of nonfinite, zero_or_near, bad_ring, accepted for every row; duplicates are told apart afterwards."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return (
        F.when(~(finite("x") & finite("y") & finite("z")), "nonfinite")
        .when(x * x + y * y + z * z < near * near, "zero_or_near")
        .when(F.col("ring").isNull() | (F.col("ring") < 0) | (F.col("ring") >= rings), "bad_ring")
        .otherwise("accepted")
    )


def classify_returns(df: DataFrame, rings: int = 192, columns: int = 256) -> DataFrame:
    """Every row with its class: rejected ones by reason, then per frame and direction cell the nearest return is
    'accepted' and the rest 'duplicate' (ties: the smaller source_row, then point_id)."""
    az = F.floor((F.degrees(F.atan2("y", "x")) + 180.0) / (360.0 / columns)).cast("int")
    dist = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    base = df.withColumn("class", rejection_class(rings)).withColumn("az_cell", F.when(F.col("class") == "accepted", az))
    w = W.partitionBy("session_id", "frame_index", "ring", "az_cell").orderBy(dist, "source_row", "point_id")
    kept = base.filter("class = 'accepted'").withColumn("class", F.when(F.row_number().over(w) > 1, "duplicate").otherwise("accepted"))
    return kept.unionByName(base.filter("class <> 'accepted'"))


def roi(radius: float, low: float, high: float, height: Column | None = None) -> Column:
    """Within a circle around the sensor and a band of heights; a missing height keeps the row."""
    h = height if height is not None else F.col("z")
    return (F.hypot("x", "y") <= radius) & F.coalesce((h >= low) & (h <= high), F.lit(True))


def cylinder(cx: float, cy: float, radius: float, low: float, high: float) -> Column:
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return (dx * dx + dy * dy <= radius * radius) & F.col("z").between(low, high)


def region_code(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds region: the largest zone_id of the row's sensor whose half-open box holds it, else null. Points are located in
    the regions' slabs, so no point meets all regions of its sensor."""
    from .spatial import zone_of_points

    hit = zone_of_points(df.sparkSession, df, regions).select(F.col("key_a").alias("point_id"), F.col("key_b").alias("region"))
    return df.join(hit, "point_id", "left")


def oriented_box(center: Sequence[float], axes: Sequence[Sequence[float]], half: Sequence[float], margin: float = 0.0) -> Column:
    d = [F.col(c) - float(v) for c, v in zip("xyz", center)]
    ok = F.lit(True)
    for axis, h in zip(axes, half):
        ok = ok & (F.abs(d[0] * float(axis[0]) + d[1] * float(axis[1]) + d[2] * float(axis[2])) <= h + margin)
    return ok


def gate_reasons(gates: dict[str, Column]) -> Column:
    """Names of the gates that fail; one that is unknown fails with ':unknown'."""
    named = [F.when(ok.isNull(), F.lit(f"{n}:unknown")).when(~ok, F.lit(n)) for n, ok in gates.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def geometry_class(n: Column, height: Column, extent: Column, low: Column) -> Column:
    """fragment, planar, lying, standing, sitting, other or unknown; the first that fits."""
    return (
        F.when(n.isNull() | height.isNull() | extent.isNull(), "unknown")
        .when(n < 8, "fragment")
        .when((height < 0.08) & (extent > 0.4), "planar")
        .when((height < 0.5) & (extent >= 0.9) & (low < 0.4), "lying")
        .when((height >= 1.1) & (extent < 1.2), "standing")
        .when((height >= 0.6) & (height < 1.1), "sitting")
        .otherwise("other")
    )


def foreground(residual: Column, sigma: Column, known: Column) -> Column:
    """Off the background by more than 4 cm and 4 deviations; null where the background is unknown."""
    return F.when(known, F.abs(residual) > F.greatest(F.lit(0.04), 4 * sigma))


def sticky_quality(df: DataFrame, key: Sequence[str], order: str, valid: Column, changed: Column) -> DataFrame:
    """Adds quality: 'insufficient' with under 60 % valid cells, else 'invalid' from the first frame on in which over
    35 % changed, else 'ok'."""
    broken = F.when((valid >= 0.6) & (changed > 0.35), 1).otherwise(0)
    ever = F.max(broken).over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("quality", F.when(ever == 1, "invalid").when(valid < 0.6, "insufficient").otherwise("ok"))


def _voxels(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    return df.withColumns({f"c{c}": F.floor(F.col(c) / size).cast("bigint") for c in "xyz"})


def voxel_counts(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """(keys, cx, cy, cz, n, support): points of each voxel, and of it and its 26 neighbours together. The sum over the
    neighbourhood is taken axis by axis, three copies of a voxel each, instead of 27 at once."""
    keys, cells = list(keys), ["cx", "cy", "cz"]
    n = _voxels(df, keys, size).groupBy(*keys, *cells).agg(F.count("*").alias("n"))
    total = n.withColumn("support", F.col("n"))
    for c in cells:
        # n stays with the voxel itself, support goes to both sides too
        here = F.explode(F.array(*[F.struct((F.col(c) + k).alias("at"), (F.col("n") if k == 0 else F.lit(None).cast("bigint")).alias("n")) for k in (-1, 0, 1)]))
        around = total.withColumn("o", here).select(*keys, *[F.col("o.at").alias(c) if x == c else x for x in cells], "support", F.col("o.n").alias("n"))
        total = around.groupBy(*keys, *cells).agg(F.sum("support").alias("support"), F.max("n").alias("n"))
    return total.filter("n is not null")


def voxel_support(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Adds support: the points in a row's voxel and its 26 neighbours, itself included. The join carries voxels, not
    points."""
    keys, cells = list(keys), ["cx", "cy", "cz"]
    return _voxels(df, keys, size).join(voxel_counts(df, keys, size).drop("n"), [*keys, *cells], "left").drop(*cells)


def grid_support(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds supported: how many of a cell's 8 neighbours (ring, col) are at a like range: |a - b| <= max(0.05, 0.012
    min(a, b)); edge: some neighbour jumps by over 0.2. Each cell tells its range to the eight around it, so one aggregate
    of nine numbers a cell does it, without a join. Other columns of the cells are left out."""
    keys = list(keys)
    told = F.explode(F.array(*[F.struct((F.col("ring") + a).alias("ring"), (F.col("col") + b).alias("col"), F.lit(k).alias("k")) for k, (a, b) in enumerate(NEAR_2D)]))
    around = cells.select(*keys, told.alias("c"), "range_m").select(*keys, "c.*", "range_m")
    got = around.groupBy(*keys, "ring", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("range_m"))).alias(f"__r{k}") for k in range(9)])
    own = F.col("__r4")
    gaps = [(F.abs(own - F.col(f"__r{k}")), F.greatest(F.lit(0.05), 0.012 * F.least(own, F.col(f"__r{k}"))), F.col(f"__r{k}")) for k in range(9) if k != 4]
    yes = lambda c: F.coalesce(c, F.lit(False))
    like = sum((yes((g <= lim) & o.isNotNull()).cast("bigint") for g, lim, o in gaps), F.lit(0).cast("bigint"))
    edge = F.lit(False)
    for g, _, _ in gaps:
        edge = edge | yes(g > 0.2)
    return got.filter(own.isNotNull()).select(*keys, "ring", "col", own.alias("range_m"), like.alias("supported"), edge.alias("edge"))


def dynamic_points(df: DataFrame, keys: Sequence[str], frame: str, radius: float) -> DataFrame:
    """Points with no point of the same ring within ``radius`` of range in the frame before (anti join on range bins)."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    keys = list(keys)
    now = df.withColumn("range_m", r).withColumn("bin", F.floor(F.col("range_m") / radius))
    past = now.select(*keys, (F.col(frame) + 1).alias(frame), "ring", F.col("range_m").alias("past_m"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    close = now.join(past, [*keys, frame, "ring", "bin"]).filter(F.abs(F.col("range_m") - F.col("past_m")) <= radius).select("point_id").distinct()
    return now.join(close, "point_id", "left_anti").drop("bin")


def posture_of(top: Column, extent: Column, verticality: Column) -> Column:
    """lying, standing, sitting, vertical_surface or unknown in this order; null if any measure is missing."""
    return F.when(
        top.isNotNull() & extent.isNotNull() & verticality.isNotNull(),
        F.when((top < 0.6) & (verticality < 0.5), "lying")
        .when((top >= 1.2) & (verticality >= 0.6), "standing")
        .when((top >= 0.6) & (top < 1.2), "sitting")
        .when(extent > 1.5, "vertical_surface")
        .otherwise("unknown"),
    )


def low_class(height: Column, measured: Column, threshold: float) -> Column:
    """low, upright or unavailable; what wasn't measured is never upright."""
    return F.when(F.coalesce(measured, F.lit(False)) & finite(height), F.when(height <= threshold, "low").otherwise("upright")).otherwise("unavailable")
