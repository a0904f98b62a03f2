"""Scalar geometry on point, plane and frame rows: pure column expressions, all inside whole-stage code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import valid_row


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def with_polar(df: DataFrame) -> DataFrame:
    """Adds range_m, azimuth_deg and elevation_deg of x, y, z."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return df.withColumns(
        {"range_m": F.sqrt(x * x + y * y + z * z), "azimuth_deg": F.degrees(F.atan2(y, x)), "elevation_deg": F.degrees(F.atan2(z, F.hypot(x, y)))}
    )


def declared_plane(df: DataFrame) -> DataFrame:
    """sensor_id, nx, ny, nz, d of a plane given by pitch_deg, roll_deg and height_m: the unit normal in the sensor's
    frame and the offset, so that height = n . p + d."""
    p, r = F.radians("pitch_deg"), F.radians("roll_deg")
    return df.select("sensor_id", (-F.sin(p) * F.cos(r)).alias("nx"), F.sin(r).alias("ny"), (F.cos(p) * F.cos(r)).alias("nz"), F.col("height_m").alias("d"))


def plane_height(nx="nx", ny="ny", nz="nz", d="d") -> Column:
    """Signed distance n . p + d."""
    return _c(nx) * F.col("x") + _c(ny) * F.col("y") + _c(nz) * F.col("z") + _c(d)


def rotation(pitch: Column, roll: Column) -> list[list[Column]]:
    """Rx(roll) . Ry(pitch) as nine expressions."""
    sp, cp, sr, cr = F.sin(pitch), F.cos(pitch), F.sin(roll), F.cos(roll)
    return [[cp, F.lit(0.0), sp], [sr * sp, cr, -sr * cp], [-cr * sp, sr, cr * cp]]


def rigid_transform(df: DataFrame, r: Sequence[Sequence], t: Sequence, inverse: bool = False) -> DataFrame:
    """x, y, z mapped by R p + t (or R' (p - t)); rows that are null, not finite or all zero pass unchanged and carry
    mapped = false."""
    xyz, t = [F.col(c) for c in "xyz"], [_c(v) for v in t]
    m = [[_c(v) for v in row] for row in r]
    if inverse:
        moved = [p - s for p, s in zip(xyz, t)]
        new = [sum((m[j][i] * moved[j] for j in (1, 2)), m[0][i] * moved[0]) for i in range(3)]
    else:
        new = [sum((m[i][j] * xyz[j] for j in (1, 2)), m[i][0] * xyz[0]) + t[i] for i in range(3)]
    ok = F.coalesce(valid_row(), F.lit(False))
    df = df.withColumn("mapped", ok)
    return df.withColumns({c: F.when(ok, n).otherwise(F.col(c)) for c, n in zip("xyz", new)})


def clip(c: Column, lo: float, hi: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def pitch_roll(nx="nx", ny="ny", nz="nz") -> tuple[Column, Column]:
    """Degrees of pitch and roll of a unit normal."""
    return F.degrees(F.atan2(-_c(nx), _c(nz))), F.degrees(F.asin(clip(_c(ny), -1, 1)))


def canonical_plane(df: DataFrame, min_up: float = 1e-6) -> DataFrame:
    """nx, ny, nz, d at unit length and with nz > 0; a plane without length or with no clear up is null, with a reason."""
    n = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    sign = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    reason = F.when(n.isNull() | (n <= 0) | F.isnan(n), "no_length").when(F.abs(F.col("nz") / n) < min_up, "no_up")
    cols = {c: F.when(reason.isNull(), sign * F.col(c) / n) for c in ("nx", "ny", "nz", "d")}
    return df.withColumns({**cols, "reason": reason})


def plane_angle(a: Sequence, b: Sequence) -> Column:
    """Degrees between two unit normals, whatever their sign."""
    dot = sum((_c(x) * _c(y) for x, y in zip(a[1:], b[1:])), _c(a[0]) * _c(b[0]))
    return F.degrees(F.acos(clip(F.abs(dot), 0, 1)))


def tangent_basis(nx="nx", ny="ny", nz="nz") -> dict[str, Column]:
    """u (x axis laid into the plane) and v = n x u, unit and orthogonal; a normal along x takes the y axis."""
    nx, ny, nz = _c(nx), _c(ny), _c(nz)
    flat = F.abs(nx) > 0.9
    ax, ay = F.when(flat, 0.0).otherwise(1.0), F.when(flat, 1.0).otherwise(0.0)
    dot = ax * nx + ay * ny
    ux, uy, uz = ax - dot * nx, ay - dot * ny, -dot * nz
    n = F.sqrt(ux * ux + uy * uy + uz * uz)
    ux, uy, uz = ux / n, uy / n, uz / n
    return {"ux": ux, "uy": uy, "uz": uz, "vx": ny * uz - nz * uy, "vy": nz * ux - nx * uz, "vz": nx * uy - ny * ux}


def cell(c: str | Column, size: float) -> Column:
    """Index of the cell that holds a coordinate, for negative ones too."""
    return F.floor(_c(c) / size).cast("bigint")


def packed_cell(size: float, span: int = 1 << 20) -> Column:
    """One key of the three cell indices (each within +-span / 2)."""
    half = span // 2
    return ((cell("x", size) + half) * span + cell("y", size) + half) * span + cell("z", size) + half


def range_band(dist: Column, width: float = 4.0, most: int = 2) -> Column:
    return F.least(F.floor(dist / width), F.lit(most)).cast("int")


def adaptive_threshold(dist: Column, base: float, slope: float, lo: float, hi: float) -> Column:
    return clip(base + slope * dist, lo, hi)


def ramp(c: Column, at0: float, at1: float) -> Column:
    """0 at at0, 1 at at1, linear between and flat outside; works upward and downward."""
    return clip((c - at0) / (at1 - at0), 0, 1)


def bins(c: Column, edges: Sequence[float], missing: int = -1) -> Column:
    """Number of edges not above the value; ``missing`` for null and NaN."""
    out = F.when(c.isNull() | F.isnan(c), missing)
    n = sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:]), F.when(c >= edges[0], 1).otherwise(0))
    return out.otherwise(n)


def decayed(f: Column, dt: Column, tau: float) -> Column:
    return f * F.exp(-dt / tau)


def decayed_linear(f: Column, dt: Column, tau: float) -> Column:
    return F.greatest(F.lit(0.0), f - dt / tau)


def heat_rgb(f: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a heat between 0 and 1."""
    t = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(t), 0.85 * t * t, 0.55 * t * t * t


def weighted_score(parts: Sequence[tuple[float, Column]]) -> Column:
    """Sum of weighted ramps; a missing one adds nothing."""
    return sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts[1:]), parts[0][0] * F.coalesce(parts[0][1], F.lit(0.0)))


def shape_scalars() -> dict[str, tuple[Column, int]]:
    """Ratios of a block of cells (cells, rows_, cols_, med, r2, sx, sy, sz), each with the digits it is good for."""
    n, area = F.col("cells"), F.col("sx") * F.col("sy")
    return {
        "fill_ratio": (n / (F.col("rows_") * F.col("cols_")), 6), "aspect": (F.col("cols_") / F.col("rows_"), 6), "range_squared_sum": (F.col("r2"), 4),
        "elongation": (F.greatest("sx", "sy") / F.greatest(F.least("sx", "sy"), F.lit(1e-6)), 4), "points_per_m2": (n / F.greatest(area, F.lit(1e-6)), 2),
        "compensated_count": (n / F.greatest(F.col("med") * F.col("med"), F.lit(1e-6)), 4), "height_over_footprint": (F.when(area > 1e-9, F.col("sz") / F.sqrt(area)), 4),
    }


class Camera:
    """Pin-hole camera at a place with unit axes forward, right and up; pixels count from the upper left corner."""

    def __init__(self, at: Sequence[float], forward: Sequence[float], right: Sequence[float], up: Sequence[float], focal: float, width: float, height: float):
        self.at, self.axes, self.focal, self.mid = at, (forward, right, up), focal, (width / 2, height / 2)

    def pixel(self, x: str, y: str, z: str) -> tuple[Column, Column]:
        """u, v of a point ahead of the camera, else null."""
        d = [F.col(c) - float(a) for c, a in zip((x, y, z), self.at)]
        f, r, u = (d[0] * a[0] + d[1] * a[1] + d[2] * a[2] for a in self.axes)
        ahead = F.when(f > 1e-9, f)
        return self.mid[0] + self.focal * r / ahead, self.mid[1] - self.focal * u / ahead

    def ray(self, u: Column, v: Column) -> list[Column]:
        """Unit direction through a pixel."""
        a, b = (u - self.mid[0]) / self.focal, (self.mid[1] - v) / self.focal
        d = [F.lit(float(f)) + a * float(r) + b * float(t) for f, r, t in zip(*self.axes)]
        n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        return [c / n for c in d]


def nominal_model(df: DataFrame, pitch: str, height: str) -> DataFrame:
    """Adds the turning part (r00, r02, r20, r22), the shift tz and model_id of a levelling model declared by pitch down in
    ten-thousandths of a degree and height in millimetres. Rows beyond 90 degrees or outside 0 to 50 m have no model."""
    ok = df.filter(F.col(pitch).between(-900_000, 900_000) & F.col(height).between(0, 50_000))
    a = F.radians(F.col(pitch) / 10000.0)
    name = F.sha2(F.concat(F.lit("nominal;pitch="), F.col(pitch).cast("string"), F.lit(";height="), F.col(height).cast("string")), 256)
    return ok.withColumns({"r00": F.cos(a), "r02": F.sin(a), "r20": -F.sin(a), "r22": F.cos(a), "tz": F.col(height) / 1000.0, "model_id": name})


def selection_score(n: Column, dist: Column) -> Column:
    """Rises with points, falls with distance."""
    return F.log1p(n) / F.greatest(F.lit(0.5), dist)


def canonical_id(cols: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted names; null and its absence are the same."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def index_list(tag: Column, values: Column) -> Column:
    """Row numbers of a compressed list: 's' holds them one by one, 'r' is (start, count), 'm' is pairs of such."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(values) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(values, i * 2).alias("a"), F.get(values, i * 2 + 1).alias("n")))
    spread = F.flatten(F.transform(F.filter(runs, lambda r: r["n"] > 0), lambda r: F.sequence(r["a"], r["a"] + r["n"] - 1)))
    return F.when(tag == "s", values).when(tag.isin("r", "m"), spread)


def stamp_ok(sec: str = "stamp_sec", nano: str = "stamp_nanosec") -> Column:
    s, n = F.col(sec), F.col(nano)
    return F.coalesce(s.isNotNull() & (n >= 0) & (n < 1_000_000_000) & ~((s == 0) & (n == 0)), F.lit(False))


def stamp_seconds(sec: str = "stamp_sec", nano: str = "stamp_nanosec") -> Column:
    """Seconds of a device stamp, null where it is unusable."""
    return F.when(stamp_ok(sec, nano), F.col(sec) + F.col(nano) / 1e9)


def pinhole(fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point ahead of the camera (z > 0), else null."""
    ahead = F.col("z") > 0
    return F.when(ahead, fx * F.col("x") / F.col("z") + cx), F.when(ahead, fy * F.col("y") / F.col("z") + cy)


def axis_mapping(c: Column) -> Column:
    """Whether a text like '+x,-z,+y' names each axis once."""
    axes = F.transform(F.split(c, ","), lambda a: F.regexp_extract(F.trim(a), "^[+-]?([xyz])$", 1))
    return (F.size(axes) == 3) & (F.size(F.array_distinct(axes)) == 3) & ~F.array_contains(axes, "")


def to_unit(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """value in the base unit by a verified factor; null for an unknown unit."""
    case = None
    for name, f in factors.items():
        case = F.when(unit == name, value * f) if case is None else case.when(unit == name, value * f)
    return case
