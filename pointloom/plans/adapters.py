"""The test tables in the shape the operators take: point rows, frames, height records, labels; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import latest_per_key, table


_NUMBERS = ["frame_index", "source_row", "x", "y", "z", "intensity", "ts", "ring"]


def point_rows(spark: SparkSession, d: str) -> DataFrame:
    """Point rows as delivered, in double precision: for what a repeat doesn't change, a projection or a least value."""
    p = table(spark, d, "cloud_points")
    return p.select("point_id", "session_id", "sensor_id", "frame_index", "source_row", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity", "ts")], "ring")


def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.filters import valid_row

    return point_rows(spark, d).filter(valid_row(100.0))


def _once(rows: DataFrame) -> DataFrame:
    """Repeats of a point_id once. Its numbers are aggregates, so the scan reads only the columns that a query uses."""
    return rows.groupBy("point_id", "session_id", "sensor_id").agg(*[F.first(c).alias(c) for c in _NUMBERS])


def points(spark: SparkSession, d: str) -> DataFrame:
    """Point rows in double precision, repeats once."""
    return _once(point_rows(spark, d))


def valid_points(spark: SparkSession, d: str) -> DataFrame:
    return _once(valid_rows(spark, d))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Height records: one per session, track and frame (the latest delivery); NaN heights are null."""
    cols = ["record_id", "generation", "stamp_sec", "state", "measured", "height_median_m"]
    p = table(spark, d, "posture_frames").filter("track_id is not null and frame_index is not null")
    p = p.withColumn("height_median_m", F.when(~F.isnan("height_median_m"), F.col("height_median_m")))
    return latest_per_key(p, ["session_id", "track_id", "frame_index"], ["recv_ts", "record_id"], cols)


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame index rows, repeats once."""
    return table(spark, d, "meta_frames").drop("recv_ts").distinct()


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """Frame index rows as delivered."""
    return table(spark, d, "meta_frames").drop("recv_ts")


def planes(spark: SparkSession, d: str) -> DataFrame:
    """A declared ground plane per sensor: pitch and roll in degrees, height above ground."""
    from ..operators.geometry import declared_plane

    s = table(spark, d, "sensors")
    p = s.select("sensor_id", ((F.col("mount_height_m") - 2.0) * 10).alias("pitch_deg"), (F.col("mount_height_m") - 2.3).alias("roll_deg"), F.col("mount_height_m").alias("height_m"))
    return declared_plane(p)


def seconds(c: str) -> Column:
    """Epoch seconds of a timestamp without zone."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


PTS = """pts as (select distinct point_id, session_id, sensor_id, frame_index, source_row, x::double as x, y::double as y, z::double as z,
  intensity::double as intensity, ts::double as ts, ring from cloud_points)"""
OKP = PTS + """, ok as (select * from pts where isfinite(x) and isfinite(y) and isfinite(z) and not (x = 0 and y = 0 and z = 0) and x*x + y*y + z*z <= 10000)"""
ROW = PTS.replace("select distinct point_id", "select point_id")
OKR = OKP.replace("select distinct point_id", "select point_id")
REC = """rec as (select session_id, track_id, frame_index, record_id, generation, stamp_sec, state, measured, height_median_m from (
  select * replace (case when not isnan(height_median_m) then height_median_m end as height_median_m),
    row_number() over (partition by session_id, track_id, frame_index order by recv_ts desc nulls last, record_id desc) as rn
  from posture_frames where track_id is not null and frame_index is not null) where rn = 1)"""
FRM = """frm as (select distinct session_id, frame_index, seq, stamp_sec, stamp_nanosec, bag_time_sec, offset_points, count_points, dropped_points from meta_frames)"""
PLN = """pln0 as (select sensor_id, radians((mount_height_m - 2.0) * 10) as p, radians(mount_height_m - 2.3) as r, mount_height_m as d from sensors),
pln as (select sensor_id, -sin(p) * cos(r) as nx, sin(r) as ny, cos(p) * cos(r) as nz, d from pln0)"""


def eigen_sql(source: str, name: str = "eg") -> str:
    """CTEs that add to a table of symmetric matrices (xx, xy, xz, yy, yz, zz) its eigenvalues l1 >= l2 >= l3 and the unit
    eigenvectors of l1 and l3 (v1x ... v3z, sign open; null where the gap to l2 is small): ``name`` is the last of them."""
    parts = [f"{name}_a as (select *, (xx+yy+zz)/3 as q_ from {source})"]
    parts.append(f"{name}_b as (select *, sqrt(((xx-q_)**2 + (yy-q_)**2 + (zz-q_)**2 + 2*(xy*xy+xz*xz+yz*yz))/6) as p_ from {name}_a)")
    parts.append(f"{name}_c as (select *, case when p_ > 0 then acos(greatest(least(((xx-q_)*((yy-q_)*(zz-q_)-yz*yz) - xy*(xy*(zz-q_)-yz*xz) + xz*(xy*yz-(yy-q_)*xz))/(2*p_**3), 1), -1))/3 else 0 end as f_ from {name}_b)")
    parts.append(f"{name}_d as (select *, q_ + 2*p_*cos(f_) as l1, q_ + 2*p_*cos(f_ + 2*pi()/3) as l3 from {name}_c)")
    parts.append(f"{name}_e as (select *, 3*q_ - l1 - l3 as l2 from {name}_d)")

    def vector(l: str) -> str:
        r = [(f"(xx-{l})", "xy", "xz"), ("xy", f"(yy-{l})", "yz"), ("xz", "yz", f"(zz-{l})")]
        cross = lambda u, v: (f"{u[1]}*{v[2]}-{u[2]}*{v[1]}", f"{u[2]}*{v[0]}-{u[0]}*{v[2]}", f"{u[0]}*{v[1]}-{u[1]}*{v[0]}")
        c = [cross(r[0], r[1]), cross(r[0], r[2]), cross(r[1], r[2])]
        return "list_max([" + ", ".join(f"{{'n': ({x})**2+({y})**2+({z})**2, 'x': {x}, 'y': {y}, 'z': {z}}}" for x, y, z in c) + "])"

    parts.append(f"{name}_f as (select *, {vector('l1')} as w1, {vector('l3')} as w3 from {name}_e)")
    cols = [f"case when {ok} then {w}.{k}/sqrt({w}.n) end as v{i}{k}" for i, w, ok in ((1, "w1", "l1 > 1.1*l2 and w1.n > 0"), (3, "w3", "l2 > 1.1*l3 and w3.n > 0")) for k in "xyz"]
    parts.append(f"{name} as (select *, {', '.join(cols)} from {name}_f)")
    return ",\n".join(parts)


STA = """sta as (select *, nullif(regexp_replace(regexp_replace(lower(state), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g'), '') as plain from rec)"""
