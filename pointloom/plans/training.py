"""Queries of the general training-data operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..core import table
from ..operators import drift, intervals, regular_grid, spatial


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).filter("missing").select("session_id", "slot_no")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "meta_frames"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.label_periods(table(spark, d, "label_intervals"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_drift(table(spark, d, "session_files"), table(spark, d, "schema_fields"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "session_files"), table(spark, d, "schema_fields"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return drift.path_statistics(table(spark, d, "session_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_and_zone(spark, table(spark, d, "cloud_points"), table(spark, d, "zones"))


QUERIES = {f.__name__: f for f in (p3_found, p3_grid, p4_found, p5_found, p5_table, p5_statistics, p6_found)}

ORACLE = {
    "p3_found": """
with s as (select distinct session_id, stamp_sec * 2 + stamp_nanosec // 500000000 as slot_no from meta_frames
  where stamp_sec is not null and stamp_nanosec >= 0 and stamp_nanosec < 1000000000 and count_points >= 0 and not (stamp_sec = 0 and stamp_nanosec = 0)),
g as (select session_id, slot_no, lead(slot_no) over (partition by session_id order by slot_no) as nxt from s)
select session_id, unnest(range(slot_no + 1, nxt)) as slot_no from g where nxt > slot_no + 1
""",
    "p4_found": """
with held as (select *, row_number() over (partition by interval_id order by saved_ts desc nulls last, session_id desc, track_id desc, label desc, start_frame desc, end_frame desc) as rn from label_intervals),
ok as (select session_id, track_id, lower(regexp_replace(label, '^[\\s\\x{a0}\\x{3000}\\x{200b}\\x{feff}]+|[\\s\\x{a0}\\x{3000}\\x{200b}\\x{feff}]+$', '', 'g')) as label, start_frame, end_frame
  from held where rn = 1 and track_id is not null and start_frame >= 0 and start_frame <= end_frame),
m as (select *, max(end_frame) over (partition by session_id, track_id, label order by start_frame, end_frame rows between unbounded preceding and 1 preceding) as pe from ok where label <> ''),
k as (select *, sum(case when pe is null or start_frame > pe + 1 then 1 else 0 end) over (partition by session_id, track_id, label order by start_frame, end_frame rows unbounded preceding) as g from m),
p as (select session_id, track_id, label, g, min(start_frame) as s, max(end_frame) as e from k group by all),
q as (select *, lead(s) over (partition by session_id, track_id, label order by s) as ns from p)
select session_id, track_id, label, 'period' as piece, s as start_frame, e as end_frame from q
union all
select session_id, track_id, label, 'gap', e + 1, ns - 1 from q where ns is not null
""",
    "p5_statistics": """
with held as (select *, row_number() over (partition by file_id order by saved_ts desc nulls last, session_id desc, file_kind desc, raw_json desc) as rn from session_files),
ok as (select file_id, file_kind, saved_ts, raw_json from held where rn = 1 and json_valid(raw_json) and not contains(raw_json, 'NaN') and not contains(raw_json, 'Infinity')),
t as (select file_id, file_kind, saved_ts, j.fullkey, j.type from ok, lateral (select * from json_tree(raw_json)) j where not contains(j.fullkey, '['))
select file_kind, case when fullkey = '$' then '$' else replace(substr(fullkey, 3), '"', '') end as field_path,
  case when type in ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') then 'integer' when type = 'DOUBLE' then 'number' when type = 'VARCHAR' then 'string' else lower(type) end as json_type,
  count(*) as files, min(saved_ts) as first_saved, max(saved_ts) as last_saved from t group by 1, 2, 3
""",
    "p6_found": """
with ok as (select distinct point_id, session_id, sensor_id, x::double as x, y::double as y, z::double as z from cloud_points
  where isfinite(x) and isfinite(y) and isfinite(z) and not (x = 0 and y = 0 and z = 0) and x::double * x + y::double * y + z::double * z <= 10000),
c as (select *, floor(x / 0.031)::bigint as cx, floor(y / 0.031)::bigint as cy, floor(z / 0.031)::bigint as cz from ok),
o as (select *, cx + a.d as nx, cy + b.d as ny, cz + e.d as nz from c cross join (values (-1),(0),(1)) a(d) cross join (values (-1),(0),(1)) b(d) cross join (values (-1),(0),(1)) e(d))
select distinct 'near' as relation, l.point_id as key_a, r.point_id as key_b from o l join c r
  on l.session_id = r.session_id and l.nx = r.cx and l.ny = r.cy and l.nz = r.cz and l.point_id < r.point_id
  where (l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y) + (l.z-r.z)*(l.z-r.z) <= 0.0305*0.0305
union all
select 'zone', point_id, max(zone_id) from ok join zones using (sensor_id)
  where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max group by point_id
""",
}
