"""Joins by place, time and interval over the point, frame, record and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import geometry as geo
from ..operators import joins as jn
from ..operators.intervals import usable_intervals
from .adapters import FRM, OKP, REC, frame_rows, records, valid_points
from .geometry_queries import _GRID, grid_cells, rnd
from .registry import query

_LAB = """lab as (select interval_id, session_id, track_id, label, start_frame, end_frame from (select *, row_number() over (partition by interval_id order by saved_ts desc nulls last, session_id desc, track_id desc, label desc, start_frame desc, end_frame desc) as rn from label_intervals)
 where rn = 1 and track_id is not null and start_frame >= 0 and start_frame <= end_frame and trim(label, ' \t\n' || chr(160) || chr(12288) || chr(8203)) <> '')"""


@query(f"""with {OKP}, p as (select session_id, frame_index, point_id, ring, degrees(atan2(y, x)) as a from ok where ring between 0 and 191),
g as (select r as ring, c as col, -180 + 2.8125 * c + (r % 4) * 0.1 as az from range(192) t(r) cross join range(128) u(c)),
k as (select point_id, col, row_number() over (partition by point_id order by abs(a - az), col) as rn from p join g on p.ring = g.ring and abs(a - az) <= 1.0)
select point_id, col from p left join (select point_id, col from k where rn = 1) using (point_id)""")
def direction_lookup(spark, d):
    p = geo.with_polar(valid_points(spark, d)).filter("ring between 0 and 191")
    r, c = spark.range(192).withColumnRenamed("id", "ring"), spark.range(128).withColumnRenamed("id", "col")
    grid = r.crossJoin(c).select(F.col("ring").cast("int").alias("ring"), "col", (-180 + 2.8125 * F.col("col") + (F.col("ring") % 4) * 0.1).alias("az_deg"))
    return jn.band_lookup(p, grid, 1.0).select("point_id", "col")


@query(f"""with {_GRID}, b as (select ring, col, median(range_m) as m, count(*) as n from g group by 1, 2)
select session_id, ring, col, round(range_m - m, 6) as residual, n >= 3 as known from g left join b using (ring, col)""")
def background_lookup(spark, d):
    g = grid_cells(spark, d)
    b = g.groupBy("ring", "col").agg(F.percentile("range_m", 0.5).alias("m"), F.count("*").alias("n"))
    return g.join(b, ["ring", "col"], "left").select("session_id", "ring", "col", rnd(F.col("range_m") - F.col("m")).alias("residual"), (F.col("n") >= 3).alias("known"))


@query(f"""with {_GRID} select a.session_id, a.ring, a.col, b.ring as ring_r, b.col as col_r, round(abs(a.range_m - b.range_m), 6) as step_m from g a join g b on a.session_id = b.session_id
 and ((b.ring = a.ring and b.col = a.col + 1) or (b.ring = a.ring + 1 and b.col between a.col - 1 and a.col + 1)) where abs(a.range_m - b.range_m) <= greatest(0.05, 0.012 * least(a.range_m, b.range_m))""")
def grid_neighbour_pairs(spark, d):
    n = jn.grid_neighbours(grid_cells(spark, d), ["session_id"])
    step = F.abs(F.col("range_m") - F.col("range_m_r"))
    return n.filter(step <= F.greatest(F.lit(0.05), 0.012 * F.least("range_m", "range_m_r"))).select("session_id", "ring", "col", "ring_r", "col_r", rnd(step).alias("step_m"))


_VOX = f"""{OKP}, vx as (select session_id, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from ok group by 1, 2, 3, 4)"""


def voxels(spark, d):
    from ..operators.aggregates import voxel_centroids

    return voxel_centroids(valid_points(spark, d), ["session_id"], 0.4)


@query(f"""with {_VOX} select a.session_id, a.cx, a.cy, a.cz from vx a where exists (select 1 from vx b where b.session_id = a.session_id and (a.cx, a.cy, a.cz) <> (b.cx, b.cy, b.cz)
 and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and abs(a.cz - b.cz) <= 1 and (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.3*0.3)""")
def voxel_neighbour_match(spark, d):
    """Voxels whose neighbourhood has another centroid within 0.3 m (semi join)."""
    v = voxels(spark, d).withColumn("id", F.struct("cx", "cy", "cz"))
    p = jn.radius_self_join(v, ["session_id"], "id", ["x", "y", "z"], 0.3)
    p = p.filter((F.abs(F.col("cx") - F.col("cx_r")) <= 1) & (F.abs(F.col("cy") - F.col("cy_r")) <= 1) & (F.abs(F.col("cz") - F.col("cz_r")) <= 1))
    p = p.select("session_id", F.explode(F.array("id", "id_r")).alias("id"))
    return v.join(p.distinct(), ["session_id", "id"], "left_semi").select("session_id", "cx", "cy", "cz")


@query(f"""with {_VOX} select a.session_id, a.cx as ax, a.cy as ay, a.cz as az, b.cx as bx, b.cy as by_, b.cz as bz, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) as dist
from vx a join vx b on a.session_id = b.session_id and (a.cx, a.cy, a.cz) < (b.cx, b.cy, b.cz) where (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.35*0.35""")
def radius_pairs(spark, d):
    v = voxels(spark, d).withColumn("id", F.struct("cx", "cy", "cz")).select("session_id", "id", "x", "y", "z")
    p = jn.radius_self_join(v, ["session_id"], "id", ["x", "y", "z"], 0.35)
    return p.select("session_id", *[F.col(f"{i}.c{c}").alias(n) for i, k in (("id", "a"), ("id_r", "b")) for c, n in zip("xyz", (f"{k}x", f"{k}y" + "_" * (k == "b"), f"{k}z"))], rnd("dist").alias("dist"))


@query(f"""with {OKP}, a as (select * from ok where frame_index % 2 = 0), b as (select * from ok where frame_index % 2 = 1),
k as (select a.point_id, b.point_id as nearest, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as dist, row_number() over (partition by a.point_id order by sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), b.point_id) as rn
 from a join b on a.session_id = b.session_id and abs(a.x-b.x) <= 0.2 and abs(a.y-b.y) <= 0.2 and abs(a.z-b.z) <= 0.2 where (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 0.04)
select a.point_id, nearest, round(dist, 6) as dist from a left join (select * from k where rn = 1) k using (point_id)""")
def nearest_points(spark, d):
    """Nearest point of the odd frames for each point of the even frames, within 0.2 m."""
    p = valid_points(spark, d)
    n = jn.nearest_within(p.filter("frame_index % 2 = 0"), p.filter("frame_index % 2 = 1"), ["session_id"], ["x", "y", "z"], 0.2, "point_id", "point_id")
    return n.select("point_id", "nearest", rnd("dist").alias("dist"))


_TIMES = f"""{REC}, {FRM}, f as (select session_id, stamp_sec + stamp_nanosec / 1e9 as t, max(frame_index) as frame from frm where stamp_nanosec between 0 and 999999999 and stamp_sec is not null and not (stamp_sec = 0 and stamp_nanosec = 0) and frame_index is not null group by 1, 2),
r as (select session_id, track_id, frame_index, stamp_sec as t from rec where stamp_sec is not null)"""


@query(f"""with {_TIMES}, s as (select session_id, min(t) as t0 from f group by 1), s2 as (select session_id, min(t) as t0 from r group by 1),
f0 as (select f.session_id, f.t - s.t0 as t, frame from f join s using (session_id)), r0 as (select r.session_id, track_id, frame_index, r.t - s2.t0 as t from r join s2 using (session_id))
select r0.session_id, r0.track_id, r0.frame_index, f0.frame as back_frame, round(r0.t - f0.t, 5) as lag_s from r0 asof left join f0 on r0.session_id = f0.session_id and r0.t >= f0.t""")
def asof_backward(spark, d):
    left, right = _clocks(spark, d)
    j = jn.asof_join(left, right, ["session_id"], "t", "t", "frame", "backward", "back_frame")
    return j.select("session_id", "track_id", "frame_index", "back_frame", rnd(F.col("t") - F.col("back_frame_time"), 5).alias("lag_s"))


def _clocks(spark, d):
    """Records and frames, each on its session's clock from its own first stamp."""
    from pyspark.sql import Window as W

    zero = lambda df: df.withColumn("t", F.col("t") - F.min("t").over(W.partitionBy("session_id")))
    f = frame_rows(spark, d).filter(geo.stamp_ok() & F.col("frame_index").isNotNull()).groupBy("session_id", (F.col("stamp_sec") + F.col("stamp_nanosec") / 1e9).alias("t")).agg(F.max("frame_index").alias("frame"))
    r = records(spark, d).filter("stamp_sec is not null").select("session_id", "track_id", "frame_index", F.col("stamp_sec").alias("t"))
    return zero(r), zero(f)


@query(f"""with {_TIMES}, s as (select session_id, min(t) as t0 from f group by 1), s2 as (select session_id, min(t) as t0 from r group by 1),
f0 as (select f.session_id, f.t - s.t0 as t, frame from f join s using (session_id)), r0 as (select r.session_id, track_id, frame_index, r.t - s2.t0 as t from r join s2 using (session_id)),
b as (select r0.*, f0.frame as bf, f0.t as bt from r0 asof left join f0 on r0.session_id = f0.session_id and r0.t >= f0.t),
c as (select b.*, f0.frame as ff, f0.t as ft from b asof left join f0 on b.session_id = f0.session_id and b.t <= f0.t)
select session_id, track_id, frame_index, case when ft is null or t - bt <= ft - t then bf else ff end as near_frame from c""")
def asof_nearest(spark, d):
    left, right = _clocks(spark, d)
    return jn.asof_join(left, right, ["session_id"], "t", "t", "frame", "nearest", "near_frame").select("session_id", "track_id", "frame_index", "near_frame")


@query(f"with {REC}, {_LAB} select i.interval_id, r.session_id, r.track_id, r.frame_index from rec r join lab i on r.session_id = i.session_id and r.track_id = i.track_id and r.frame_index between i.start_frame and i.end_frame")
def records_in_labels(spark, d):
    from ..core import latest_per_key, trim_blanks

    cols = ["session_id", "track_id", "label", "start_frame", "end_frame"]
    i = latest_per_key(table(spark, d, "label_intervals"), ["interval_id"], ["saved_ts"], cols).filter("track_id is not null and start_frame >= 0 and start_frame <= end_frame")
    i = i.filter(trim_blanks("label") != "")
    r = records(spark, d).select("session_id", "track_id", "frame_index")
    return jn.interval_join(r, i, ["session_id", "track_id"], "frame_index", "start_frame", "end_frame", 64).select("interval_id", "session_id", "track_id", "frame_index")


@query(f"""with {OKP}, {FRM}, o as (select session_id, frame_index as frame, max(offset_points) as lo, max(count_points) as n from frm where offset_points >= 0 and count_points >= 0 and frame_index is not null group by 1, 2),
p as (select point_id, session_id, source_row * 997 as row_no from ok where source_row is not null)
select p.point_id, case when row_no < o.lo + o.n then o.frame end as frame from p asof left join (select session_id, lo, max_by(n, frame) as n, max(frame) as frame from o group by 1, 2) o on p.session_id = o.session_id and p.row_no >= o.lo""")
def csr_rows_to_frames(spark, d):
    o = frame_rows(spark, d).filter("offset_points >= 0 and count_points >= 0 and frame_index is not null").groupBy("session_id", F.col("frame_index").alias("frame")).agg(F.max("offset_points").alias("lo"), F.max("count_points").alias("n"))
    p = valid_points(spark, d).filter("source_row is not null").select("point_id", "session_id", (F.col("source_row") * 997).alias("row_no"))
    return jn.csr_membership(p, o, ["session_id"], "row_no", "lo", "n", "frame").select("point_id", "frame")


_TRK = f"""{OKP}, t as (select session_id, frame_index % 20 as track_id, avg(x) as x, avg(y) as y from ok where frame_index is not null group by 1, 2), c as (select session_id, 100 + ring % 16 as candidate_id, avg(x) as x, avg(y) as y from ok where ring is not null group by 1, 2)"""


@query(f"""with {_TRK}, p as (select t.session_id, t.track_id, c.candidate_id, sqrt((t.x-c.x)**2 + (t.y-c.y)**2) as dist from t join c on t.session_id = c.session_id where (t.x-c.x)**2 + (t.y-c.y)**2 <= 0.09),
n as (select *, row_number() over w as rn, lead(dist) over w - dist as ld from p window w as (partition by session_id, track_id order by dist, candidate_id)),
s as (select session_id, track_id, candidate_id, dist, case when ld < 0.03 or count(*) over (partition by session_id, candidate_id) > 1 then 'ambiguous' else 'matched' end as st from n where rn = 1)
select session_id, track_id, case when st = 'matched' then candidate_id end as candidate_id, round(dist, 6) as dist, coalesce(st, 'unmatched') as status from t left join s using (session_id, track_id)""")
def gated_association(spark, d):
    p = valid_points(spark, d)
    t = p.filter("frame_index is not null").groupBy("session_id", (F.col("frame_index") % 20).alias("track_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    c = p.filter("ring is not null").groupBy("session_id", (F.col("ring") % 16 + 100).alias("candidate_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return jn.gated_association(t, c, ["session_id"], 0.3, 0.03).withColumn("dist", rnd("dist"))


@query(f"""with {OKP}, c as (select distinct session_id, frame_index // 10 as frame, ring // 32 as member, floor(x/0.8)::bigint * 1000 + floor(y/0.8)::bigint as cell from ok where frame_index is not null and ring between 0 and 191),
s as (select session_id, frame, member, count(*) as n from c group by 1, 2, 3),
b as (select a.session_id, a.frame, a.member, p.member as was, count(*) as common from c a join c p on a.session_id = p.session_id and a.frame = p.frame + 1 and a.cell = p.cell group by 1, 2, 3, 4),
l as (select b.*, common / least(x.n, y.n)::double as overlap from b join s x on (x.session_id, x.frame, x.member) = (b.session_id, b.frame, b.member) join s y on (y.session_id, y.frame, y.member) = (b.session_id, b.frame - 1, b.was)),
k as (select * from l where overlap >= 0.1)
select session_id, frame, member, was, round(overlap, 6) as overlap, count(*) over (partition by session_id, frame, member) > 1 as merge, count(*) over (partition by session_id, frame, was) > 1 as split from k""")
def overlap_history(spark, d):
    p = valid_points(spark, d).filter("frame_index is not null and ring between 0 and 191")
    c = p.select("session_id", F.floor(F.col("frame_index") / 10).alias("frame"), F.floor(F.col("ring") / 32).alias("member"), (F.floor(F.col("x") / 0.8) * 1000 + F.floor(F.col("y") / 0.8)).alias("cell"))
    return jn.overlap_links(c, ["session_id"], "frame", "member", 0.1).select("session_id", "frame", "member", "was", rnd("overlap").alias("overlap"), "merge", "split")


@query("select distinct c.sid, c.sensor_id, c.frame_count from session_catalog c join session_catalog e on c.sid = e.sid and c.sensor_id = e.sensor_id and c.frame_count = e.frame_count and e.session_role = 'development' where c.session_role is not null")
def strict_bindings(spark, d):
    c = table(spark, d, "session_catalog")
    return jn.strict_binding(c.filter("session_role is not null"), c.filter("session_role = 'development'"), ["sid", "sensor_id", "frame_count"]).select("sid", "sensor_id", "frame_count").distinct()


@query(f"with {OKP} select point_id from ok where not exists (select 1 from zones z where z.sensor_id = ok.sensor_id) or ring % 2 = 1")
def members_by_row_id(spark, d):
    """Anti and semi joins by key and row id."""
    p = valid_points(spark, d)
    z = table(spark, d, "zones").select("sensor_id").distinct()
    odd = p.filter("ring % 2 = 1").select("point_id")
    none = p.join(z, "sensor_id", "left_anti").select("point_id")
    return p.join(odd.unionByName(none).distinct(), "point_id", "left_semi").select("point_id")


@query("""with a as (select sid as k, max(frame_count) as v from session_catalog where sid is not null group by 1), b as (select session_id as k, count(distinct frame_index)::int as v from meta_frames group by 1)
select k as session_id, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as status from a full outer join b using (k) where a.k is null or b.k is null or a.v is distinct from b.v""")
def manifest_differences(spark, d):
    a = table(spark, d, "session_catalog").filter("sid is not null").groupBy(F.col("sid").alias("session_id")).agg(F.max("frame_count").alias("v"))
    b = table(spark, d, "meta_frames").groupBy("session_id").agg(F.count_distinct("frame_index").cast("int").alias("v"))
    return jn.manifest_diff(a, b, "session_id", "v")


@query(f"""with {OKP} select a.point_id, b.point_id as point_id_r, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2), 6) as dist from ok a join ok b on a.session_id = b.session_id and a.frame_index = b.frame_index + 1
where (a.x-b.x)**2 + (a.y-b.y)**2 <= 0.25 and sqrt((a.x-b.x)**2 + (a.y-b.y)**2) between 0.1 and 0.5""")
def velocity_hypotheses(spark, d):
    p = valid_points(spark, d).filter("frame_index is not null")
    return jn.velocity_hypotheses(p, ["session_id"], "frame_index", "point_id", 0.1, 0.5).select("point_id", "point_id_r", rnd("dist").alias("dist"))


@query(f"""with {OKP} select a.session_id, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 6) as gap from ok a join ok b on a.session_id = b.session_id and a.ring < 96 and b.ring >= 96
 and abs(a.x-b.x) <= 0.5 and abs(a.y-b.y) <= 0.5 and abs(a.z-b.z) <= 0.5 where (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.25 group by 1""")
def point_set_gaps(spark, d):
    p = valid_points(spark, d)
    return jn.set_distance(p.filter("ring < 96"), p.filter("ring >= 96"), ["session_id"], 0.5).select("session_id", rnd("gap").alias("gap"))


@query(f"with {_LAB} select count(*) as intervals, count(distinct session_id) as sessions from lab")
def usable_label_counts(spark, d):
    return usable_intervals(table(spark, d, "label_intervals")).agg(F.count("*").alias("intervals"), F.count_distinct("session_id").alias("sessions"))
