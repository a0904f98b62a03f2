"""Directions, gaps, gates, latches, scores and assertions with their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..operators import aggregates as agg
from ..operators import clustering as cl
from ..operators import evidence as ev
from ..operators import geometry as geo
from ..operators import windows as win
from .adapters import OKP, OKR, PLN, PTS, REC, STA, eigen_sql, frame_rows, planes, points, records, valid_points, valid_rows
from .feature_queries import _POP
from .geometry_queries import rnd
from .registry import query
from .streaming_states import plain_state

KEY = ["session_id", "track_id"]
FRAME = ["session_id", "frame_index"]
_O = "partition by session_id, track_id order by frame_index"


@query(f"""with {PTS}, c as (select *, sqrt(x*x+y*y+z*z) as rg, case when not coalesce(isfinite(x) and isfinite(y) and isfinite(z), false) then 'nonfinite' when sqrt(x*x+y*y+z*z) <= 0.1 then 'zero_or_near' when ring is null or ring < 0 or ring >= 192 then 'bad_ring' end as cl from pts),
p as (select *, degrees(atan2(y, x)) as a, degrees(atan2(z, sqrt(x*x+y*y))) as e from c where cl is null), g as (select r as ring, c as col, -180 + 2.8125 * c + (r % 4) * 0.1 as az, -40 + 50.0 * r / 191 as el from range(192) t(r) cross join range(128) u(c)),
k as (select point_id, col, row_number() over (partition by point_id order by abs(a - az), col) as rn from p join g on p.ring = g.ring and abs(a - az) <= 1.0 and abs(e - el) <= 12.0),
l as (select p.*, k.col from p left join (select * from k where rn = 1) k using (point_id)),
d as (select session_id, case when col is null then 'unknown_direction' when row_number() over (partition by session_id, frame_index, ring, col order by rg, source_row nulls first, point_id) > 1 then 'duplicate' else 'accepted' end as cl from l union all select session_id, cl from c where cl is not null)
select session_id, cl as class, count(*) as rows from d group by all""")
def direction_accounting(spark, d):
    """Every return in one of six classes, with directions looked up in azimuth and elevation."""
    r, c = spark.range(192).withColumnRenamed("id", "ring"), spark.range(128).withColumnRenamed("id", "col")
    grid = r.crossJoin(c).select("ring", "col", (-180 + 2.8125 * F.col("col") + (F.col("ring") % 4) * 0.1).alias("az_deg"), (-40 + 50.0 * F.col("ring") / 191).alias("el_deg"))
    return ev.account_returns(points(spark, d), grid, FRAME, 192, 1.0, 12.0).groupBy("session_id", "class").agg(F.count("*").alias("rows"))


_CELLS = f"""{OKP}, cell as (select session_id, ring, floor((degrees(atan2(y, x)) + 180.0) / 11.25)::int as col, arg_min({{'x': x, 'y': y, 'z': z}}, (sqrt(x*x+y*y+z*z), point_id)) as p, min(sqrt(x*x+y*y+z*z)) as range_m from ok where ring between 0 and 191 group by 1, 2, 3)"""


def nearest_cells(spark, d):
    """Nearest return of each session's direction cell, with its place."""
    p = valid_points(spark, d).filter("ring between 0 and 191")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    az = F.floor((F.degrees(F.atan2("y", "x")) + 180.0) / 11.25).cast("int")
    g = p.groupBy("session_id", "ring", az.alias("col")).agg(F.min(F.struct(r.alias("range_m"), "point_id", "x", "y", "z")).alias("b"))
    return g.select("session_id", "ring", "col", "b.range_m", "b.x", "b.y", "b.z")


@query(f"""with {_CELLS}, l as (select session_id, ring, col, (ring // 8) * 4 + col // 8 as label, range_m, p.x as x, p.y as y, p.z as z from cell),
k as (select a.session_id, a.label as la, b.label as lb, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as gap, greatest(0.3, 0.1*least(a.range_m, b.range_m)) as lim from l a join l b on a.session_id = b.session_id and a.label <> b.label and b.ring - a.ring between 0 and 2 and abs(b.col - a.col) <= 2 and (b.ring > a.ring or b.col > a.col))
select session_id, least(la, lb) as label_a, greatest(la, lb) as label_b, round(min(gap), 6) as gap from k where gap <= lim group by 1, 2, 3""")
def label_boundary_gaps(spark, d):
    """Least measured gap between regions whose cells lie at most two apart."""
    c = nearest_cells(spark, d).withColumn("label", F.floor(F.col("ring") / 8) * 4 + F.floor(F.col("col") / 8))
    return ev.boundary_gaps(c, ["session_id"], "label", 0.3, 0.1).withColumn("gap", rnd("gap"))


@query(f"""with recursive {OKP}, v as (select session_id || ':' || frame_index as g, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from ok where frame_index is not null group by 1, 2, 3, 4),
nd as (select *, ((cx+1000)*10000 + cy+1000)*10000 + cz+1000 as id from v), ed as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 0.64*0.64),
reach(g, root, n) as (select g, id, id from nd union select r.g, r.root, e.b from reach r join ed e on e.g = r.g and e.a = r.n), comp as (select g, n as id, min(root) as root from reach group by 1, 2),
s as (select nd.g, cx, cy, cz, nd.n, dense_rank() over (partition by nd.g order by root) - 1 as component, sum(nd.n) over (partition by nd.g, root) as size from nd join comp using (g, id))
select g, cx, cy, cz, component, size::bigint as size, size >= 3 as retained from s""")
def metric_components(spark, d):
    """Voxels of a frame joined where their centroids are within 0.64 m, with each component's points and whether it is
    large enough to be kept."""
    p = valid_points(spark, d).filter("frame_index is not null").withColumn("g", F.concat_ws(":", "session_id", "frame_index"))
    v = agg.voxel_centroids(p, ["g"], 0.4).withColumn("id", F.struct("cx", "cy", "cz"))
    c = cl.group_clusters(v.withColumn("id", ((F.col("cx") + 1000) * 10000 + F.col("cy") + 1000) * 10000 + F.col("cz") + 1000), ["g"], "id", cl.single_link(0.64))
    j = v.withColumn("id", ((F.col("cx") + 1000) * 10000 + F.col("cy") + 1000) * 10000 + F.col("cz") + 1000).join(c, ["g", "id"])
    size = F.sum("n").over(W.partitionBy("g", "cluster"))
    return j.select("g", "cx", "cy", "cz", F.col("cluster").alias("component"), size.alias("size")).withColumn("retained", F.col("size") >= 3)


@query(f"""with {OKP}, a as (select * from ok where ring < 96), b as (select * from ok where ring >= 96), p as (select a.session_id, min((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d2 from a join b on a.session_id = b.session_id group by 1) select session_id, round(sqrt(d2), 6) as gap from p""")
def exact_set_gaps(spark, d):
    """Least distance between the lower and the upper rings' points of each session, without a bound given."""
    p = valid_points(spark, d).select("session_id", "ring", "x", "y", "z")
    return ev.exact_set_distance(p.filter("ring < 96").drop("ring"), p.filter("ring >= 96").drop("ring"), ["session_id"]).withColumn("gap", rnd("gap"))


@query(f"""with {OKP}, a as (select * from ok where frame_index % 2 = 0), b as (select * from ok where frame_index % 2 = 1),
k as (select a.point_id, b.point_id as neighbour, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as dist, row_number() over (partition by a.point_id order by sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), b.point_id) as k from a join b on a.session_id = b.session_id and abs(a.x-b.x) <= 0.2 and abs(a.y-b.y) <= 0.2 and abs(a.z-b.z) <= 0.2 where (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= 0.04)
select point_id, k, neighbour, round(dist, 6) as dist from k where k <= 3""")
def three_nearest(spark, d):
    """The three nearest points of the odd frames within 0.2 m for each point of the even ones."""
    from ..operators.joins import k_nearest

    p = valid_points(spark, d).select("session_id", "frame_index", "point_id", "x", "y", "z")
    n = k_nearest(p.filter("frame_index % 2 = 0").drop("frame_index"), p.filter("frame_index % 2 = 1").drop("frame_index"), ["session_id"], ["x", "y", "z"], 0.2, "point_id", 3)
    return n.select("point_id", "k", F.col("point_id_r").alias("neighbour"), rnd("dist").alias("dist"))


@query(f"""with {OKP}, s as (select session_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from ok where frame_index % 2 = 1 and ring < 96 group by 1),
a as (select ok.* from ok join s using (session_id) where frame_index % 2 = 0 and x between x0 - 0.1 and x1 + 0.1 and y between y0 - 0.1 and y1 + 0.1 and z between z0 - 0.1 and z1 + 0.1), b as (select * from ok where frame_index % 2 = 1 and ring < 96),
k as (select a.point_id, min((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d2 from a join b on a.session_id = b.session_id and abs(a.x-b.x) <= 0.1 and abs(a.y-b.y) <= 0.1 and abs(a.z-b.z) <= 0.1 group by 1)
select session_id, count(*) as in_box, count_if(d2 <= 0.01) as on_surface, round(avg(case when d2 <= 0.01 then sqrt(d2) end), 6) as mean_gap from a left join k using (point_id) group by 1""")
def bounded_surface_match(spark, d):
    """Points of the even frames inside the box of a frozen surface, and those within 0.1 m of it."""
    from ..operators.joins import nearest_within

    p = valid_points(spark, d).select("session_id", "frame_index", "ring", "point_id", "x", "y", "z")
    b = p.filter("frame_index % 2 = 1 and ring < 96")
    box = b.groupBy("session_id").agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])
    inside = [F.col(c).between(F.col(f"{c}0") - 0.1, F.col(f"{c}1") + 0.1) for c in "xyz"]
    a = p.filter("frame_index % 2 = 0").join(box, "session_id").filter(inside[0] & inside[1] & inside[2]).select("session_id", "point_id", "x", "y", "z")
    n = nearest_within(a, b.select("session_id", "point_id", "x", "y", "z"), ["session_id"], ["x", "y", "z"], 0.1, "point_id", "point_id")
    j = a.select("session_id", "point_id").join(n, "point_id", "left")
    return j.groupBy("session_id").agg(F.count("*").alias("in_box"), F.count("dist").alias("on_surface"), rnd(F.avg("dist")).alias("mean_gap"))


_SCREEN = f"""{OKP}, {PLN}, h as (select session_id, frame_index, x, y, nx*x+ny*y+nz*z+d as h from ok join pln using (sensor_id) where frame_index is not null),
s as (select session_id, frame_index, count(*) as n, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) as su, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) as sv, quantile_cont(h, 0.9) - quantile_cont(h, 0.1) as hs, max(h) as top from h group by 1, 2)"""


@query(f"""with {_SCREEN} select session_id, frame_index, case when greatest(su, sv) < 0.35 and hs < 0.4 then 'fragment' when n < 8 then 'unknown' when greatest(su, sv) >= 1.0 and least(su, sv) <= 0.5 and greatest(su, sv) / greatest(least(su, sv), 1e-6) > 4 then 'planar_structure' else 'unknown' end as class,
 case when greatest(su, sv) < 0.35 and hs < 0.4 then 'both_spans_small' when n < 8 then 'insufficient_points' when greatest(su, sv) >= 1.0 and least(su, sv) <= 0.5 and greatest(su, sv) / greatest(least(su, sv), 1e-6) > 4 then 'thin_and_long' else 'needs_full_description' end as reason from s""")
def quick_screen(spark, d):
    """Cheap screen before a full description: fragments and planar structures are told apart from the rest."""
    p = valid_points(spark, d).filter("frame_index is not null").join(planes(spark, d), "sensor_id").withColumn("h", geo.plane_height())
    s = p.groupBy(*FRAME).agg(F.count("*").alias("n"), *[F.percentile(c, [0.05, 0.95]).alias(f"p{c}") for c in "xy"], F.percentile("h", [0.1, 0.9]).alias("ph"))
    u, v = (F.get(f"p{c}", 1) - F.get(f"p{c}", 0) for c in "xy")
    s = s.select(*FRAME, "n", F.greatest(u, v).alias("wide"), F.least(u, v).alias("thin"), (F.get("ph", 1) - F.get("ph", 0)).alias("tall"))
    small = (F.col("wide") < 0.35) & (F.col("tall") < 0.4)
    planar = (F.col("wide") >= 1.0) & (F.col("thin") <= 0.5) & (F.col("wide") / F.greatest("thin", F.lit(1e-6)) > 4)
    c = F.when(small, "fragment").when(F.col("n") < 8, "unknown").when(planar, "planar_structure").otherwise("unknown")
    r = F.when(small, "both_spans_small").when(F.col("n") < 8, "insufficient_points").when(planar, "thin_and_long").otherwise("needs_full_description")
    return s.select(*FRAME, c.alias("class"), r.alias("reason"))


@query(f"""with {OKP}, c as (select session_id, frame_index, count(*) as n, max(z)-min(z) as h, {_POP} from ok where frame_index is not null group by 1, 2 having count(*) >= 6), {eigen_sql("c")},
s as (select session_id, frame_index, n, h, coalesce(round(abs(v1z), 6), 0) as up, round(sqrt(xx+yy), 6) as rxy from eg),
k as (select *, case when up >= 0.8 then 2 when up >= 0.6 then 1 else 0 end + case when h between 1.3 and 2.1 then 2 when h between 0.9 and 2.3 then 1 else 0 end + case when rxy <= 0.45 then 2 when rxy <= 0.6 then 1 else 0 end + case when n >= 12 then 1 else 0 end as score from s)
select session_id, frame_index, score, score >= 5 as person_like, case when up >= 0.55 then case when h >= 1.55 and rxy <= 0.6 then 'standing' when h >= 0.9 then 'bending' else 'unknown' end when h < 0.9 then 'lying' else 'unknown' end as pose from k""")
def person_like_scores(spark, d):
    """Points for an upright axis, a person's height, a narrow trunk and enough returns; five make a person-like frame."""
    c = valid_points(spark, d).filter("frame_index is not null").groupBy(*FRAME).agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("h"), *[(F.var_pop(p[0]) if p[0] == p[1] else F.covar_pop(p[0], p[1])).alias(p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")]).filter("n >= 6")
    e = agg.with_eigen(c).select(*FRAME, "n", "h", F.coalesce(rnd(F.abs("v1z")), F.lit(0.0)).alias("up"), rnd(F.sqrt(F.col("xx") + F.col("yy"))).alias("rxy"))
    up, h, r = F.col("up"), F.col("h"), F.col("rxy")
    step = lambda two, one: F.when(two, 2).when(one, 1).otherwise(0)
    score = step(up >= 0.8, up >= 0.6) + step(h.between(1.3, 2.1), h.between(0.9, 2.3)) + step(r <= 0.45, r <= 0.6) + (F.col("n") >= 12).cast("int")
    pose = F.when(up >= 0.55, F.when((h >= 1.55) & (r <= 0.6), "standing").when(h >= 0.9, "bending").otherwise("unknown")).when(h < 0.9, "lying").otherwise("unknown")
    return e.select(*FRAME, score.alias("score"), (score >= 5).alias("person_like"), pose.alias("pose"))


@query(f"""with {REC}, b as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, height_median_m as h, height_median_m is not null as ok from rec), c as (select *, case when ok and coalesce(lag(ok) over w, false) and coalesce(t - lag(t) over w > 0 and t - lag(t) over w <= 0.5, false) then 0 else 1 end as cut from b window w as ({_O})),
r as (select *, sum(cut) over ({_O}) as run, coalesce(ok and h >= 1.2, false) as up, coalesce(ok and h <= 0.5, false) as low from c), l as (select *, sum(up::int) over (partition by session_id, track_id, run order by frame_index) as leg, bool_or(up) over ({_O}) as was from r),
m as (select *, bool_or(ok and not up and not low) over (partition by session_id, track_id, run, leg order by frame_index) as mid from l)
select session_id, track_id, case when not bool_or(ok) then 'NO_VALID_FRAME' when not bool_or(up) then 'NEVER_UPRIGHT' when not bool_or(low and was) then 'NEVER_LOW' when bool_or(low and leg > 0 and mid) then 'OK' when bool_or(low and leg > 0) then 'TOO_SHORT' else 'EVENT_IN_GAP' end as verdict from m group by 1, 2""")
def track_admission(spark, d):
    """Which tracks go from upright to low in one unbroken run, and why others don't."""
    h = F.col("height_median_m")
    r = records(spark, d).withColumn("stamp_sec", F.when(~F.isnan("stamp_sec"), F.col("stamp_sec")))
    return ev.admission(r, KEY, "frame_index", "stamp_sec", h >= 1.2, h <= 0.5, h.isNotNull(), 0.5)


@query("""with s as (select sensor_id, mount_height_m as h, case when mount_height_m > 2.6 then 'stale' else 'valid' end as status, site from sensors), c as (select sid, max(sensor_id) as sensor_id from session_catalog where sid is not null group by 1)
select c.sid, case when s.sensor_id is null then 'no_plane' when status <> 'valid' then 'not_valid' when coalesce(split_part(site, '-', 1), '') = '' then 'no_frame' else 'applies' end as outcome, case when status = 'valid' and coalesce(split_part(site, '-', 1), '') <> '' then h end as plane_height from c left join s using (sensor_id)""")
def plane_applicability(spark, d):
    """A declared plane counts only if it is there, valid and names its frame; else heights are unavailable."""
    s = table(spark, d, "sensors").select("sensor_id", F.col("mount_height_m").alias("h"), F.when(F.col("mount_height_m") > 2.6, "stale").otherwise("valid").alias("status"), F.coalesce(F.split_part("site", F.lit("-"), F.lit(1)), F.lit("")).alias("frame"), F.lit(True).alias("there"))
    c = table(spark, d, "session_catalog").filter("sid is not null").groupBy("sid").agg(F.max("sensor_id").alias("sensor_id"))
    j = c.join(s, "sensor_id", "left")
    o = F.when(F.col("there").isNull(), "no_plane").when(F.col("status") != "valid", "not_valid").when(F.col("frame") == "", "no_frame").otherwise("applies")
    return j.withColumn("outcome", o).select("sid", "outcome", F.when(F.col("outcome") == "applies", F.col("h")).alias("plane_height"))


@query(f"""with {OKP}, a as (select session_id, frame_index, count(*) as n, max(z)-min(z) as h, max(x)-min(x) as e, stddev_pop(z) as s, avg(intensity) as i, min(z) as lo, avg(sqrt(x*x+y*y)) as r from ok where frame_index is not null group by 1, 2)
select session_id, frame_index, round(0.25*least(greatest((n - 3)/17.0, 0), 1) + 0.2*least(greatest((h - 0.2)/1.4, 0), 1) + 0.15*least(greatest((4.0 - e)/3.0, 0), 1) + 0.1*least(greatest((s - 0.05)/0.45, 0), 1) + 0.1*coalesce(least(greatest((i - 5)/45.0, 0), 1), 0) + 0.1*least(greatest((-1.0 - lo)/1.2, 0), 1) + 0.1*least(greatest((12.0 - r)/10.0, 0), 1), 6) as quality from a""")
def weighted_quality(spark, d):
    """Seven clipped ramps, better higher or lower, in a weighted sum."""
    a = valid_points(spark, d).filter("frame_index is not null").groupBy(*FRAME).agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("h"), (F.max("x") - F.min("x")).alias("e"), F.stddev_pop("z").alias("s"), F.avg("intensity").alias("i"), F.min("z").alias("lo"), F.avg(F.hypot("x", "y")).alias("r"))
    parts = [(0.25, "n", 3, 20), (0.2, "h", 0.2, 1.6), (0.15, "e", 4.0, 1.0), (0.1, "s", 0.05, 0.5), (0.1, "i", 5, 50), (0.1, "lo", -1.0, -2.2), (0.1, "r", 12.0, 2.0)]
    return a.select(*FRAME, rnd(geo.weighted_score([(w, geo.ramp(F.col(c), float(p), float(q))) for w, c, p, q in parts])).alias("quality"))


@query(f"""with {OKR}, t as (select point_id, least(greatest(greatest(0, 1 - (frame_index % 40) / 30.0), 0), 1) as f from ok where frame_index is not null) select distinct point_id, round(f, 6) as fresh, round(sqrt(f), 6) as red, round(0.85*f*f, 6) as green, round(0.55*f*f*f, 6) as blue from t""")
def heat_colours(spark, d):
    """Linear decay and the colour of what is left."""
    f = geo.decayed_linear(F.lit(1.0), F.col("frame_index") % 40, 30.0)
    r, g, b = geo.heat_rgb(F.col("fresh"))
    p = valid_rows(spark, d).filter("frame_index is not null").select("point_id", f.alias("fresh"))
    return p.select("point_id", rnd("fresh").alias("fresh"), rnd(r).alias("red"), rnd(g).alias("green"), rnd(b).alias("blue")).distinct()


@query(f"""with {_CELLS}, b as (select session_id, ring // 16 as block, count(*) as cells, max(ring)-min(ring)+1 as rows_, max(col)-min(col)+1 as cols_, median(range_m) as med, sum(range_m*range_m) as r2, max(p.x)-min(p.x) as sx, max(p.y)-min(p.y) as sy, max(p.z)-min(p.z) as sz from cell group by 1, 2)
select session_id, block, cells, round(cells/(rows_*cols_)::double, 6) as fill_ratio, round(cols_/rows_::double, 6) as aspect, round(r2, 4) as range_squared_sum, round(greatest(sx, sy)/greatest(least(sx, sy), 1e-6), 4) as elongation, round(cells/greatest(sx*sy, 1e-6), 2) as points_per_m2, round(cells/greatest(med*med, 1e-6), 4) as compensated_count, round(case when sx*sy > 1e-9 then sz/sqrt(sx*sy) end, 4) as height_over_footprint from b where least(sx, sy) > 0.01""")
def shape_ratios(spark, d):
    """Fill, aspect, elongation, density and distance-compensated count of blocks of direction cells."""
    c = nearest_cells(spark, d)
    span = lambda k: F.max(k) - F.min(k)
    b = c.groupBy("session_id", F.floor(F.col("ring") / 16).alias("block")).agg(F.count("*").alias("cells"), (span("ring") + 1).alias("rows_"), (span("col") + 1).alias("cols_"), F.percentile("range_m", 0.5).alias("med"), F.sum(F.col("range_m") * F.col("range_m")).alias("r2"), *[span(k).alias(f"s{k}") for k in "xyz"])
    return b.filter(F.least("sx", "sy") > 0.01).select("session_id", "block", "cells", *[rnd(v, n).alias(k) for k, (v, n) in geo.shape_scalars().items()])


@query("""with held as (select *, row_number() over (partition by interval_id order by saved_ts desc nulls last, session_id desc, start_frame desc, end_frame desc) as rn from label_intervals),
i as (select interval_id, start_frame::bigint as a, (end_frame - start_frame + 1)::bigint as n, interval_id % 3 as k from held where rn = 1 and start_frame >= 0 and start_frame <= end_frame),
e as (select interval_id, unnest(case k when 0 then [a, a + n] when 1 then range(a, a + n) else list_concat(range(a, a + n), range(a + n + 5, a + n + 7)) end) as row_no from i) select interval_id, count(*) as rows, sum(row_no)::bigint as total from e group by 1""")
def index_lists_of_each_kind(spark, d):
    """Single numbers, one run and several runs, decoded to row numbers."""
    from ..core import latest_per_key

    i = latest_per_key(table(spark, d, "label_intervals"), ["interval_id"], ["saved_ts", "session_id", "start_frame", "end_frame"], ["start_frame", "end_frame"]).filter("start_frame >= 0 and start_frame <= end_frame")
    a, n = F.col("start_frame").cast("bigint"), (F.col("end_frame") - F.col("start_frame") + 1).cast("bigint")
    tag = F.element_at(F.array(F.lit("s"), F.lit("r"), F.lit("m")), (F.col("interval_id") % 3 + 1).cast("int"))
    v = F.when(tag == "s", F.array(a, a + n)).when(tag == "r", F.array(a, n)).otherwise(F.array(a, n, a + n + 5, F.lit(2).cast("bigint")))
    e = i.select("interval_id", F.explode(geo.index_list(tag, v)).alias("row_no"))
    return e.groupBy("interval_id").agg(F.count("*").alias("rows"), F.sum("row_no").alias("total"))


@query(f"with {OKR}, r as (select point_id, x - 0.4 as a, y + 0.2 as b, z - 0.1 as c from ok where x > 1.0) select distinct point_id, round(a/sqrt(a*a+b*b+c*c), 6) as dx, round(b/sqrt(a*a+b*b+c*c), 6) as dy, round(c/sqrt(a*a+b*b+c*c), 6) as dz from r")
def pixel_rays(spark, d):
    """Points through a camera to pixels and back to rays: the direction from the camera to the point."""
    cam = geo.Camera((0.4, -0.2, 0.1), (1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), 500.0, 640.0, 480.0)
    u, v = cam.pixel("x", "y", "z")
    p = valid_rows(spark, d).filter("x > 1.0").select("point_id", u.alias("u"), v.alias("v"))
    return p.select("point_id", *[rnd(c).alias(k) for k, c in zip(("dx", "dy", "dz"), cam.ray(F.col("u"), F.col("v")))]).distinct()


@query("""with s as (select sensor_id, round(mount_height_m * 1000)::bigint as h, (round((mount_height_m - 2.0) * 100000)::bigint) as p from sensors), r as (select *, radians(p / 10000.0) as a from s where p between -900000 and 900000 and h between 0 and 50000)
select sensor_id, round(cos(a), 6) as r00, round(sin(a), 6) as r02, round(-sin(a), 6) as r20, round(cos(a), 6) as r22, h / 1000.0::double as tz, sha256('nominal;pitch=' || p || ';height=' || h) as model_id from r""")
def nominal_models(spark, d):
    """Levelling model from a declared pitch and height, named by its content."""
    s = table(spark, d, "sensors").select("sensor_id", F.round(F.col("mount_height_m") * 1000).cast("bigint").alias("h"), F.round((F.col("mount_height_m") - 2.0) * 100000).cast("bigint").alias("p"))
    return geo.nominal_model(s, "p", "h").select("sensor_id", *[rnd(c).alias(c) for c in ("r00", "r02", "r20", "r22")], "tz", "model_id")


@query(f"""with {OKP}, {PLN}, f as (select session_id, frame_index, max(sensor_id) as sensor_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz from ok where frame_index is not null group by 1, 2)
select session_id, frame_index, n, case when pln.sensor_id is null then 'reference_only' when frame_index % 3 = 0 then 'accepted' else 'hold_numeric' end as mode, round(nx*mx + ny*my + nz*mz + d, 6) as mapped_height from f left join pln on pln.sensor_id = f.sensor_id and pln.d <= 2.6""")
def frame_modes(spark, d):
    """Mapped frames with their mode: accepted with a fresh transform, held with an old one, reference only without."""
    f = valid_points(spark, d).filter("frame_index is not null").groupBy(*FRAME).agg(F.max("sensor_id").alias("sensor_id"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
    p = planes(spark, d).filter("d <= 2.6").select("sensor_id", "nx", "ny", "nz", "d", F.lit(True).alias("there"))
    j = f.join(p, "sensor_id", "left")
    m = F.when(F.col("there").isNull(), "reference_only").when(F.col("frame_index") % 3 == 0, "accepted").otherwise("hold_numeric")
    return j.select(*FRAME, "n", m.alias("mode"), rnd(geo.plane_height()).alias("mapped_height"))


@query(f"with {OKP}, k as (select session_id, point_id, row_number() over (partition by session_id order by intensity desc nulls last, point_id) as rk, count(*) over (partition by session_id) > 8 as truncated from ok) select session_id, point_id, rk, truncated from k where rk <= 8")
def best_eight_flagged(spark, d):
    w = W.partitionBy("session_id")
    k = valid_points(spark, d).select("session_id", "point_id", "intensity")
    k = k.withColumns({"rk": F.row_number().over(w.orderBy(F.desc_nulls_last("intensity"), "point_id")), "truncated": F.count("*").over(w) > 8})
    return k.filter("rk <= 8").select("session_id", "point_id", "rk", "truncated")


@query(f"with {OKP}, c as (select distinct session_id, floor(x/0.3)::bigint as cx, floor(y/0.3)::bigint as cy, floor(z/0.3)::bigint as cz from ok), k as (select *, row_number() over (partition by session_id order by cz, cy, cx) as rk from c) select session_id, cx, cy, cz from k where rk <= 64")
def lowest_cells(spark, d):
    """The 64 lowest occupied cells of each session."""
    c = valid_rows(spark, d).select("session_id", *[F.floor(F.col(k) / 0.3).alias(f"c{k}") for k in "xyz"]).distinct()
    return c.withColumn("rk", F.row_number().over(W.partitionBy("session_id").orderBy("cz", "cy", "cx"))).filter("rk <= 64").drop("rk")


@query(f"""with {OKP}, k as (select session_id, point_id, md5(point_id::varchar) as h, row_number() over (partition by session_id, floor(x), floor(y) order by md5(point_id::varchar), point_id) as rk from ok), g as (select session_id, point_id, row_number() over (partition by session_id order by h, point_id) as rn from k where rk <= 3) select session_id, point_id from g where rn <= 150""")
def balanced_sample_capped(spark, d):
    """At most three points a square metre, then at most 150 a session, in the order of their digests."""
    h = F.md5(F.col("point_id").cast("string"))
    k = valid_points(spark, d).select("session_id", "point_id", F.floor("x").alias("cx"), F.floor("y").alias("cy"), h.alias("h"))
    k = k.withColumn("rk", F.row_number().over(W.partitionBy("session_id", "cx", "cy").orderBy("h", "point_id"))).filter("rk <= 3")
    return k.withColumn("rn", F.row_number().over(W.partitionBy("session_id").orderBy("h", "point_id"))).filter("rn <= 150").select("session_id", "point_id")


@query(f"""with {OKP}, u as (select distinct session_id, round(x, 1) as x, round(y, 1) as y, round(z, 1) as z from ok), k as (select *, row_number() over (partition by session_id order by x, y, z) - 1 as r, count(*) over (partition by session_id) as n from u)
select distinct session_id, x, y, z from k join range(32) t(i) on r = case when n <= 32 then i else (i * (n - 1)) // 31 end""")
def distinct_then_even(spark, d):
    """Distinct places, then 32 evenly spaced ones in canonical order."""
    u = valid_rows(spark, d).select("session_id", *[F.round(c, 1).alias(c) for c in "xyz"]).distinct()
    w = W.partitionBy("session_id")
    k = u.withColumns({"r": F.row_number().over(w.orderBy("x", "y", "z")) - 1, "n": F.count("*").over(w)})
    at = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.floor(i * (F.col("n") - 1) / 31))
    return k.filter((F.col("n") <= 32) | F.array_contains(at, F.col("r"))).select("session_id", "x", "y", "z")


@query(f"""with {REC}, b as (select session_id, track_id, frame_index, generation, case when not isnan(stamp_sec) then stamp_sec end as t, coalesce(height_median_m <= 0.6 and not isnan(stamp_sec), false) as low from rec),
c as (select *, case when low and coalesce(lag(low) over w, false) and frame_index = lag(frame_index) over w + 1 and generation is not distinct from lag(generation) over w and coalesce(t - lag(t) over w > 0 and t - lag(t) over w <= 0.3, false) then 0 else 1 end as cut from b window w as ({_O})),
r as (select *, sum(cut) over ({_O}) as run from c), s as (select *, case when low then t - min(t) over (partition by session_id, track_id, run) else 0 end as dur from r)
select session_id, track_id, frame_index, round(dur, 6) as duration_s, case when dur >= 3.0 - 1e-6 then 2 when dur >= 1.5 - 1e-6 then 1 else 0 end as level from s""")
def strict_alert_levels(spark, d):
    """Two levels of lasting low posture; a missing frame, a long step or another generation starts over."""
    r = records(spark, d).withColumn("t", F.when(~F.isnan("stamp_sec"), F.col("stamp_sec")))
    low = F.coalesce((F.col("height_median_m") <= 0.6) & F.col("t").isNotNull(), F.lit(False))
    a = win.strict_duration(r.withColumn("low", low), KEY, "frame_index", "t", "low", F.col("generation"), 0.3)
    level = F.when(F.col("duration_s") >= 3.0 - 1e-6, 2).when(F.col("duration_s") >= 1.5 - 1e-6, 1).otherwise(0)
    return a.select(*KEY, "frame_index", rnd("duration_s").alias("duration_s"), level.alias("level"))


@query(f"""with {REC}, b as (select session_id, track_id, frame_index, stamp_sec as t, case when height_median_m >= 1.0 then 1 when height_median_m <= 0.6 then -1 else 0 end as s from rec where stamp_sec is not null and not isnan(stamp_sec)), c as (select *, case when row_number() over w > 1 and lag(s) over w = s then 0 else 1 end as nw from b window w as ({_O})),
r as (select *, sum(nw) over ({_O}) as run from c), h as (select *, case when s <> 0 and t - min(t) over (partition by session_id, track_id, run order by frame_index) >= 0.5 then s > 0 end as d from r)
select session_id, track_id, frame_index, coalesce(last_value(d ignore nulls) over ({_O}), false) as latched from h""")
def seconds_latch(spark, d):
    r = records(spark, d).filter("stamp_sec is not null and not isnan(stamp_sec)")
    return ev.timed_latch(r, KEY, "frame_index", "stamp_sec", F.col("height_median_m"), 1.0, 0.6, 0.5).select(*KEY, "frame_index", "latched")


@query(f"""with {OKP}, c as (select session_id, frame_index, frame_index * 0.1 as t, avg(x) as x, avg(y) as y from ok where frame_index is not null group by 1, 2),
h as (select session_id, frame_index, list_sort(list({{'t': t, 'x': x, 'y': y}}) over (partition by session_id order by frame_index range between 10 preceding and current row)) as h from c),
k as (select *, h[1] as f, h[-1] as l, sqrt((h[-1].x-h[1].x)**2+(h[-1].y-h[1].y)**2) as net, coalesce(list_sum(list_transform(range(1, len(h)), lambda i: sqrt((h[i+1].x-h[i].x)**2+(h[i+1].y-h[i].y)**2))), 0) as path,
 list_min(list_transform(h, lambda p: {{'o': abs(p.t - (h[1].t + h[-1].t)/2), 't': p.t, 'x': p.x, 'y': p.y}})) as m from h),
e as (select *, case when path > 0 then net/path else 0 end as progress, len(h) >= 2 and l.t - f.t >= 0.18 and net >= 0.3 as moved, sqrt((m.x-f.x)**2+(m.y-f.y)**2)*sqrt((l.x-m.x)**2+(l.y-m.y)**2) as norms from k)
select session_id, frame_index, round(net, 5) as net_m, round(progress, 5) as progress, moved, moved and progress >= 0.7 as direct, moved and progress >= 0.7 and l.t - f.t >= 0.5 - 1e-6 and norms > 0 and coalesce(((m.x-f.x)*(l.x-m.x)+(m.y-f.y)*(l.y-m.y))/nullif(norms, 0) >= 0.7, false) as consistent from e""")
def motion_evidence(spark, d):
    """Net and direct motion of each frame's centre over a second, and whether its two halves agree."""
    c = valid_points(spark, d).filter("frame_index is not null").groupBy(*FRAME).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("t", F.col("frame_index") * 0.1)
    return ev.motion_evidence(c, ["session_id"], "t", 1.0, 0.3).select(*FRAME, rnd("net_m", 5).alias("net_m"), rnd("progress", 5).alias("progress"), "moved", "direct", "consistent")


@query("""with f as (select distinct session_id, frame_index, seq, dropped_points, recv_ts from meta_frames where recv_ts is not null), w as (select session_id, floor(epoch(recv_ts) / 30)::bigint as win, count(*) as n, quantile_cont(dropped_points, [0.5, 0.95, 0.99]) as p, max(seq) as last from f group by 1, 2)
select session_id, win as window, n, round(n / 30.0, 6) as rate, round(p[1], 4) as p50, round(p[2], 4) as p95, round(p[3], 4) as p99, last - lag(last) over (partition by session_id order by win) as counted from w""")
def performance_rollup(spark, d):
    """Half-minute windows: rate, percentiles, and what the counter grew since the window before."""
    f = table(spark, d, "meta_frames").filter("recv_ts is not null").select(*FRAME, "seq", "dropped_points", "recv_ts").distinct()
    at = F.floor(F.unix_micros(F.col("recv_ts").cast("timestamp")) / 30_000_000)
    w = f.groupBy("session_id", at.alias("window")).agg(F.count("*").alias("n"), F.percentile("dropped_points", [0.5, 0.95, 0.99]).alias("p"), F.max("seq").alias("last"))
    grown = F.col("last") - F.lag("last").over(W.partitionBy("session_id").orderBy("window"))
    return w.select("session_id", "window", "n", rnd(F.col("n") / 30.0).alias("rate"), *[rnd(F.get("p", k), 4).alias(c) for k, c in enumerate(("p50", "p95", "p99"))], grown.alias("counted"))


@query(f"""with recursive {REC}, s as (select session_id, frame_index // 20 as block, track_id, round(avg(height_median_m), 6) as score from rec where height_median_m is not null group by 1, 2, 3), l as (select session_id, block, list(track_id order by score desc, track_id) as items, list(score order by score desc, track_id) as scores from s group by 1, 2),
o as (select *, row_number() over (partition by session_id order by block) as rn from l), e as (select session_id, block, rn, items[1] as chosen, false as kept from o where rn = 1
 union all select o.session_id, o.block, o.rn, case when coalesce(o.scores[list_position(o.items, e.chosen)] >= 0.85 * o.scores[1], false) then e.chosen else o.items[1] end, coalesce(o.scores[list_position(o.items, e.chosen)] >= 0.85 * o.scores[1], false) from e join o on o.session_id = e.session_id and o.rn = e.rn + 1)
select session_id, block, chosen, kept from e""")
def choice_kept(spark, d):
    """The best track of each block of frames; the one chosen before stays while it scores 85 % of the best."""
    s = records(spark, d).filter("height_median_m is not null").groupBy("session_id", F.floor(F.col("frame_index") / 20).alias("block"), "track_id").agg(rnd(F.avg("height_median_m")).alias("score"))
    l = s.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "track_id", "score"))).alias("a"))
    l = l.select("session_id", "block", F.transform("a", lambda x: x["track_id"]).alias("items"), F.transform("a", lambda x: x["score"]).alias("scores"))
    return win.fold_rows(l, ["session_id"], ["block"], ["items", "scores"], ev.KeepChoice(0.85), [("chosen", "string"), ("kept", "boolean")]).select("session_id", "block", "chosen", "kept")


_SAID = f"""{REC}, {STA}, t as (select plain as truth, case when height_median_m <= 0.35 then 'lying' when height_median_m <= 0.6 then 'low_posture' when height_median_m <= 0.9 then 'sitting' when height_median_m is not null then 'upright' end as said from sta where plain in ('upright', 'sitting', 'lying', 'low_posture', 'descending'))"""


def said_classes(spark, d):
    h = F.col("height_median_m")
    said = F.when(h <= 0.35, "lying").when(h <= 0.6, "low_posture").when(h <= 0.9, "sitting").when(h.isNotNull(), "upright")
    return records(spark, d).select(plain_state(F.col("state")).alias("truth"), said.alias("said")).filter("truth in ('upright', 'sitting', 'lying', 'low_posture', 'descending')")


@query(f"""with {_SAID}, m as (select truth, said, count(*) as n from t where said is not null group by 1, 2), c as (select truth as class from m union select said from m),
g as (select class, coalesce((select sum(n) from m where truth = class and said = class), 0) as tp, coalesce((select sum(n) from m where truth = class), 0) as t, coalesce((select sum(n) from m where said = class), 0) as s from c)
select class, tp::bigint as tp, (s - tp)::bigint as fp, (t - tp)::bigint as fn, round(tp / nullif(s, 0), 6) as precision, round(tp / nullif(t, 0), 6) as recall, round(2 * tp / nullif(s + t, 0), 6) as f1, round(avg(coalesce(2 * tp / nullif(s + t, 0), 0)) over (), 6) as macro_f1, round(sum(tp) over () / sum(t) over (), 6) as accuracy from g""")
def multiclass_scores(spark, d):
    s = ev.class_scores(said_classes(spark, d), "truth", "said")
    return s.select("class", "tp", "fp", "fn", *[rnd(c).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")])


@query(f"with {_SAID} select truth, count_if(said = 'lying') as lying, count_if(said = 'low_posture') as low_posture, count_if(said = 'sitting') as sitting, count_if(said = 'upright') as upright, count_if(said is null) as missing from t group by 1")
def confusion_matrix(spark, d):
    s = said_classes(spark, d).fillna("missing", ["said"])
    return s.groupBy("truth").pivot("said", ["lying", "low_posture", "sitting", "upright", "missing"]).count().fillna(0)


@query(f"with {REC} select session_id, count(height_median_m) as samples, min(height_median_m) as min, round(quantile_cont(height_median_m, 0.05), 6) as p05, round(median(height_median_m), 6) as median, round(quantile_cont(height_median_m, 0.95), 6) as p95, max(height_median_m) as max from rec group by 1")
def height_distribution(spark, d):
    """Summary of the heights that are there; a value that isn't finite would be an error."""
    return ev.distribution(records(spark, d), ["session_id"], "height_median_m").select("session_id", "samples", "min", *[rnd(c).alias(c) for c in ("p05", "median", "p95")], "max")


@query(f"with {PTS}, c as (select session_id, case when not coalesce(isfinite(x) and isfinite(y) and isfinite(z), false) then 'invalid' when z < -1.9 then 'ground' when z < -0.5 then 'body' else 'high' end as label from pts), g as (select session_id, label, count(*) as n from c group by 1, 2) select session_id, label, n, sum(n) over (partition by session_id)::bigint as total, sum(n) over (partition by session_id) = (select count(*) from pts where pts.session_id is not distinct from g.session_id) as balanced from g")
def exclusive_ledger(spark, d):
    """Each row under one label; the labels of a session add up to its rows."""
    from ..operators.filters import finite

    p = points(spark, d)
    label = F.when(~(finite("x") & finite("y") & finite("z")), "invalid").when(F.col("z") < -1.9, "ground").when(F.col("z") < -0.5, "body").otherwise("high")
    g = p.groupBy("session_id", label.alias("label")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy("session_id")))
    rows = p.groupBy(F.col("session_id").alias("s")).agg(F.count("*").alias("rows"))
    return g.join(rows, g["session_id"].eqNullSafe(rows["s"])).select("session_id", "label", "n", "total", (F.col("total") == F.col("rows")).alias("balanced"))


@query("""select 'sid listed once' as rule, (select count(*) from (select sid from session_catalog where sid is not null group by sid having count(*) > 1)) as violations union all select 'frames have a session', (select count(*) from (select distinct session_id from meta_frames) m where not exists (select 1 from session_catalog c where c.sid = m.session_id))
 union all select 'zones have a sensor', (select count(*) from zones z where not exists (select 1 from sensors s where s.sensor_id = z.sensor_id)) union all select 'held-out and training apart', (select count(*) from (select sid from session_catalog where session_role = 'development' intersect select sid from session_catalog where session_role = 'review'))""")
def assertions(spark, d):
    """Uniqueness, subset and disjointness rules with the number of keys that break them."""
    c, m, z, s = (table(spark, d, t) for t in ("session_catalog", "meta_frames", "zones", "sensors"))
    role = lambda r: c.filter(F.col("session_role") == r).select("sid")
    rules = {
        "sid listed once": c.filter("sid is not null").groupBy("sid").count().filter("count > 1"),
        "frames have a session": m.select(F.col("session_id").alias("sid")).distinct().join(c.select("sid"), "sid", "left_anti"),
        "zones have a sensor": z.join(s, "sensor_id", "left_anti"),
        "held-out and training apart": role("development").intersect(role("review")),
    }
    out = None
    for name, broken in rules.items():
        r = broken.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"""with {OKP}, h as (select zone_id, session_id, frame_index, floor((x-x_min)/0.5)::bigint as bx, floor((y-y_min)/0.5)::bigint as by_, floor((z-z_min)/0.5)::bigint as bz from ok join zones using (sensor_id) where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max),
b as (select zone_id, bx, by_, bz, count(*) as n, count(distinct (session_id, frame_index)) as frames from h group by 1, 2, 3, 4) select zone_id, count(*) as bins, max(n) as fullest, sum(n)::bigint as points, max(frames) as most_frames from b group by 1""")
def zone_bins(spark, d):
    """Half-metre bins inside each zone: occupied ones, the fullest, and the most frames one was seen in."""
    z = table(spark, d, "zones").select("zone_id", "sensor_id", *[f"{c}_{m}" for c in "xyz" for m in ("min", "max")])
    inside = [(F.col(c) >= F.col(f"{c}_min")) & (F.col(c) < F.col(f"{c}_max")) for c in "xyz"]
    h = valid_points(spark, d).join(F.broadcast(z.limit(20_000)) if z.count() <= 20_000 else z, "sensor_id").filter(inside[0] & inside[1] & inside[2])
    b = h.groupBy("zone_id", *[F.floor((F.col(c) - F.col(f"{c}_min")) / 0.5).alias(f"b{c}") for c in "xyz"]).agg(F.count("*").alias("n"), F.count_distinct(F.struct("session_id", "frame_index")).alias("frames"))
    return b.groupBy("zone_id").agg(F.count("*").alias("bins"), F.max("n").alias("fullest"), F.sum("n").alias("points"), F.max("frames").alias("most_frames"))


@query(f"""with {PTS}, w as (select *, frame_index * 1000000 + source_row as row_no from pts where frame_index is not null and source_row is not null), s as (select *, row_no > lag(row_no) over (partition by session_id order by row_no, point_id) as up from w),
n as (select session_id, count(*) as rows, count_if(coalesce(x = 0 and y = 0 and z = 0, false)) as zero_rows, count_if(intensity > 0) as weighted, coalesce(bool_and(up), true) as increasing, sum(cast('0x' || substr(md5(point_id::varchar), 1, 8) as bigint))::bigint as id_digest, sum(cast('0x' || substr(md5(row_no::varchar), 1, 8) as bigint))::bigint as row_digest from s group by 1)
select * from n""")
def point_domains(spark, d):
    """A session's point set as counts, the order of its row numbers and digests that need no order and merge."""
    p = points(spark, d).filter("frame_index is not null and source_row is not null").withColumn("row_no", F.col("frame_index").cast("bigint") * 1_000_000 + F.col("source_row"))
    p = p.withColumn("up", F.col("row_no") > F.lag("row_no").over(W.partitionBy("session_id").orderBy("row_no", "point_id")))
    zero = F.coalesce((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0), F.lit(False))
    return p.groupBy("session_id").agg(F.count("*").alias("rows"), F.count_if(zero).alias("zero_rows"), F.count_if(F.col("intensity") > 0).alias("weighted"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("increasing"),
                                       F.sum(ev.digest_number(F.col("point_id").cast("string"))).alias("id_digest"), F.sum(ev.digest_number(F.col("row_no").cast("string"))).alias("row_digest"))


@query(f"""with {REC}, m as (select session_id, track_id, frame_index, height_median_m as raw, quantile_cont(height_median_m, 0.5) over ({_O} rows between 4 preceding and current row) as filtered from rec), a as (select *, case when abs(raw - filtered) <= 0.25 then raw end as accepted from m)
select session_id, track_id, count(raw) as raw_n, count(accepted) as accepted_n, round(stddev_pop(accepted), 6) as spread, round(max(abs(raw - filtered)), 6) as worst, count(raw) - count(accepted) as rejected from a group by 1, 2""")
def frame_report(spark, d):
    """Raw, filtered and accepted heights of each track: how many, how far apart, and the spread of the accepted ones."""
    m = win.sliding_median(records(spark, d), KEY, ["frame_index"], "height_median_m", 5).withColumnRenamed("median_k", "filtered")
    off = F.abs(F.col("height_median_m") - F.col("filtered"))
    a = m.withColumns({"off": off, "accepted": F.when(off <= 0.25, F.col("height_median_m"))})
    return a.groupBy(*KEY).agg(F.count("height_median_m").alias("raw_n"), F.count("accepted").alias("accepted_n"), rnd(F.stddev_pop("accepted")).alias("spread"), rnd(F.max("off")).alias("worst"), (F.count("height_median_m") - F.count("accepted")).alias("rejected"))


@query(f"""with {REC}, {STA}, d as (select record_id, plain as label from sta where plain in ('upright', 'lying', 'sitting')), n as (select label, count(*) as n from d group by 1), m as (select max(n) as m from n), r as (select d.*, n, m, row_number() over (partition by label order by md5(record_id::varchar), record_id) as r from d join n using (label) cross join m)
select record_id, label, unnest(range(m // n + case when r <= m % n then 1 else 0 end))::int as copy from r""")
def oversampled(spark, d):
    """Every class repeated to the size of the largest."""
    r = records(spark, d).select("record_id", plain_state(F.col("state")).alias("label")).filter("label in ('upright', 'lying', 'sitting')")
    return ev.oversample(r, "label", "record_id").select("record_id", "label", "copy")


_EST = f"""{OKP}, g as (select session_id, x, y, z from ok where z < -1.6), c as (select session_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, {_POP} from g group by 1 having count(*) >= 30), {eigen_sql("c")},
tls as (select session_id, v3x*sign(v3z) as ax, v3y*sign(v3z) as ay, abs(v3z) as az, -(v3x*mx+v3y*my+v3z*mz)*sign(v3z) as d, sqrt(greatest(l3, 0)) as rms from eg where v3z is not null),
reg as (select session_id, mx, my, mz, (xz*yy - yz*xy)/(xx*yy - xy*xy) as p, (yz*xx - xz*xy)/(xx*yy - xy*xy) as q from c where xx*yy - xy*xy > 1e-9),
lsq as (select session_id, -p/sqrt(1+p*p+q*q) as ax, -q/sqrt(1+p*p+q*q) as ay, 1/sqrt(1+p*p+q*q) as az, (p*mx+q*my-mz)/sqrt(1+p*p+q*q) as d, p, q from reg),
res as (select g.*, abs(ax*x+ay*y+az*z+d) as r, stddev_pop(ax*x+ay*y+az*z+d) over (partition by g.session_id) as s from g join lsq using (session_id)),
c2 as (select session_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, {_POP} from res where r <= 1.5*s group by 1), reg2 as (select session_id, n, mx, my, mz, (xz*yy - yz*xy)/(xx*yy - xy*xy) as p, (yz*xx - xz*xy)/(xx*yy - xy*xy) as q from c2 where xx*yy - xy*xy > 1e-9),
rob as (select session_id, -p/sqrt(1+p*p+q*q) as ax, -q/sqrt(1+p*p+q*q) as ay, 1/sqrt(1+p*p+q*q) as az, (p*mx+q*my-mz)/sqrt(1+p*p+q*q) as d, n from reg2),
j as (select c.session_id, c.n, least(1, c.n / 400.0) as k1, case when tls.rms is not null then 1/(1+tls.rms) end as k2, rob.n / c.n::double as k3, degrees(acos(least(1, tls.ax*lsq.ax+tls.ay*lsq.ay+tls.az*lsq.az))) as a01, abs(tls.d-lsq.d) as o01, degrees(acos(least(1, tls.ax*rob.ax+tls.ay*rob.ay+tls.az*rob.az))) as a02, abs(tls.d-rob.d) as o02, degrees(acos(least(1, lsq.ax*rob.ax+lsq.ay*rob.ay+lsq.az*rob.az))) as a12, abs(lsq.d-rob.d) as o12
 from c left join tls using (session_id) left join lsq using (session_id) left join rob using (session_id)),
l as (select *, case when a01 <= 2 and o01 <= 0.05 then 'GOOD' when a01 <= 8 and o01 <= 0.25 then 'DEGRADED' when a01 is not null then 'CONFLICT' end as l01, case when a02 <= 2 and o02 <= 0.05 then 'GOOD' when a02 <= 8 and o02 <= 0.25 then 'DEGRADED' when a02 is not null then 'CONFLICT' end as l02, case when a12 <= 2 and o12 <= 0.05 then 'GOOD' when a12 <= 8 and o12 <= 0.25 then 'DEGRADED' when a12 is not null then 'CONFLICT' end as l12 from j),
s as (select *, coalesce(l01 in ('GOOD','DEGRADED'), false) as k01, coalesce(l02 in ('GOOD','DEGRADED'), false) as k02, coalesce(l12 in ('GOOD','DEGRADED'), false) as k12 from l),
u as (select *, case when k01 and k02 and k12 then 'tls,lsq,robust' when k01 and not k02 and not k12 then 'tls,lsq' when k02 and not k01 and not k12 then 'tls,robust' when k12 and not k01 and not k02 then 'lsq,robust' end as sup, case when k01 and k02 and k12 then least(k2, k1, k3) when k01 and not k02 and not k12 then least(k2, k1) when k02 and not k01 and not k12 then least(k2, k3) when k12 and not k01 and not k02 then least(k1, k3) end as sure from s),
v as (select *, case when l01 = 'GOOD' and l02 = 'GOOD' and l12 = 'GOOD' then 'GOOD' when sup is not null then 'DEGRADED' else 'BAD' end as s0 from u), x as (select *, case when s0 = 'GOOD' and coalesce(sure, 0) < 0.6 then 'DEGRADED' else s0 end as s1 from v), y as (select *, case when s1 = 'DEGRADED' and coalesce(sure, 0) < 0.3 then 'BAD' else s1 end as status from x)"""


@query(f"with {_EST} select session_id, n, l01, l02, l12, status, case when status <> 'BAD' then sup end as support, round(case status when 'GOOD' then sure when 'DEGRADED' then least(sure, 0.7) else 0 end, 4) as confidence from y")
def plane_consensus(spark, d):
    """Three estimates of a session's ground (total least squares, vertical least squares, the latter again without far
    points): how each pair agrees, which clique stands, and with what confidence."""
    g = valid_points(spark, d).filter("z < -1.6").select("session_id", "x", "y", "z")
    c = agg.covariance(g, ["session_id"]).filter("n >= 30")
    e = agg.with_eigen(c)
    up = F.signum("v3z")
    tls = e.filter("v3z is not null").select("session_id", *[(F.col(f"v3{k}") * up).alias(f"t{k}") for k in "xyz"], (-(F.col("v3x") * F.col("mx") + F.col("v3y") * F.col("my") + F.col("v3z") * F.col("mz")) * up).alias("td"), (1 / (1 + F.sqrt(F.greatest("l3", F.lit(0.0))))).alias("k2"))
    lsq = agg.vertical_plane(c, "l")
    far = g.join(lsq, "session_id").withColumn("r", F.col("lx") * F.col("x") + F.col("ly") * F.col("y") + F.col("lz") * F.col("z") + F.col("ld"))
    far = far.withColumn("s", F.stddev_pop("r").over(W.partitionBy("session_id"))).filter(F.abs("r") <= 1.5 * F.col("s"))
    c2 = agg.covariance(far, ["session_id"])
    rob = agg.vertical_plane(c2, "r").join(c2.select("session_id", F.col("n").alias("rn")), "session_id")
    j = c.select("session_id", "n").join(tls, "session_id", "left").join(lsq, "session_id", "left").join(rob, "session_id", "left")

    def level(a, b):
        angle = F.degrees(F.acos(F.least(F.lit(1.0), sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in "yz"), F.col(f"{a}x") * F.col(f"{b}x")))))
        gap = F.abs(F.col(f"{a}d") - F.col(f"{b}d"))
        return F.when((angle <= 2) & (gap <= 0.05), "GOOD").when((angle <= 8) & (gap <= 0.25), "DEGRADED").when(angle.isNotNull(), "CONFLICT")

    j = j.withColumns({"l01": level("t", "l"), "l02": level("t", "r"), "l12": level("l", "r"), "k1": F.least(F.lit(1.0), F.col("n") / 400.0), "k3": F.col("rn") / F.col("n")})
    s = ev.agreement([F.col("l01"), F.col("l02"), F.col("l12")], ["tls", "lsq", "robust"], [F.col("k2"), F.col("k1"), F.col("k3")], 0.7, 0.6, 0.3)
    j = j.withColumn("s", s)
    return j.select("session_id", "n", "l01", "l02", "l12", F.col("s.status").alias("status"), F.array_join("s.support", ",").alias("support"), rnd("s.confidence", 4).alias("confidence"))


@query(f"""with {OKP}, v as (select session_id, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n from ok where frame_index % 2 = 0 group by 1, 2, 3, 4),
p as (select session_id, point_id, x, y, z, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz, least(greatest(0.1 + 0.02*sqrt(x*x+y*y), 0.1), 0.3) as tau from ok where frame_index % 2 = 1),
k as (select p.point_id, p.session_id, max(case when v.cx = p.cx and v.cy = p.cy and v.cz = p.cz then v.n end) as own, min((p.x-v.x)**2+(p.y-v.y)**2+(p.z-v.z)**2) as d2, bool_or(v.n >= 2 and (p.x-v.x)**2+(p.y-v.y)**2+(p.z-v.z)**2 <= tau*tau) as near from p left join v on v.session_id = p.session_id and abs(v.cx-p.cx) <= 1 and abs(v.cy-p.cy) <= 1 and abs(v.cz-p.cz) <= 1 group by 1, 2)
select session_id, case when own >= 3 then 'occupied' when d2 <= 0.12*0.12 then 'near_centroid' when near then 'adaptive' else 'new' end as reason, count(*) as points from k group by 1, 2""")
def envelope_groups(spark, d):
    """Points of the odd frames against the envelope of the even ones: in an occupied voxel, near a centroid, within a
    threshold that grows with distance, or new."""
    p = valid_points(spark, d)
    cell = [F.floor(F.col(c) / 0.4).cast("bigint").alias(f"c{c}") for c in "xyz"]
    env = agg.voxel_centroids(p.filter("frame_index % 2 = 0"), ["session_id"], 0.4)
    now = p.filter("frame_index % 2 = 1").select("session_id", "point_id", "x", "y", "z", *cell)
    tau = F.least(F.greatest(0.1 + 0.02 * F.hypot("x", "y"), F.lit(0.1)), F.lit(0.3))
    return ev.envelope_reason(now, env, ["session_id"], tau, 0.12, 3, 2).groupBy("session_id", "reason").agg(F.count("*").alias("points"))
