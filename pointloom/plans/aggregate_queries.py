"""Aggregations, ranking, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..operators import aggregates as agg
from .adapters import OKP, PLN, PTS, REC, eigen_sql, planes, points, records, valid_points
from .geometry_queries import _GRID, grid_cells, rnd
from .join_queries import _VOX, voxels
from .registry import query


@query(f"""with {OKP}, p as (select point_id, session_id, frame_index, ring, floor((degrees(atan2(y, x)) + 180.0) / 11.25)::int as az, sqrt(x*x+y*y+z*z) as r from ok),
k as (select *, row_number() over w as rn, count(*) over (partition by session_id, frame_index, ring, az) - 1 as duplicates from p window w as (partition by session_id, frame_index, ring, az order by r, point_id))
select session_id, frame_index, ring, az, point_id, round(r, 6) as range_m, duplicates from k where rn = 1""")
def nearest_returns(spark, d):
    from ..operators.geometry import with_polar

    p = with_polar(valid_points(spark, d)).select("session_id", "frame_index", "ring", F.floor((F.col("azimuth_deg") + 180.0) / 11.25).cast("int").alias("az"), "range_m", "point_id")
    return agg.nearest_return(p, ["session_id", "frame_index", "ring", "az"], "range_m", "point_id").withColumn("range_m", rnd("range_m"))


@query(f"""with {_GRID}, m as (select ring, col, count(*) as n, median(range_m) as med from g group by 1, 2), a as (select g.ring, g.col, median(abs(range_m - med)) as mad from g join m using (ring, col) group by 1, 2)
select ring, col, n, round(med, 6) as median, round(greatest(0.005, 1.4826 * mad), 6) as sigma, n >= 5 as known from m join a using (ring, col)""")
def robust_background(spark, d):
    return agg.robust_background(grid_cells(spark, d), ["ring", "col"], "range_m", 5).select("ring", "col", "n", rnd("median").alias("median"), rnd("sigma").alias("sigma"), "known")


@query(f"with {_GRID}, r as (select ring, col, range_m, row_number() over (partition by ring, col order by range_m) as rn, count(*) over (partition by ring, col) as n from g) select ring, col, round(range_m, 6) as q98 from r where rn = least(floor(n * 0.98), n - 1) + 1")
def order_statistic_background(spark, d):
    return agg.order_statistic(grid_cells(spark, d), ["ring", "col"], "range_m", 0.98).select("ring", "col", rnd("range_m").alias("q98"))


@query(f"with {_VOX} select session_id, cx, cy, cz, n, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from vx")
def voxel_centroids(spark, d):
    return voxels(spark, d).select("session_id", "cx", "cy", "cz", "n", *[rnd(c).alias(c) for c in "xyz"])


@query(f"""with {OKP} select session_id, count(*) as n, round(sum(x), 4) as x_sum, round(sum(x*x), 4) as x_sq, round(min(x), 6) as x_min, round(max(x), 6) as x_max, round(sum(z), 4) as z_sum, round(sum(z*z), 4) as z_sq, round(min(z), 6) as z_min, round(max(z), 6) as z_max, min(frame_index) as first, max(frame_index) as last from ok group by 1""")
def merged_moments(spark, d):
    """Moments per session and frame, merged to sessions: partial and final in two steps, as a stream would."""
    m = agg.moments(valid_points(spark, d), ["session_id", "frame_index"], ["x", "z"], "frame_index")
    r = agg.merge_moments(m, ["session_id"], ["x", "z"])
    return r.select("session_id", "n", *[rnd(f"{c}_{k}", 4 if k in ("sum", "sq") else 6).alias(f"{c}_{k}") for c in "xz" for k in ("sum", "sq", "min", "max")], "first", "last")


@query(f"with {OKP} select session_id, frame_index, count(*) as n, round(median(x), 6) as x_mid, round(median(y), 6) as y_mid, round(median(z), 6) as z_mid, round(min(x), 6) as x_min, round(min(y), 6) as y_min, round(min(z), 6) as z_min, round(max(x)-min(x), 6) as x_span, round(max(y)-min(y), 6) as y_span, round(max(z)-min(z), 6) as z_span from ok group by 1, 2")
def component_statistics(spark, d):
    c = agg.component_stats(valid_points(spark, d), ["session_id", "frame_index"])
    return c.select("session_id", "frame_index", "n", *[rnd(f"{k}_{s}").alias(f"{k}_{s}") for s in ("mid", "min", "span") for k in "xyz"])


@query(f"with {OKP}, {PLN}, h as (select session_id, nx*x+ny*y+nz*z+d as h from ok join pln using (sensor_id)) select session_id, round(min(h), 6) as min, round(quantile_cont(h, 0.1), 6) as p10, round(median(h), 6) as median, round(quantile_cont(h, 0.9), 6) as p90, round(max(h), 6) as max, round(quantile_cont(h, 0.95) - quantile_cont(h, 0.05), 6) as span from h group by 1")
def height_statistics(spark, d):
    from ..operators.geometry import plane_height

    p = valid_points(spark, d).join(planes(spark, d), "sensor_id").select("session_id", plane_height().alias("h"))
    return agg.height_stats(p, ["session_id"], "h").select("session_id", *[rnd(c).alias(c) for c in ("min", "p10", "median", "p90", "max", "span")])


@query(f"""with {OKP}, m as (select session_id, count(*) as n, sum(w*x)/sum(w) as mx, sum(w*y)/sum(w) as my, sum(w*z)/sum(w) as mz, sum(w) as w from (select *, 1 + coalesce(intensity, 0) as w from ok) group by 1)
select ok.session_id, n, round(sum((1+coalesce(intensity,0))*(x-mx)*(x-mx))/w, 6) as xx, round(sum((1+coalesce(intensity,0))*(x-mx)*(y-my))/w, 6) as xy, round(sum((1+coalesce(intensity,0))*(x-mx)*(z-mz))/w, 6) as xz, round(sum((1+coalesce(intensity,0))*(y-my)*(y-my))/w, 6) as yy,
 round(sum((1+coalesce(intensity,0))*(y-my)*(z-mz))/w, 6) as yz, round(sum((1+coalesce(intensity,0))*(z-mz)*(z-mz))/w, 6) as zz from ok join m using (session_id) group by ok.session_id, n, w""")
def weighted_covariance(spark, d):
    c = agg.covariance(valid_points(spark, d), ["session_id"], 1 + F.coalesce("intensity", F.lit(0.0)))
    return c.select("session_id", "n", *[rnd(k).alias(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


_COV = "count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as xx, covar_pop(x, y) as xy, covar_pop(x, z) as xz, var_pop(y) as yy, covar_pop(y, z) as yz, var_pop(z) as zz"


@query(f"""with {OKP}, c as (select session_id, {_COV} from ok group by 1), {eigen_sql("c")}
select session_id, round(l1, 5) as l1, round(l2, 5) as l2, round(l3, 5) as l3, round(abs(v1x), 3) as vx, round(abs(v1y), 3) as vy, round(abs(v1z), 3) as vz, round(abs(xx*v1x + xy*v1y + xz*v1z - l1*v1x) + abs(xy*v1x + yy*v1y + yz*v1z - l1*v1y) + abs(xz*v1x + yz*v1y + zz*v1z - l1*v1z), 6) as residual from eg""")
def principal_axes(spark, d):
    """Eigenvalues and main axis in closed form (no axis where the next eigenvalue is within a tenth), and A v - l v."""
    c = agg.covariance(valid_points(spark, d), ["session_id"])
    e = agg.with_eigen(c)
    a = {k: F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    v = [F.col(f"v1{k}") for k in "xyz"]
    rows = [("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz")]
    off = sum((F.abs(sum((a[m] * u for m, u in zip(r[1:], v[1:])), a[r[0]] * v[0]) - F.col("l1") * w) for r, w in zip(rows, v)), F.lit(0.0))
    return e.select("session_id", *[rnd(k, 5).alias(k) for k in ("l1", "l2", "l3")], *[rnd(F.abs(u), 3).alias(f"v{k}") for k, u in zip("xyz", v)], rnd(off).alias("residual"))


@query(f"with {OKP} select session_id, least(floor((z + 3) / 0.25), 11)::int as bin, count(*) as rows from ok where z between -3 and 0 group by 1, 2")
def height_histogram(spark, d):
    return agg.histogram(valid_points(spark, d), ["session_id"], "z", -3.0, 0.0, 12)


@query(f"""with {OKP}, c as (select distinct session_id, floor(x/0.3)::bigint as cx, floor(y/0.3)::bigint as cy, floor(z/0.3)::bigint as cz from ok), e as (select session_id, cx, cy, count(*) as high, max(cz)-min(cz)+1 as tall from c group by 1, 2, 3)
select session_id, count(*) as cells_2d, sum(high)::bigint as cells_3d, round(count(*) * 0.3::double * 0.3::double, 6) as area_m2, round(sum(high) / sum(tall)::double, 6) as vertical_fill from e group by 1""")
def occupied_cells(spark, d):
    return agg.occupied_cells(valid_points(spark, d), ["session_id"], 0.3).withColumns({"area_m2": rnd("area_m2"), "vertical_fill": rnd("vertical_fill")})


@query(f"""with {OKP}, {PLN}, h as (select sensor_id, ring // 64 as region, nx*x+ny*y+nz*z+d as r from ok join pln using (sensor_id) where ring between 0 and 191)
select sensor_id, region, count(r) as n, count_if(r = 0) as zeros, round(sqrt(avg(r*r)), 6) as rms, round(quantile_cont(abs(r), 0.95), 6) as p95_abs, round(median(r), 6) as median, round(min(r), 6) as min, round(max(r), 6) as max from h group by grouping sets ((sensor_id, region), (sensor_id), ())""")
def residuals_by_region(spark, d):
    """Residual statistics per region, per sensor and over all in one pass (grouping sets)."""
    from ..operators.geometry import plane_height

    p = valid_points(spark, d).filter("ring between 0 and 191").join(planes(spark, d), "sensor_id").select("sensor_id", F.floor(F.col("ring") / 64).cast("int").alias("region"), plane_height().alias("r"))
    g = p.groupingSets([["sensor_id", "region"], ["sensor_id"], []], "sensor_id", "region").agg(*agg.residual_stats(F.col("r")))
    return g.select("sensor_id", "region", "n", "zeros", *[rnd(c).alias(c) for c in ("rms", "p95_abs", "median", "min", "max")])


@query(f"""with {OKP}, c as (select session_id, floor(x/1.0)::bigint as cx, floor(y/1.0)::bigint as cy, frame_index, count(*) as n from ok group by 1, 2, 3, 4), f as (select session_id, count(distinct frame_index) as frames from ok group by 1)
select c.session_id, cx, cy, sum(n)::bigint as points_seen, count(distinct frame_index) as frames_seen, round(count(distinct frame_index) / frames::double, 6) as hit_ratio, case when count(distinct frame_index) = frames then min(n) else 0 end as min_per_frame from c join f using (session_id) group by c.session_id, cx, cy, frames""")
def cell_occupancy(spark, d):
    """Points and frames seen per cell, hit ratio and the least count over all frames (0 where one frame has none)."""
    p = valid_points(spark, d)
    c = p.groupBy("session_id", F.floor("x").alias("cx"), F.floor("y").alias("cy"), "frame_index").agg(F.count("*").alias("n"))
    f = p.groupBy("session_id").agg(F.count_distinct("frame_index").alias("frames"))
    o = c.groupBy("session_id", "cx", "cy").agg(F.sum("n").alias("points_seen"), F.count("frame_index").alias("frames_seen"), F.min("n").alias("least")).join(f, "session_id")
    return o.select("session_id", "cx", "cy", "points_seen", "frames_seen", rnd(F.col("frames_seen") / F.col("frames")).alias("hit_ratio"), F.when(F.col("frames_seen") == F.col("frames"), F.col("least")).otherwise(0).alias("min_per_frame"))


@query(f"""with {OKP}, c as (select session_id, floor(x)::bigint as cx, floor(y)::bigint as cy, count(*) as n from ok group by 1, 2, 3) select session_id, count(*) as cells, round(max(n) / sum(n)::double, 6) as max_share, (max(cx) - min(cx) + 1) as extent_x, (max(cy) - min(cy) + 1) as extent_y from c group by 1""")
def coverage(spark, d):
    c = valid_points(spark, d).groupBy("session_id", F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(F.count("*").alias("n"))
    return c.groupBy("session_id").agg(F.count("*").alias("cells"), rnd(F.max("n") / F.sum("n")).alias("max_share"), (F.max("cx") - F.min("cx") + 1).alias("extent_x"), (F.max("cy") - F.min("cy") + 1).alias("extent_y"))


@query(f"with {REC} select session_id, count(*) as rows, round(sum(case when measured then 1 else 0 end) / nullif(count(measured), 0)::double, 6) as measured_ratio, case when count(measured) = 0 then 'no_denominator' end as reason from rec group by 1")
def ratio_with_reason(spark, d):
    r = records(spark, d)
    n = F.count("measured")
    return r.groupBy("session_id").agg(F.count("*").alias("rows"), rnd(F.count_if("measured") / F.nullif(n, F.lit(0))).alias("measured_ratio"), F.when(n == 0, "no_denominator").alias("reason"))


_SCORED = f"""{REC}, sc as (select session_id, lower(trim(state)) in ('lying', 'low_posture') as truth, round(1.8 - height_median_m, 3) as score from rec where state is not null and height_median_m is not null)"""


def scored(spark, d):
    r = records(spark, d).filter("state is not null and height_median_m is not null")
    return r.select("session_id", F.lower(F.trim("state")).isin("lying", "low_posture").alias("truth"), F.round(1.8 - F.col("height_median_m"), 3).alias("score"))


@query(f"""with {_SCORED} select session_id, count_if(truth and score >= 1.3) as tp, count_if(not truth and score >= 1.3) as fp, count_if(truth and score < 1.3) as fn, count_if(not truth and score < 1.3) as tn,
 round(count_if(truth and score >= 1.3) / nullif(count_if(score >= 1.3), 0)::double, 6) as precision, round(count_if(truth and score >= 1.3) / nullif(count_if(truth), 0)::double, 6) as recall,
 round(2 * count_if(truth and score >= 1.3) / nullif(2 * count_if(truth and score >= 1.3) + count_if(not truth and score >= 1.3) + count_if(truth and score < 1.3), 0)::double, 6) as f1 from sc group by 1""")
def confusion_scores(spark, d):
    c = agg.confusion(F.col("truth"), F.col("score") >= 1.3)
    r = scored(spark, d).groupBy("session_id").agg(*[v.alias(k) for k, v in c.items()])
    return r.withColumns({k: rnd(k) for k in ("precision", "recall", "f1")})


@query(f"with {_SCORED}, g as (select score, count_if(truth) as pos, count(*) as n from sc group by 1), s as (select score, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as a, sum(pos) over () as p from g) select score, tp::bigint as tp, (a - tp)::bigint as fp, round(tp / a, 6) as precision, round(tp / nullif(p, 0), 6) as recall from s")
def threshold_sweep(spark, d):
    s = agg.threshold_sweep(scored(spark, d), "truth", "score")
    return s.select("score", "tp", "fp", rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query(f"with {_SCORED}, g as (select score, count_if(truth) as pos, count(*) as n from sc group by 1), s as (select score, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as a, sum(pos) over () as p from g), r as (select score, tp / a as pr, tp / nullif(p, 0) as rc from s) select round(sum((rc - lg) * pr), 6) as average_precision from (select *, coalesce(lag(rc) over (order by score desc), 0) as lg from r)")
def average_precision(spark, d):
    return agg.average_precision(scored(spark, d), "truth", "score").select(rnd("average_precision").alias("average_precision"))


@query(f"with {_SCORED}, g as (select score, count_if(truth) as pos, count(*) as n from sc group by 1), s as (select score, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as a, sum(pos) over () as p from g), f as (select score, round(2 * tp / (a + p), 9) as f1 from s) select score, f1 from f order by f1 desc, score desc limit 1")
def best_threshold(spark, d):
    """The threshold with the greatest F1."""
    return agg.best_f1(scored(spark, d), "truth", "score").select("score", rnd("f1", 9).alias("f1"))


@query(f"""with {_SCORED}, a as (select session_id, count_if(truth) as k, count(*) as n from sc group by 1) select session_id, k, n,
 round((k/n::double + 3.841458820694124/(2*n)) / (1 + 3.841458820694124/n) - 1.959963984540054 * sqrt((k/n::double)*(1-k/n::double)/n + 3.841458820694124/(4*n*n)) / (1 + 3.841458820694124/n), 6) as low,
 round((k/n::double + 3.841458820694124/(2*n)) / (1 + 3.841458820694124/n) + 1.959963984540054 * sqrt((k/n::double)*(1-k/n::double)/n + 3.841458820694124/(4*n*n)) / (1 + 3.841458820694124/n), 6) as high from a""")
def wilson_intervals(spark, d):
    a = scored(spark, d).groupBy("session_id").agg(F.count_if("truth").alias("k"), F.count("*").alias("n"))
    lo, hi = agg.wilson(F.col("k"), F.col("n"))
    return a.select("session_id", "k", "n", rnd(lo).alias("low"), rnd(hi).alias("high"))


@query(f"with {REC}, c as (select distinct sid, sensor_id from session_catalog), j as (select c.sensor_id, r.session_id, r.height_median_m as h from rec r left join (select sid, max(sensor_id) as sensor_id from c group by 1) c on r.session_id = c.sid) select sensor_id, session_id, count(*) as rows, count(h) as measured, round(avg(h), 6) as mean_height from j group by rollup (sensor_id, session_id)")
def rollup_by_sensor(spark, d):
    c = table(spark, d, "session_catalog").groupBy(F.col("sid").alias("session_id")).agg(F.max("sensor_id").alias("sensor_id"))
    j = records(spark, d).join(c, "session_id", "left")
    # summed as decimals: a mean at the edge of rounding doesn't hang on the order of the rows
    mean = F.avg(F.col("height_median_m").cast("decimal(24,10)")).cast("double")
    return j.rollup("sensor_id", "session_id").agg(F.count("*").alias("rows"), F.count("height_median_m").alias("measured"), rnd(mean).alias("mean_height"))


@query(f"""with {REC}, h as (select session_id, height_median_m as v, row_number() over (partition by session_id order by height_median_m) - 1 as r, count(*) over (partition by session_id) as n from rec where height_median_m is not null)
select session_id, q, round(v, 6) as nearest from h cross join (values (0.5), (0.95), (0.99)) t(q) where r = round_even(q::double * (n - 1), 0)""")
def nearest_rank_percentiles(spark, d):
    return agg.percentile_nearest(records(spark, d), ["session_id"], "height_median_m", [0.5, 0.95, 0.99]).select("session_id", F.col("q").cast("decimal(3,2)").alias("q"), rnd("height_median_m").alias("nearest"))


@query(f"""with {PTS}, r as (select *, row_number() over (partition by session_id order by frame_index, source_row, point_id) - 1 as r, count(*) over (partition by session_id) as n from pts) select point_id, session_id from r where r % ceil(n / 200.0)::bigint = 0""")
def stride_sample(spark, d):
    return agg.sampled_stride(points(spark, d), ["session_id"], ["frame_index", "source_row", "point_id"], 200).select("point_id", "session_id")


@query(f"""with {OKP}, k as (select session_id, point_id, row_number() over (partition by session_id order by x, y, z, point_id) - 1 as r, count(*) over (partition by session_id) as n from ok)
select distinct session_id, point_id from k join range(64) t(i) on r = (i * (n - 1)) // 63 where n >= 64""")
def even_sample(spark, d):
    """64 evenly spaced rows of each session in canonical coordinate order."""
    w = W.partitionBy("session_id")
    k = valid_points(spark, d).select("session_id", "point_id", (F.row_number().over(w.orderBy("x", "y", "z", "point_id")) - 1).alias("r"), F.count("*").over(w).alias("n")).filter("n >= 64")
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(i * (F.col("n") - 1) / 63))
    return k.filter(F.array_contains(at, F.col("r"))).select("session_id", "point_id")


@query(f"with {OKP}, k as (select *, row_number() over (partition by session_id order by intensity desc nulls last, point_id) as rk from ok) select session_id, point_id, rk from k where rk <= 8")
def top_eight(spark, d):
    w = W.partitionBy("session_id").orderBy(F.desc_nulls_last("intensity"), "point_id")
    return valid_points(spark, d).withColumn("rk", F.row_number().over(w)).filter("rk <= 8").select("session_id", "point_id", "rk")


@query(f"""with {OKP}, k as (select session_id, point_id, floor(x)::bigint as cx, floor(y)::bigint as cy, row_number() over (partition by session_id, floor(x), floor(y) order by point_id) as rk, count(*) over (partition by session_id, floor(x), floor(y)) as n from ok) select session_id, cx, cy, point_id, n > 3 as truncated from k where rk <= 3""")
def balanced_cell_sample(spark, d):
    w = W.partitionBy("session_id", "cx", "cy")
    k = valid_points(spark, d).withColumns({"cx": F.floor("x"), "cy": F.floor("y")})
    k = k.select("session_id", "cx", "cy", "point_id", F.row_number().over(w.orderBy("point_id")).alias("rk"), (F.count("*").over(w) > 3).alias("truncated"))
    return k.filter("rk <= 3").select("session_id", "cx", "cy", "point_id", "truncated")


@query(f"with {OKP}, a as (select session_id, frame_index, count(*) as n, avg(z) as z from ok group by 1, 2), m as (select session_id, min((n, frame_index)) as lo, max((n, -frame_index)) as hi from (select session_id, n, frame_index from a where frame_index is not null) group by 1) select session_id, frame_index as fewest_frame, n as fewest from (select *, row_number() over (partition by session_id order by n, frame_index) as rn from a where frame_index is not null) where rn = 1")
def argmin_with_ties(spark, d):
    a = valid_points(spark, d).filter("frame_index is not null").groupBy("session_id", "frame_index").agg(F.count("*").alias("n"))
    return a.groupBy("session_id").agg(F.min(F.struct("n", "frame_index")).alias("m")).select("session_id", F.col("m.frame_index").alias("fewest_frame"), F.col("m.n").alias("fewest"))


_SETS = f"""{OKP}, a as (select distinct session_id, floor(x/0.5)::bigint * 4096 + floor(y/0.5)::bigint as cell from ok where frame_index % 2 = 0), b as (select distinct session_id, floor(x/0.5)::bigint * 4096 + floor(y/0.5)::bigint as cell from ok where frame_index % 2 = 1)"""


def _even_odd(spark, d):
    p = valid_points(spark, d).select("session_id", "frame_index", (F.floor(F.col("x") / 0.5) * 4096 + F.floor(F.col("y") / 0.5)).alias("cell"))
    return p.filter("frame_index % 2 = 0").select("session_id", "cell").distinct(), p.filter("frame_index % 2 = 1").select("session_id", "cell").distinct()


@query(f"with {_SETS}, u as (select session_id, cell, true as l, false as r from a union all select session_id, cell, false, true from b), k as (select session_id, cell, bool_or(l) as l, bool_or(r) as r from u group by 1, 2) select session_id, count(*) as union_n, count_if(l and r) as common, count_if(l and not r) as removed, count_if(r and not l) as added, round(count_if(l and r) / count(*)::double, 6) as jaccard, round(count_if(l and r) / nullif(least(count_if(l), count_if(r)), 0)::double, 6) as containment, round(2 * count_if(l and r) / (count_if(l) + count_if(r))::double, 6) as dice from k group by 1")
def set_similarity(spark, d):
    a, b = _even_odd(spark, d)
    k = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), ["session_id", "cell"], "full_outer").fillna(False, ["l", "r"])
    both, l, r = F.count_if(F.col("l") & F.col("r")), F.count_if("l"), F.count_if("r")
    return k.groupBy("session_id").agg(
        F.count("*").alias("union_n"), both.alias("common"), F.count_if(F.col("l") & ~F.col("r")).alias("removed"), F.count_if(F.col("r") & ~F.col("l")).alias("added"),
        rnd(both / F.count("*")).alias("jaccard"), rnd(both / F.nullif(F.least(l, r), F.lit(0))).alias("containment"), rnd(2 * both / (l + r)).alias("dice"),
    )


@query(f"with {_SETS} select 'union' as op, count(*) as rows from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b) union all select 'symmetric', count(*) from ((select * from a except select * from b) union all (select * from b except select * from a))")
def set_operations(spark, d):
    a, b = _even_odd(spark, d)
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "symmetric": a.subtract(b).union(b.subtract(a))}
    out = None
    for name, x in ops.items():
        r = x.agg(F.count("*").alias("rows")).select(F.lit(name).alias("op"), "rows")
        out = r if out is None else out.union(r)
    return out


@query(f"""with {OKP}, {PLN}, b as (select zone_id, z.sensor_id, x_min, x_max, y_min, y_max, z_min, z_max from zones z), s as (select session_id, max(sensor_id) as sensor_id from ok group by 1),
f as (select session_id, frame_index from ok where frame_index is not null group by 1, 2), k as (select f.session_id, f.frame_index, b.zone_id from f join s using (session_id) join b using (sensor_id)),
h as (select ok.session_id, frame_index, zone_id, count(*) as n, median(z) as med from ok join b using (sensor_id) where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max group by 1, 2, 3)
select k.session_id, k.zone_id, count(*) as frames, sum(coalesce(n, 0))::bigint as points, count(n) as seen, round(stddev_pop(med), 6) as median_spread from k left join h using (session_id, frame_index, zone_id) group by 1, 2""")
def boxes_by_frames(spark, d):
    """Each zone against each frame of its sensor's sessions, frames without a point included."""
    p = valid_points(spark, d)
    z = table(spark, d, "zones").select("zone_id", "sensor_id", *[f"{c}_{m}" for c in "xyz" for m in ("min", "max")])
    f = p.filter("frame_index is not null").select("session_id", "frame_index").distinct()
    k = f.join(p.groupBy("session_id").agg(F.max("sensor_id").alias("sensor_id")), "session_id").join(z.select("zone_id", "sensor_id"), "sensor_id")
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(c) >= F.col(f"{c}_min")) & (F.col(c) < F.col(f"{c}_max"))
    h = p.join(z, "sensor_id").filter(inside).groupBy("session_id", "frame_index", "zone_id").agg(F.count("*").alias("n"), F.percentile("z", 0.5).alias("med"))
    j = k.join(h, ["session_id", "frame_index", "zone_id"], "left")
    return j.groupBy("session_id", "zone_id").agg(F.count("*").alias("frames"), F.sum(F.coalesce("n", F.lit(0))).alias("points"), F.count("n").alias("seen"), rnd(F.stddev_pop("med")).alias("median_spread"))
