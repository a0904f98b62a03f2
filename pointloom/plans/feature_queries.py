"""Feature vectors, shape evidence and estimates of planes, with closed-form oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import fitting as fit
from ..operators import geometry as geo
from .adapters import OKP, PLN, eigen_sql, planes, valid_points
from .geometry_queries import rnd
from .registry import query

KEY = ["session_id", "frame_index"]
_SAMP = "var_samp(x) as xx, covar_samp(x, y) as xy, covar_samp(x, z) as xz, var_samp(y) as yy, covar_samp(y, z) as yz, var_samp(z) as zz"
_POP = _SAMP.replace("_samp", "_pop")
_LAYERS = ", ".join(f"count_if(h >= {a} and h {'<=' if k == 8 else '<'} {b}) as layer_{k}" for k, (a, b) in enumerate(zip(ft.LAYERS, ft.LAYERS[1:])))


@query(f"""with {OKP}, {PLN}, h as (select session_id, frame_index, x, y, z, nx*x+ny*y+nz*z+d as h from ok join pln using (sensor_id) where frame_index is not null),
c as (select session_id, frame_index, count(*) as n, max(x)-min(x) as span_x, max(y)-min(y) as span_y, max(z)-min(z) as span_z, {_POP}, {_LAYERS}, count_if(h < {ft.LAYERS[0]} or h > {ft.LAYERS[-1]}) as layer_out from h group by 1, 2 having count(*) >= 6), {eigen_sql("c")}
select session_id, frame_index, n, round(span_x, 6) as span_x, round(span_y, 6) as span_y, round(span_z, 6) as span_z, round(l1, 5) as l1, round(l2, 5) as l2, round(l3, 5) as l3, round(case when l1 > 1e-12 then (l1-greatest(l2,0))/l1 end, 4) as linearity,
 round(case when l1 > 1e-12 then (greatest(l2,0)-greatest(l3,0))/l1 end, 4) as planarity, round(case when l1 > 1e-12 then greatest(l3,0)/l1 end, 4) as scattering, round(abs(v1z), 3) as verticality, v1z is null as axis_ambiguous, {", ".join(f"layer_{k}" for k in range(9))}, layer_out from eg""")
def structure_of_frames(spark, d):
    """Spans, eigenvalue ratios, main axis and height layers of each frame's points."""
    p = valid_points(spark, d).filter("frame_index is not null").join(planes(spark, d), "sensor_id").withColumn("h", geo.plane_height())
    e = ft.structure_evidence(p, KEY, "h").filter("n >= 6")
    return e.select(*KEY, "n", *[rnd(f"span_{c}").alias(f"span_{c}") for c in "xyz"], *[rnd(f"l{k}", 5).alias(f"l{k}") for k in (1, 2, 3)], *[rnd(c, 4).alias(c) for c in ("linearity", "planarity", "scattering")],
                    rnd("verticality", 3).alias("verticality"), "axis_ambiguous", *[f"layer_{k}" for k in range(9)], "layer_out")


_BANDS = ", ".join(f"count_if(z >= {a} and z < {b}) / count(*)::double as b{k}" for k, (a, b) in enumerate(ft.BANDS))
_F51 = ["n::double", "10.0::double", "greatest(n, 2000)::double", "coalesce(im, 0)", "log10(coalesce(isd, 0) + 1)", *[f"p{c}[{k}]" for c in "xyz" for k in (1, 2, 3)], *[f"b{k}" for k in range(9)], "mx", "my", "mz", "xx", "xy", "xz", "yy", "yz", "zz", "l1", "l2", "l3",
        "l1/greatest(l2, 1e-9)", "l2/greatest(l3, 1e-9)", "abs(v3z)", "sqrt(greatest(1 - v1z*v1z - v3z*v3z, 0))", "abs(v1z)", "l1/greatest(l3, 1e-9)", "rs", "pz[3]-pz[1]", "case when pz[3]-pz[1] > 0.01 then log10(abs(pz[3]-pz[1])) else 0 end", "case when mid > 0 then up / mid::double else 0 end",
        "pi[1]", "pi[2]", "pi[3]", "near", "pz[3]", "l1+l2+l3"]
#: The ratios to the least eigenvalue magnify rounding, the vertical parts come from a quotient.
_DIGITS = [2 if k in (35, 36, 40) else 3 if 37 <= k <= 39 else 4 for k in range(51)]


@query(f"""with {OKP}, c as (select session_id, frame_index, count(*) as n, avg(intensity) as im, stddev_pop(intensity) as isd, quantile_cont(x, [0.1, 0.5, 0.9]) as px, quantile_cont(y, [0.1, 0.5, 0.9]) as py, quantile_cont(z, [0.1, 0.5, 0.9]) as pz, quantile_cont(intensity, [0.1, 0.5, 0.9]) as pi,
 {_BANDS}, avg(x) as mx, avg(y) as my, avg(z) as mz, {_SAMP}, stddev_pop(sqrt(x*x+y*y)) as rs, count_if(z > 1.2 and z < 2.2) as up, count_if(z >= 0.4 and z < 1.2) as mid, count_if(sqrt(x*x+y*y) < 3.0) / count(*)::double as near from ok where frame_index is not null group by 1, 2 having count(*) >= 10), {eigen_sql("c")}
select session_id, frame_index, {", ".join(f"round({c}, {n}) as f{k}" for k, (c, n) in enumerate(zip(_F51, _DIGITS)))} from eg where l3 > 1e-5""")
def frame_vectors(spark, d):
    """51 numbers of each frame with ten points or more that isn't flat."""
    v = ft.frame_vector(valid_points(spark, d).filter("frame_index is not null"), KEY)
    return v.filter("f34 > 1e-5").select(*KEY, *[rnd(f"f{k}", n).alias(f"f{k}") for k, n in enumerate(_DIGITS)])


_F17 = ["linearity", "planarity", "scattering", "chord_max", "chord_mean", "chord_std", "layers", "fullest_share", "spacing", "kurtosis", "flat_ratio", "distance", "direction", "intensity_span", "log_points", "above_1_3", "above_0_1"]
_D17 = [3, 3, 3, 5, 5, 5, 0, 5, 5, 4, 4, 5, 5, 4, 6, 6, 6]


@query(f"""with {OKP}, f as (select * from ok where frame_index is not null), c as (select session_id, frame_index, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, min(z) as z0, quantile_cont(intensity, 0.9) - quantile_cont(intensity, 0.1) as ispan, count_if(z > 1.3) as hi, count_if(z > 0.1) as off, {_SAMP} from f group by 1, 2 having count(*) >= 10 and count(*) < 600), {eigen_sql("c")},
k as (select f.session_id, f.frame_index, max(sqrt((x-mx)**2+(y-my)**2)) as rmax, avg(sqrt((x-mx)**2+(y-my)**2)) as rmean, stddev_pop(sqrt((x-mx)**2+(y-my)**2)) as rstd, max(floor((z-z0)/0.10)) + 1 as layers, avg((z-mz)**4) / greatest(avg((z-mz)**2)**2, 1e-12) as kurt from f join c on f.session_id = c.session_id and f.frame_index = c.frame_index group by 1, 2),
l as (select session_id, frame_index, max(m) as fullest from (select f.session_id, f.frame_index, floor((z-z0)/0.10) as b, count(*) as m from f join c on f.session_id = c.session_id and f.frame_index = c.frame_index group by 1, 2, 3) group by 1, 2),
q as (select session_id, frame_index, sqrt(avg(d2)) as spacing from (select a.session_id, a.frame_index, (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 as d2, row_number() over (partition by a.session_id, a.frame_index, a.point_id order by (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as rn
  from f a join c on a.session_id = c.session_id and a.frame_index = c.frame_index join f b on a.session_id = b.session_id and a.frame_index = b.frame_index and a.point_id <> b.point_id) where rn <= 9 group by 1, 2)
select eg.session_id, eg.frame_index, round((l1-greatest(l2,0))/(l1+greatest(l2,0)+greatest(l3,0)), 3) as linearity, round((greatest(l2,0)-greatest(l3,0))/(l1+greatest(l2,0)+greatest(l3,0)), 3) as planarity, round(greatest(l3,0)/(l1+greatest(l2,0)+greatest(l3,0)), 3) as scattering, round(rmax, 5) as chord_max, round(rmean, 5) as chord_mean, round(rstd, 5) as chord_std, layers::double as layers, round(fullest/n::double, 5) as fullest_share,
 round(spacing, 5) as spacing, round(kurt, 4) as kurtosis, round(((xx+yy)/2 - sqrt(((xx-yy)/2)**2 + xy*xy)) / greatest((xx+yy)/2 + sqrt(((xx-yy)/2)**2 + xy*xy), 1e-9), 4) as flat_ratio, round(sqrt(mx*mx+my*my), 5) as distance, round(atan2(my, mx), 5) as direction, round(coalesce(ispan, 0), 4) as intensity_span, round(log10(n), 6) as log_points, round(hi/n::double, 6) as above_1_3, round(off/n::double, 6) as above_0_1
 from eg join k using (session_id, frame_index) join l using (session_id, frame_index) join q using (session_id, frame_index)""")
def frame_extensions(spark, d):
    """17 further numbers of each frame, with the spacing of neighbours."""

    def run(pdf):
        return [tuple(map(float, ft.frame_extension(pdf)))] if 10 <= len(pdf) < 600 else []

    p = valid_points(spark, d).filter("frame_index is not null").select(*KEY, "point_id", "x", "y", "z", "intensity")
    e = fit.per_group(p, KEY, ["point_id"], run, ", ".join(f"{c} double" for c in _F17))
    return e.select(*KEY, *[rnd(c, n).alias(c) for c, n in zip(_F17, _D17)])


_V19 = ["ln(1 + n)", "px[2]", "py[2]", "pz[2]", *[f"p{c}[{k}]-p{c}[2]" for k in (1, 2, 3) for c in "xyz"], *[f"greatest(l{i}, 0)" for i in (1, 2, 3)], *[f"greatest(l{i}, 0)/greatest(greatest(l1, 0)+greatest(l2, 0)+greatest(l3, 0), 1e-12)" for i in (1, 2, 3)]]


@query(f"""with {OKP}, c as (select session_id, frame_index, count(*) as n, quantile_cont(x, [0.1, 0.5, 0.9]) as px, quantile_cont(y, [0.1, 0.5, 0.9]) as py, quantile_cont(z, [0.1, 0.5, 0.9]) as pz, {_SAMP} from ok where frame_index is not null group by 1, 2 having count(*) >= 10), {eigen_sql("c")},
v as (select session_id, frame_index, [{", ".join(_V19)}] as v, (row_number() over (partition by session_id order by frame_index) - 1) as r from eg),
t as (select session_id, r // 5 as win, r, unnest(range(19)) as feature, unnest(v) as v0 from v), u as (select *, v0 - case when feature between 1 and 3 then first_value(v0) over (partition by session_id, win, feature order by r) else 0 end as x from t),
s as (select *, abs(x - lag(x) over (partition by session_id, win, feature order by r)) as step from u)
select session_id, win as window, feature::int as feature, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, round(quantile_cont(x, 0.1), 5) as p10, round(quantile_cont(x, 0.9), 5) as p90, round(avg(step), 5) as mean_step, round(arg_max(x, r) - arg_min(x, r), 5) as change from s group by 1, 2, 3 having count(*) = 5""")
def sequence_windows(spark, d):
    """114 numbers of every five frames in a row: six statistics of nineteen features, one row a feature."""
    v = ft.sequence_vector(valid_points(spark, d).filter("frame_index is not null"), KEY)
    s = ft.window_summary(v, ["session_id"], "frame_index", 5)
    return s.select("session_id", "window", "feature", *[rnd(c, 5).alias(c) for c in ("mean", "std", "p10", "p90", "mean_step", "change")])


@query(f"""with {OKP}, {PLN}, u as (select *, sqrt((1-nx*nx)*(1-nx*nx) + nx*nx*ny*ny + nx*nx*nz*nz) as n from pln), b as (select *, (1-nx*nx)/n as ux, -nx*ny/n as uy, -nx*nz/n as uz from u), t as (select *, ny*uz-nz*uy as vx, nz*ux-nx*uz as vy, nx*uy-ny*ux as vz from b),
p as (select session_id, ux*x+uy*y+uz*z as u, vx*x+vy*y+vz*z as v from ok join t using (sensor_id)), s as (select session_id, quantile_cont(u, 0.95) - quantile_cont(u, 0.05) as span_u, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) as span_v from p group by 1)
select session_id, round(span_u, 6) as span_u, round(span_v, 6) as span_v, round(greatest(span_u, span_v), 6) as horizontal_span from s""")
def tangent_spans(spark, d):
    """Robust spans (95th less 5th percentile) in the plane of the ground."""
    p = valid_points(spark, d).join(planes(spark, d).withColumns(geo.tangent_basis()), "sensor_id")
    dot = lambda k: F.col(f"{k}x") * F.col("x") + F.col(f"{k}y") * F.col("y") + F.col(f"{k}z") * F.col("z")
    q = p.select("session_id", dot("u").alias("u"), dot("v").alias("v")).groupBy("session_id").agg(*[F.percentile(c, [0.05, 0.95]).alias(c) for c in "uv"])
    u, v = (F.get(c, 1) - F.get(c, 0) for c in "uv")
    return q.select("session_id", rnd(u).alias("span_u"), rnd(v).alias("span_v"), rnd(F.greatest(u, v)).alias("horizontal_span"))
