"""Projections and filters over the point, frame and plane tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import filters as flt
from ..operators import geometry as geo
from .adapters import FRM, OKP, OKR, PLN, PTS, REC, ROW, frame_rows, frames, planes, point_rows, points, records, valid_points, valid_rows
from .registry import query


def rnd(c, n=6):
    return F.round(c, n)


@query(f"with {OKR} select point_id, round(sqrt(x*x+y*y+z*z), 6) as range_m, round(degrees(atan2(y, x)), 6) as azimuth_deg, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) as elevation_deg from ok")
def polar_coordinates(spark, d):
    return geo.with_polar(valid_rows(spark, d)).select("point_id", *[rnd(c).alias(c) for c in ("range_m", "azimuth_deg", "elevation_deg")])


@query(f"with {OKR}, {PLN} select point_id, round(nx*x + ny*y + nz*z + d, 6) as height_m from ok join pln using (sensor_id)")
def height_above_plane(spark, d):
    return valid_rows(spark, d).join(planes(spark, d), "sensor_id").select("point_id", rnd(geo.plane_height()).alias("height_m"))


@query(f"""with {ROW}, k as (select *, coalesce(isfinite(x) and isfinite(y) and isfinite(z) and not (x = 0 and y = 0 and z = 0), false) as mapped, radians(3.0) as p, radians(-2.0) as r from pts)
select point_id, mapped, case when isnan(case when mapped then cos(p)*x + sin(p)*z + 0.1 else x end) then null else round(case when mapped then cos(p)*x + sin(p)*z + 0.1 else x end, 6) end as x,
 case when mapped then round(sin(r)*sin(p)*x + cos(r)*y - sin(r)*cos(p)*z - 0.2, 6) end as y, case when mapped then round(-cos(r)*sin(p)*x + sin(r)*y + cos(r)*cos(p)*z + 2.4, 6) end as z from k""")
def rigid_transform_point_rows(spark, d):
    m = geo.rotation(F.radians(F.lit(3.0)), F.radians(F.lit(-2.0)))
    p = geo.rigid_transform(point_rows(spark, d), m, (0.1, -0.2, 2.4))
    return p.select("point_id", "mapped", F.when(~F.isnan("x"), rnd("x")).alias("x"), F.when(F.col("mapped"), rnd("y")).alias("y"), F.when(F.col("mapped"), rnd("z")).alias("z"))


@query(f"with {ROW}, k as (select isfinite(x) and isfinite(y) and isfinite(z) and not (x = 0 and y = 0 and z = 0) as ok from pts) select count(*) as rows, count_if(coalesce(ok, false)) as mapped, count_if(not coalesce(ok, false)) as passed_unchanged, 0::double as worst_error from k")
def transform_round_trip(spark, d):
    """Inverse after forward gives the points back to a nanometre."""
    m = geo.rotation(F.radians(F.lit(3.0)), F.radians(F.lit(-2.0)))
    t = (0.1, -0.2, 2.4)
    p = point_rows(spark, d).withColumns({f"{c}0": F.col(c) for c in "xyz"})
    back = geo.rigid_transform(geo.rigid_transform(p, m, t), m, t, inverse=True)
    err = F.when(F.col("mapped"), F.greatest(*[F.abs(F.col(c) - F.col(f"{c}0")) for c in "xyz"]))
    return back.agg(F.count("*").alias("rows"), F.count_if("mapped").alias("mapped"), F.count_if(~F.col("mapped")).alias("passed_unchanged"), (F.round(F.max(err), 9) + 0.0).alias("worst_error"))


@query(f"with {PLN} select sensor_id, round(degrees(atan2(-nx, nz)), 6) as pitch_deg, round(degrees(asin(ny)), 6) as roll_deg from pln")
def plane_pitch_roll(spark, d):
    pitch, roll = geo.pitch_roll()
    return planes(spark, d).select("sensor_id", rnd(pitch).alias("pitch_deg"), rnd(roll).alias("roll_deg"))


@query(f"""with {PLN}, s as (select sensor_id, nx * -2 as nx, ny * -2 as ny, nz * -2 as nz, d * -2 as d from pln), n as (select *, sqrt(nx*nx+ny*ny+nz*nz) as n from s)
select sensor_id, round(-nx/n, 6) as nx, round(-ny/n, 6) as ny, round(-nz/n, 6) as nz, round(-d/n, 6) as d, null::varchar as reason from n""")
def canonical_planes(spark, d):
    p = planes(spark, d).withColumns({c: F.col(c) * -2 for c in ("nx", "ny", "nz", "d")})
    return geo.canonical_plane(p).select("sensor_id", *[rnd(c).alias(c) for c in ("nx", "ny", "nz", "d")], "reason")


@query(f"""with {PLN} select a.sensor_id as sensor_a, b.sensor_id as sensor_b, round(degrees(acos(least(1, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)))), 4) as angle_deg, round(a.d - b.d, 6) as offset_gap
from pln a join pln b on a.sensor_id < b.sensor_id join sensors s on s.sensor_id = a.sensor_id join sensors t on t.sensor_id = b.sensor_id where split_part(s.site, '-', 1) = split_part(t.site, '-', 1)""")
def plane_angles(spark, d):
    """Planes of sensors of one kind of site against each other."""
    s = table(spark, d, "sensors").select("sensor_id", F.split_part("site", F.lit("-"), F.lit(1)).alias("kind"))
    p = planes(spark, d).join(s, "sensor_id")
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.sensor_id") < F.col("b.sensor_id")))
    angle = geo.plane_angle(["a.nx", "a.ny", "a.nz"], ["b.nx", "b.ny", "b.nz"])
    return j.select(F.col("a.sensor_id").alias("sensor_a"), F.col("b.sensor_id").alias("sensor_b"), rnd(angle, 4).alias("angle_deg"), rnd(F.col("a.d") - F.col("b.d")).alias("offset_gap"))


@query(f"""with {PLN}, u as (select *, sqrt((1-nx*nx)*(1-nx*nx) + nx*nx*ny*ny + nx*nx*nz*nz) as n from pln), b as (select *, (1-nx*nx)/n as ux, -nx*ny/n as uy, -nx*nz/n as uz from u)
select sensor_id, round(ux, 6) as ux, round(uy, 6) as uy, round(uz, 6) as uz, round(ny*uz-nz*uy, 6) as vx, round(nz*ux-nx*uz, 6) as vy, round(nx*uy-ny*ux, 6) as vz from b""")
def tangent_bases(spark, d):
    return planes(spark, d).select("sensor_id", *[rnd(c).alias(k) for k, c in geo.tangent_basis().items()])


@query(f"""with {OKP} select session_id, floor(x/0.25)::bigint as cx, floor(y/0.25)::bigint as cy, floor(z/0.25)::bigint as cz, least(floor(sqrt(x*x+y*y)/4), 2)::int as band,
 count(*) as n, round(min(least(greatest(0.05 + 0.02*sqrt(x*x+y*y), 0.08), 0.2)), 6) as threshold_m from ok group by all""")
def cells_bands_thresholds(spark, d):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    p = valid_points(spark, d).select("session_id", *[geo.cell(c, 0.25).alias(f"c{c}") for c in "xyz"], geo.range_band(r).alias("band"), geo.adaptive_threshold(r, 0.05, 0.02, 0.08, 0.2).alias("t"))
    return p.groupBy("session_id", "cx", "cy", "cz", "band").agg(F.count("*").alias("n"), rnd(F.min("t")).alias("threshold_m"))


@query(f"with {OKP} select ((floor(x/0.5)::bigint + 524288) * 1048576 + floor(y/0.5)::bigint + 524288) * 1048576 + floor(z/0.5)::bigint + 524288 as cell, count(*) as n, count(distinct session_id) as sessions from ok group by 1")
def packed_cells(spark, d):
    return valid_points(spark, d).groupBy(geo.packed_cell(0.5).alias("cell")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query(f"""with {REC} select session_id, track_id, frame_index, case when height_median_m is not null then round(least(greatest((height_median_m - 0.2) / 1.4, 0), 1), 6) end as high_score, case when height_median_m is not null then round(least(greatest((height_median_m - 1.0) / -0.8, 0), 1), 6) end as low_score,
 case when height_median_m is null then -1 else (height_median_m >= 0.4)::int + (height_median_m >= 0.8)::int + (height_median_m >= 1.3)::int end as height_bin, round(ln(1 + frame_index) / greatest(0.5, height_median_m), 6) as score,
 round(height_median_m * exp(-(frame_index % 50) / 10.0), 6) as decayed from rec""")
def score_ramps_and_bins(spark, d):
    h = F.col("height_median_m")
    return records(spark, d).select(
        "session_id", "track_id", "frame_index", rnd(geo.ramp(h, 0.2, 1.6)).alias("high_score"), rnd(geo.ramp(h, 1.0, 0.2)).alias("low_score"),
        geo.bins(h, [0.4, 0.8, 1.3]).alias("height_bin"), rnd(geo.selection_score(F.col("frame_index"), h)).alias("score"), rnd(geo.decayed(h, F.col("frame_index") % 50, 10.0)).alias("decayed"),
    )


@query("""select sid as session_id, sha256('{' || concat_ws(',', '"frame_count":' || frame_count, '"sensor_id":"' || sensor_id || '"', '"session_role":"' || session_role || '"', '"sid":"' || sid || '"') || '}') as identity
from (select distinct sid, frame_count, sensor_id, session_role from session_catalog where sid is not null)""")
def canonical_identities(spark, d):
    c = table(spark, d, "session_catalog").filter("sid is not null").select("sid", "frame_count", "sensor_id", "session_role").distinct()
    return c.select(F.col("sid").alias("session_id"), geo.canonical_id(["sid", "frame_count", "sensor_id", "session_role"]).alias("identity"))


@query("""with held as (select *, row_number() over (partition by interval_id order by saved_ts desc nulls last, session_id desc, start_frame desc, end_frame desc) as rn from label_intervals)
select interval_id, unnest(range(start_frame, end_frame + 1))::bigint as frame_index from held where rn = 1 and start_frame >= 0 and start_frame <= end_frame""")
def index_lists_expanded(spark, d):
    """Each interval as a compressed run (start, count), decoded to its frames."""
    from ..core import latest_per_key

    i = latest_per_key(table(spark, d, "label_intervals"), ["interval_id"], ["saved_ts", "session_id", "start_frame", "end_frame"], ["start_frame", "end_frame"]).filter("start_frame >= 0 and start_frame <= end_frame")
    run = F.array(F.col("start_frame").cast("bigint"), (F.col("end_frame") - F.col("start_frame") + 1).cast("bigint"))
    return i.select("interval_id", F.explode(geo.index_list(F.lit("r"), run)).alias("frame_index"))


@query(f"with {FRM} select session_id, frame_index, seq, coalesce(stamp_sec is not null and stamp_nanosec >= 0 and stamp_nanosec < 1000000000 and not (stamp_sec = 0 and stamp_nanosec = 0), false) as usable, case when coalesce(stamp_sec is not null and stamp_nanosec >= 0 and stamp_nanosec < 1000000000 and not (stamp_sec = 0 and stamp_nanosec = 0), false) then round(stamp_sec + stamp_nanosec / 1e9, 6) end as stamp_s from frm")
def device_stamps(spark, d):
    return frames(spark, d).select("session_id", "frame_index", "seq", geo.stamp_ok().alias("usable"), rnd(geo.stamp_seconds()).alias("stamp_s"))


@query(f"with {OKR} select point_id, case when z > 0 then round(420.0*x/z + 320, 6) end as u, case when z > 0 then round(420.0*y/z + 240, 6) end as v from ok")
def camera_pixels(spark, d):
    u, v = geo.pinhole(420.0, 420.0, 320.0, 240.0)
    return valid_rows(spark, d).select("point_id", rnd(u).alias("u"), rnd(v).alias("v"))


@query("""with a as (select sid, case when sid < 'cap_20260501' then '+x,-z,y' else 'x,x,-z' end as m from (select distinct sid from session_catalog))
select sid, regexp_full_match(sid, '[A-Za-z0-9_-]{1,128}') as name_ok, m = '+x,-z,y' as axes_ok from a where sid is not null""")
def name_and_axis_checks(spark, d):
    s = table(spark, d, "session_catalog").filter("sid is not null").select("sid").distinct()
    m = F.when(F.col("sid") < "cap_20260501", "+x,-z,y").otherwise("x,x,-z")
    return s.select("sid", F.col("sid").rlike("^[A-Za-z0-9_-]{1,128}$").alias("name_ok"), geo.axis_mapping(m).alias("axes_ok"))


@query(f"with {REC} select session_id, track_id, frame_index, round(case generation % 3 when 0 then height_median_m when 1 then height_median_m * 9.80665 end, 8) as acceleration from rec")
def verified_units(spark, d):
    unit = F.element_at(F.array(F.lit("m/s2"), F.lit("g"), F.lit("furlong")), (F.col("generation") % 3 + 1).cast("int"))
    return records(spark, d).select("session_id", "track_id", "frame_index", rnd(geo.to_unit(F.col("height_median_m"), unit, {"m/s2": 1.0, "g": 9.80665}), 8).alias("acceleration"))


_CLASS = f"""{PTS}, c as (select *, case when not coalesce(isfinite(x) and isfinite(y) and isfinite(z), false) then 'nonfinite' when x*x+y*y+z*z < 0.1*0.1 then 'zero_or_near'
  when ring is null or ring < 0 or ring >= 192 then 'bad_ring' else 'accepted' end as cl from pts),
a as (select *, floor((degrees(atan2(y, x)) + 180.0) / 1.40625)::int as az from c where cl = 'accepted'),
k as (select session_id, case when row_number() over (partition by session_id, frame_index, ring, az order by x*x+y*y+z*z, source_row, point_id) > 1 then 'duplicate' else 'accepted' end as cl from a
  union all select session_id, cl from c where cl <> 'accepted')"""


@query(f"with {_CLASS} select session_id, cl as class, count(*) as rows from k group by all")
def rejection_accounting(spark, d):
    return flt.classify_returns(points(spark, d)).groupBy("session_id", "class").agg(F.count("*").alias("rows"))


@query(f"""with {OKP}, {PLN}, h as (select session_id, x, y, nx*x+ny*y+nz*z+d as h from ok left join pln using (sensor_id))
select session_id, count(*) as rows, count_if(sqrt(x*x+y*y) <= 4 and coalesce(h between -0.1 and 2.2, true)) as inside, count_if(sqrt(x*x+y*y) <= 4 and sqrt(x*x+y*y) > 3.9 and coalesce(h between -0.1 and 2.2, true)) as on_shell from h group by 1""")
def region_of_interest(spark, d):
    p = valid_points(spark, d).join(planes(spark, d), "sensor_id", "left").withColumn("h", geo.plane_height())
    ok = flt.roi(4.0, -0.1, 2.2, F.col("h"))
    return p.groupBy("session_id").agg(F.count("*").alias("rows"), F.count_if(ok).alias("inside"), F.count_if(ok & (F.hypot("x", "y") > 3.9)).alias("on_shell"))


@query(f"with {OKR} select point_id from ok where (x-1)*(x-1) + (y+1)*(y+1) <= 2.25 and z between -2.2 and -0.3")
def cylinder_crop(spark, d):
    return valid_rows(spark, d).filter(flt.cylinder(1.0, -1.0, 1.5, -2.2, -0.3)).select("point_id")


@query(f"""with {OKP}, hit as (select point_id, max(zone_id) as region from ok join zones using (sensor_id) where x >= x_min and x < x_max and y >= y_min and y < y_max and z >= z_min and z < z_max group by 1)
select session_id, region, count(*) as points from ok left join hit using (point_id) group by all""")
def region_codes(spark, d):
    return flt.region_code(valid_points(spark, d), table(spark, d, "zones")).groupBy("session_id", "region").agg(F.count("*").alias("points"))


@query(f"with {OKR} select point_id from ok where abs((x-0.5)*0.8 + (y-0.5)*0.6) <= 1.05 and abs(-(x-0.5)*0.6 + (y-0.5)*0.8) <= 0.65 and abs(z+1.5) <= 1.05")
def oriented_box_members(spark, d):
    return valid_rows(spark, d).filter(flt.oriented_box((0.5, 0.5, -1.5), ((0.8, 0.6, 0), (-0.6, 0.8, 0), (0, 0, 1)), (1.0, 0.6, 1.0), 0.05)).select("point_id")


@query(f"""with {OKP}, a as (select session_id, frame_index, count(*) as n, max(z) - min(z) as h, max(x) - min(x) as e, avg(intensity) as i from ok group by 1, 2)
select session_id, frame_index, array_to_string(list_filter([case when n is null then 'points:unknown' when not n >= 5 then 'points' end, case when not h >= 1.0 then 'height' end, case when not e <= 8 then 'extent' end, case when i is null then 'intensity:unknown' when not i >= 20 then 'intensity' end], lambda x: x is not null), ',') as reasons,
 n >= 5 and h >= 1.0 and e <= 8 and coalesce(i >= 20, false) as valid from a""")
def hard_gates(spark, d):
    a = valid_points(spark, d).groupBy("session_id", "frame_index").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("h"), (F.max("x") - F.min("x")).alias("e"), F.avg("intensity").alias("i"))
    r = flt.gate_reasons({"points": F.col("n") >= 5, "height": F.col("h") >= 1.0, "extent": F.col("e") <= 8, "intensity": F.col("i") >= 20})
    return a.select("session_id", "frame_index", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("valid"))


@query(f"""with {OKP}, a as (select session_id, frame_index, count(*) as n, max(z)-min(z) as h, greatest(max(x)-min(x), max(y)-min(y)) as e, min(z) + 2.4 as low from ok group by 1, 2)
select session_id, frame_index, case when n < 8 then 'fragment' when h < 0.08 and e > 0.4 then 'planar' when h < 0.5 and e >= 0.9 and low < 0.4 then 'lying' when h >= 1.1 and e < 1.2 then 'standing' when h >= 0.6 and h < 1.1 then 'sitting' else 'other' end as class from a""")
def geometry_classes(spark, d):
    a = valid_points(spark, d).groupBy("session_id", "frame_index").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("h"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("e"), (F.min("z") + 2.4).alias("low"))
    return a.select("session_id", "frame_index", flt.geometry_class(*[F.col(c) for c in ("n", "h", "e", "low")]).alias("class"))


@query(f"""with {OKP}, v as (select session_id, point_id, floor(x/0.3)::bigint as cx, floor(y/0.3)::bigint as cy, floor(z/0.3)::bigint as cz from ok), n as (select session_id, cx, cy, cz, count(*) as n from v group by all),
o as (select session_id, cx + a as cx, cy + b as cy, cz + c as cz, n from n cross join (values (-1),(0),(1)) i(a) cross join (values (-1),(0),(1)) j(b) cross join (values (-1),(0),(1)) k(c)),
s as (select session_id, cx, cy, cz, sum(n) as support from o group by all)
select session_id, count(*) as points, count_if(support >= 3) as kept from v join s using (session_id, cx, cy, cz) group by 1""")
def isolated_point_denoise(spark, d):
    v = flt.voxel_counts(valid_points(spark, d), ["session_id"], 0.3)
    return v.groupBy("session_id").agg(F.sum("n").alias("points"), F.sum(F.when(F.col("support") >= 3, F.col("n")).otherwise(0)).alias("kept"))


_GRID = f"""{OKP}, g as (select session_id, ring, floor((degrees(atan2(y, x)) + 180.0) / 11.25)::int as col, min(sqrt(x*x+y*y+z*z)) as range_m from ok where ring between 0 and 191 group by 1, 2, 3)"""


def grid_cells(spark, d):
    p = geo.with_polar(valid_points(spark, d)).filter("ring between 0 and 191")
    return p.groupBy("session_id", "ring", F.floor((F.col("azimuth_deg") + 180.0) / 11.25).cast("int").alias("col")).agg(F.min("range_m").alias("range_m"))


@query(f"""with {_GRID}, n as (select a.session_id, a.ring, a.col, count_if(abs(a.range_m - b.range_m) <= greatest(0.05, 0.012 * least(a.range_m, b.range_m))) as supported, bool_or(abs(a.range_m - b.range_m) > 0.2) as edge
  from g a join g b on a.session_id = b.session_id and b.ring between a.ring - 1 and a.ring + 1 and b.col between a.col - 1 and a.col + 1 and (a.ring, a.col) <> (b.ring, b.col) group by 1, 2, 3)
select session_id, ring, col, coalesce(supported, 0) as supported, coalesce(edge, false) as edge from g left join n using (session_id, ring, col)""")
def depth_support_denoise(spark, d):
    return flt.grid_support(grid_cells(spark, d), ["session_id"]).select("session_id", "ring", "col", "supported", "edge")


@query(f"""with {OKP}, r as (select *, sqrt(x*x+y*y+z*z) as rg from ok where ring is not null and frame_index is not null)
select point_id from r a where not exists (select 1 from r b where b.session_id = a.session_id and b.frame_index + 1 = a.frame_index and b.ring = a.ring and abs(a.rg - b.rg) <= 0.25)""")
def dynamic_point_filter(spark, d):
    p = valid_points(spark, d).filter("ring is not null and frame_index is not null")
    return flt.dynamic_points(p, ["session_id"], "frame_index", 0.25).select("point_id")


@query(f"""with {OKP}, t as (select session_id, frame_index, max(z) + 2.4 as top, max(x)-min(x) as e, case when count(*) >= 4 then (max(z)-min(z)) / nullif(sqrt((max(z)-min(z))**2 + (max(x)-min(x))**2 + (max(y)-min(y))**2), 0) end as v from ok group by 1, 2)
select session_id, frame_index, case when top is not null and e is not null and v is not null then case when top < 0.6 and v < 0.5 then 'lying' when top >= 1.2 and v >= 0.6 then 'standing' when top >= 0.6 and top < 1.2 then 'sitting' when e > 1.5 then 'vertical_surface' else 'unknown' end end as posture from t""")
def instant_postures(spark, d):
    a = valid_points(spark, d).groupBy("session_id", "frame_index").agg((F.max("z") + 2.4).alias("top"), *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"], F.count("*").alias("n"))
    v = F.when(F.col("n") >= 4, F.col("ez") / F.nullif(F.sqrt(F.col("ez") ** 2 + F.col("ex") ** 2 + F.col("ey") ** 2), F.lit(0.0)))
    return a.select("session_id", "frame_index", flt.posture_of(F.col("top"), F.col("ex"), v).alias("posture"))


@query(f"with {REC}, c as (select session_id, case when coalesce(measured, false) and isfinite(height_median_m) then case when height_median_m <= 0.45 then 'low' else 'upright' end else 'unavailable' end as class from rec) select session_id, class, count(*) as rows from c group by all")
def low_upright_unavailable(spark, d):
    return records(spark, d).groupBy("session_id", flt.low_class(F.col("height_median_m"), F.col("measured"), 0.45).alias("class")).agg(F.count("*").alias("rows"))


@query(f"""with {FRM}, f as (select session_id, frame_index, count(*) as n, max(count_points) as c, max(dropped_points) as dr from frm where frame_index is not null group by 1, 2),
q as (select *, c / nullif(30000.0, 0) as valid, dr / 400.0 as changed from f where c >= 0)
select session_id, frame_index, case when max(case when valid >= 0.6 and changed > 0.35 then 1 else 0 end) over (partition by session_id order by frame_index) = 1 then 'invalid' when valid < 0.6 then 'insufficient' else 'ok' end as quality from q""")
def sticky_frame_quality(spark, d):
    f = frame_rows(spark, d).filter("frame_index is not null").groupBy("session_id", "frame_index").agg(F.max("count_points").alias("c"), F.max("dropped_points").alias("dr")).filter("c >= 0")
    return flt.sticky_quality(f, ["session_id"], "frame_index", F.col("c") / 30000.0, F.col("dr") / 400.0).select("session_id", "frame_index", "quality")
