"""What the live side does, over whole tables: freshness, jobs, suspension, newest-only conversion, guarded previews; and fits
whose every number has a closed form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..operators import aggregates as agg
from ..operators import clustering as cl
from ..operators import evidence as ev
from ..operators import geometry as geo
from ..operators import joins as jn
from ..operators import windows as win
from .adapters import OKP, PLN, REC, eigen_sql, frame_rows, planes, records, valid_points
from .aggregate_queries import _COV, _SETS, _even_odd
from .geometry_queries import rnd
from .registry import query

KEY = ["session_id", "track_id"]
FRAME = ["session_id", "frame_index"]
_O = "partition by session_id, track_id order by frame_index"


@query(f"""with {REC}, b as (select session_id, track_id, frame_index, stamp_sec as t, lead(stamp_sec) over ({_O}) as nxt from rec where stamp_sec is not null and not isnan(stamp_sec))
select session_id, track_id, count(*) as rows, count_if(nxt is null or nxt - t > 0.5) as expiries, round(sum(case when nxt - t > 0.5 then nxt - t - 0.5 else 0 end), 5) as unknown_s from b group by 1, 2""")
def staleness(spark, d):
    """How often and how long a watchdog of half a second would have reported unknown."""
    r = records(spark, d).filter("stamp_sec is not null and not isnan(stamp_sec)")
    return win.stale_spans(r, KEY, "frame_index", "stamp_sec", 0.5).withColumn("unknown_s", rnd("unknown_s", 5))


@query(f"""with f as (select distinct session_id, frame_index from meta_frames where frame_index is not null), r as (select *, frame_index - row_number() over (partition by session_id order by frame_index) as run from f), g as (select session_id, run, min(frame_index) as first, count(*) as n from r group by 1, 2 having count(*) >= 28),
k as (select *, row_number() over (partition by session_id order by first) as rn from g) select session_id, first as fit_from, first + 24 as fit_to, first + 25 as check_from, first + 27 as check_to from k where rn = 1""")
def fit_jobs(spark, d):
    """The first 25 frames in a row to fit on and the three after them to check with, where a session has them."""
    f = frame_rows(spark, d).filter("frame_index is not null").select(*FRAME).distinct()
    g = win.first_stretch(f, ["session_id"], "frame_index", 28)
    at = F.col("first")
    return g.select("session_id", at.alias("fit_from"), (at + 24).alias("fit_to"), (at + 25).alias("check_from"), (at + 27).alias("check_to"))


@query(f"""with {OKP}, {PLN}, h as (select session_id, frame_index // 10 as block, case when x >= 0 then 1 else 0 end + case when y >= 0 then 2 else 0 end as region, nx*x+ny*y+nz*z+d as h from ok join pln using (sensor_id) where frame_index is not null and z < -1.0),
r as (select session_id, block, region, count(*) as n, median(abs(h)) as m from h group by 1, 2, 3), s as (select session_id, block, count_if(n >= 3 and m <= 0.9) as passed, count(*) as seen from r group by 1, 2), t as (select session_id, block, median(h) as height from h group by 1, 2)
select session_id, block, passed, seen, passed >= 3 as trusted, case when passed >= 3 then round(height, 6) end as height_m from s join t using (session_id, block)""")
def suspended_heights(spark, d):
    """Heights are given only while at least three of four regions keep to the plane; else they are suspended."""
    p = valid_points(spark, d).filter("frame_index is not null and z < -1.0").join(planes(spark, d), "sensor_id")
    region = (F.col("x") >= 0).cast("int") + (F.col("y") >= 0).cast("int") * 2
    h = p.select("session_id", F.floor(F.col("frame_index") / 10).alias("block"), region.alias("region"), geo.plane_height().alias("h"))
    return ev.suspended(h, ["session_id", "block"], "region", "h", 3, 0.9, 3).withColumn("height_m", rnd("height_m"))


@query("""with f as (select session_id, frame_index, max(bag_time_sec) as made, max(epoch(recv_ts)) as got from meta_frames where frame_index is not null and bag_time_sec is not null and not isnan(bag_time_sec) and recv_ts is not null group by 1, 2), z as (select *, got - min(got) over (partition by session_id) as g, made - min(made) over (partition by session_id) as m, floor((got - min(got) over (partition by session_id)) / 1.0)::bigint as tick from f),
k as (select *, row_number() over (partition by session_id, tick order by frame_index desc) as rn, count(*) over (partition by session_id, tick) as waiting from z) select session_id, tick, frame_index, (waiting - 1)::bigint as overwritten, g - m > 2.0 as expired from k where rn = 1""")
def newest_conversions(spark, d):
    """A converter that takes the newest message each second: which one, how many it skipped, and whether it came too late."""
    t = F.unix_micros(F.col("recv_ts").cast("timestamp")) / 1e6
    f = table(spark, d, "meta_frames").filter("frame_index is not null and bag_time_sec is not null and not isnan(bag_time_sec) and recv_ts is not null").groupBy(*FRAME).agg(F.max("bag_time_sec").alias("made"), F.max(t).alias("got"))
    w = W.partitionBy("session_id")
    z = f.withColumns({"g": F.col("got") - F.min("got").over(w), "m": F.col("made") - F.min("made").over(w)}).withColumn("tick", F.floor("g"))
    k = z.groupBy("session_id", "tick").agg(F.max(F.struct("frame_index", "g", "m")).alias("s"), (F.count("*") - 1).alias("overwritten"))
    return k.select("session_id", "tick", F.col("s.frame_index").alias("frame_index"), "overwritten", (F.col("s.g") - F.col("s.m") > 2.0).alias("expired"))


@query(f"""with {REC}, s as (select session_id, track_id, max(frame_index) as f from rec where frame_index % 7 <> 0 group by 1, 2), p as (select session_id, track_id, frame_index, height_median_m as h from rec where frame_index % 7 = 0), m as (select session_id, track_id, max(frame_index) as f from p group by 1, 2)
select m.session_id, m.track_id, m.f as preview_frame, s.f as state_frame, case when s.f is null or m.f > s.f then case when m.f - coalesce(s.f, m.f) <= 5 then 'preview' else 'expired' end else 'state' end as shown from m left join s using (session_id, track_id)""")
def guarded_previews(spark, d):
    """A preview is shown only if it is newer than the state and not too far ahead; it never overwrites a newer state."""
    r = records(spark, d)
    s = r.filter("frame_index % 7 <> 0").groupBy(*KEY).agg(F.max("frame_index").alias("state_frame"))
    m = r.filter("frame_index % 7 = 0").groupBy(*KEY).agg(F.max("frame_index").alias("preview_frame"))
    j = m.join(s, KEY, "left")
    ahead = F.col("preview_frame") - F.coalesce("state_frame", "preview_frame")
    newer = F.col("state_frame").isNull() | (F.col("preview_frame") > F.col("state_frame"))
    return j.withColumn("shown", F.when(newer, F.when(ahead <= 5, "preview").otherwise("expired")).otherwise("state"))


@query(f"""with {REC}, b as (select session_id, track_id, frame_index, generation, height_median_m as h, case when row_number() over w > 1 and (lag(generation) over w is distinct from generation or frame_index <> lag(frame_index) over w + 1) then 1 else 0 end as reset from rec window w as ({_O})), e as (select *, sum(reset) over ({_O}) as epoch from b)
select session_id, track_id, frame_index, epoch::bigint as epoch, reset = 1 as reset_now, (row_number() over (partition by session_id, track_id, epoch order by frame_index) - 1)::bigint as history, round(max(h) over (partition by session_id, track_id, epoch order by frame_index) - h, 6) as drop_m from e""")
def history_epochs(spark, d):
    """Features count from the last reset: another binding or a missing frame clears all history, once."""
    r = win.reset_epochs(records(spark, d), KEY, "frame_index", F.col("generation"))
    w = W.partitionBy(*KEY, "epoch").orderBy("frame_index")
    h = F.col("height_median_m")
    return r.select(*KEY, "frame_index", "epoch", "reset_now", (F.row_number().over(w) - 1).cast("bigint").alias("history"), rnd(F.max(h).over(w.rowsBetween(W.unboundedPreceding, 0)) - h).alias("drop_m"))


def _proposals(spark, d):
    p = valid_points(spark, d)
    t = p.filter("frame_index is not null").groupBy("session_id", (F.col("frame_index") % 20).alias("track_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    c = p.filter("ring is not null").groupBy("session_id", (F.col("ring") % 16 + 100).alias("cand")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    j = jn.radius_join(t, c, ["session_id"], ["x", "y"], 0.2)
    return j.filter(F.greatest("n", "n_r") / F.least("n", "n_r") <= 4).select("session_id", "track_id", F.col("cand_r").alias("cand"))


_PROP = f"""{OKP}, t as (select session_id, frame_index % 20 as track_id, avg(x) as x, avg(y) as y, count(*) as n from ok where frame_index is not null group by 1, 2), c as (select session_id, 100 + ring % 16 as cand, avg(x) as x, avg(y) as y, count(*) as n from ok where ring is not null group by 1, 2),
p as (select t.session_id, t.track_id, c.cand from t join c on t.session_id = c.session_id where (t.x-c.x)**2 + (t.y-c.y)**2 <= 0.04 and greatest(t.n, c.n) / least(t.n, c.n)::double <= 4)"""


@query(f"""with recursive {_PROP}, ed as (select distinct session_id, 't' || track_id as a, 'c' || cand as b from p union select distinct session_id, 'c' || cand, 't' || track_id from p), bad as (select session_id, 'c' || cand as n from p group by session_id, cand having count(*) > 1),
reach(session_id, n) as (select session_id, n from bad union select r.session_id, e.b from reach r join ed e on e.session_id = r.session_id and e.a = r.n)
select session_id, track_id, count(*) as candidates, ('t' || track_id) in (select n from reach r where r.session_id = p.session_id) as blocked from p group by session_id, track_id""")
def blocked_tracks(spark, d):
    """Ambiguity spreads: a track that shares a candidate is blocked, so are all its candidates and whoever wants those."""
    from ..operators.fitting import per_group, spread_blocks

    p = _proposals(spark, d)

    def run(pdf):
        tracks, cands = pdf["track_id"].tolist(), pdf["cand"].tolist()
        blocked = spread_blocks(list(zip(tracks, cands)))
        n = {t: tracks.count(t) for t in set(tracks)}
        return [(int(t), n[t], t in blocked) for t in sorted(n)]

    return per_group(p, ["session_id"], ["track_id", "cand"], run, "track_id bigint, candidates bigint, blocked boolean").withColumn("track_id", F.col("track_id").cast("int"))


@query(f"""with {OKP}, c as (select distinct session_id, frame_index // 10 as frame, ring // 32 as member, floor(x/0.8)::bigint as cx, floor(y/0.8)::bigint as cy from ok where frame_index is not null and ring between 0 and 191), s as (select session_id, frame, member, count(*) as n from c group by 1, 2, 3),
b as (select a.session_id, a.frame, a.member, p.member as was, count(distinct (a.cx, a.cy)) filter (where a.cx = p.cx and a.cy = p.cy) as common from c a join c p on a.session_id = p.session_id and a.frame = p.frame + 1 and abs(a.cx - p.cx) <= 1 and abs(a.cy - p.cy) <= 1 group by 1, 2, 3, 4)
select b.session_id, b.frame, b.member, b.was, round(common / least(x.n, y.n)::double, 6) as overlap, common / least(x.n, y.n)::double >= 0.1 as overlapping from b join s x on (x.session_id, x.frame, x.member) = (b.session_id, b.frame, b.member) join s y on (y.session_id, y.frame, y.member) = (b.session_id, b.frame - 1, b.was)""")
def touching_history(spark, d):
    """Links of members in consecutive blocks whose cells overlap or touch."""
    p = valid_points(spark, d).filter("frame_index is not null and ring between 0 and 191")
    c = p.select("session_id", F.floor(F.col("frame_index") / 10).alias("frame"), F.floor(F.col("ring") / 32).alias("member"), F.floor(F.col("x") / 0.8).alias("cx"), F.floor(F.col("y") / 0.8).alias("cy")).distinct()
    return jn.touching_links(c, ["session_id"], "frame", "member", 0.1).withColumn("overlap", rnd("overlap"))


@query(f"""with {_SETS}, k as (select session_id, cell, bool_or(l) as l, bool_or(r) as r from (select session_id, cell, true as l, false as r from a union all select session_id, cell, false, true from b) group by 1, 2), m as (select session_id, count_if(l and r) / nullif(count_if(l), 0)::double as coverage, count_if(r and not l) / nullif(count_if(r), 0)::double as fresh, count_if(r) as n from k group by 1)
select session_id, case when n < 20 then 'support' when coverage < 0.5 then 'coverage' when fresh > 0.55 then 'new_fraction' when n > 700 then 'envelope' else 'accepted' end as outcome from m""")
def composition_gates(spark, d):
    """Ordered gates on how the odd frames' cells continue the even ones'; the first that fails is the reason."""
    a, b = _even_odd(spark, d)
    k = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), ["session_id", "cell"], "full_outer").fillna(False, ["l", "r"])
    m = k.groupBy("session_id").agg((F.count_if(F.col("l") & F.col("r")) / F.nullif(F.count_if("l"), F.lit(0))).alias("coverage"), (F.count_if(F.col("r") & ~F.col("l")) / F.nullif(F.count_if("r"), F.lit(0))).alias("fresh"), F.count_if("r").alias("n"))
    gates = [("support", F.col("n") < 20), ("coverage", F.col("coverage") < 0.5), ("new_fraction", F.col("fresh") > 0.55), ("envelope", F.col("n") > 700)]
    return m.select("session_id", ev.first_failing(gates, "accepted").alias("outcome"))


@query(f"""with {OKP}, g as (select session_id, x, y, z, 1 + coalesce(intensity, 0) as w from ok where z < -1.9), m as (select session_id, count(*) as n, sum(w) as s, sum(w*x)/sum(w) as mx, sum(w*y)/sum(w) as my, sum(w*z)/sum(w) as mz from g group by 1 having count(*) >= 10),
c as (select g.session_id, any_value(n) as n, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, sum(w*(x-mx)*(x-mx))/any_value(s) as xx, sum(w*(x-mx)*(y-my))/any_value(s) as xy, sum(w*(x-mx)*(z-mz))/any_value(s) as xz, sum(w*(y-my)*(y-my))/any_value(s) as yy, sum(w*(y-my)*(z-mz))/any_value(s) as yz, sum(w*(z-mz)*(z-mz))/any_value(s) as zz from g join m using (session_id) group by 1), {eigen_sql("c")}
select session_id, n, case when l2 / l1 < 0.01 then 'degenerate' when v3z is null then 'ambiguous' when abs(v3z) < 0.4 then 'steep' else 'valid' end as reason, case when l2 / l1 >= 0.01 and v3z is not null and abs(v3z) >= 0.4 then round(abs(v3z), 3) end as nz, case when l2 / l1 >= 0.01 and v3z is not null and abs(v3z) >= 0.4 then round(-(v3x*mx+v3y*my+v3z*mz)*sign(v3z), 3) end as d from eg""")
def weighted_planes(spark, d):
    """Weighted least-squares planes with the reason where there is none: degenerate, ambiguous or too steep."""
    p = valid_points(spark, d).filter("z < -1.9")
    e = agg.with_eigen(agg.covariance(p, ["session_id"], 1 + F.coalesce("intensity", F.lit(0.0))).filter("n >= 10"))
    r = F.when(F.col("l2") / F.col("l1") < 0.01, "degenerate").when(F.col("v3z").isNull(), "ambiguous").when(F.abs("v3z") < 0.4, "steep").otherwise("valid")
    ok = F.col("reason") == "valid"
    off = -(F.col("v3x") * F.col("mx") + F.col("v3y") * F.col("my") + F.col("v3z") * F.col("mz")) * F.signum("v3z")
    return e.withColumn("reason", r).select("session_id", "n", "reason", F.when(ok, rnd(F.abs("v3z"), 3)).alias("nz"), F.when(ok, rnd(off, 3)).alias("d"))


@query(f"""with {OKP}, g as (select session_id, frame_index % 3 as grp, x, y, z from ok where z < -1.9 and frame_index is not null), c as (select session_id, {_COV} from g where grp = 0 group by 1 having count(*) >= 10), {eigen_sql("c")},
f as (select session_id, v3x*sign(v3z) as ax, v3y*sign(v3z) as ay, abs(v3z) as az, -(v3x*mx+v3y*my+v3z*mz)*sign(v3z) as d from eg where v3z is not null), r as (select g.session_id, grp, ax*x+ay*y+az*z+d as r from g join f using (session_id))
select session_id, grp, count(*) as n, round(sqrt(avg(r*r)), 4) as rms, round(quantile_cont(abs(r), 0.95), 4) as p95_abs, round(median(r), 4) as median_gap from r group by 1, 2""")
def joint_leveling(spark, d):
    """A plane fitted on one group of frames, and how the other groups keep to that same plane."""
    g = valid_points(spark, d).filter("z < -1.9 and frame_index is not null").withColumn("grp", F.col("frame_index") % 3)
    e = agg.with_eigen(agg.covariance(g.filter("grp = 0"), ["session_id"]).filter("n >= 10")).filter("v3z is not null")
    up = F.signum("v3z")
    f = e.select("session_id", *[(F.col(f"v3{k}") * up).alias(f"n{k}") for k in "xyz"], (-(F.col("v3x") * F.col("mx") + F.col("v3y") * F.col("my") + F.col("v3z") * F.col("mz")) * up).alias("d"))
    r = g.join(f, "session_id").select("session_id", "grp", geo.plane_height().alias("r"))
    return r.groupBy("session_id", "grp").agg(F.count("*").alias("n"), rnd(F.sqrt(F.avg(F.col("r") * F.col("r"))), 4).alias("rms"), rnd(F.percentile(F.abs("r"), 0.95), 4).alias("p95_abs"), rnd(F.percentile("r", 0.5), 4).alias("median_gap"))


@query(f"""with {OKP}, g as (select *, floor(x/0.5)::bigint as cx, floor(y/0.5)::bigint as cy from ok where frame_index is not null and z < -1.2), c as (select session_id, cx, cy, count(distinct frame_index) as frames, max(z)-min(z) as tall, {_COV} from g group by 1, 2, 3 having count(*) >= 5), {eigen_sql("c")}
select session_id, cx, cy, n, frames, case when frames < 3 then 'frames' when tall > 0.6 then 'height_span' when v3z is null or abs(round(v3z, 6)) < 0.6 then 'normal' when round(sqrt(greatest(l3, 0)), 6) > 0.12 then 'roughness' else 'clean' end as stage from eg""")
def floor_cells(spark, d):
    """Cells of the floor by the gate they fail: frames seen, height span, normal, roughness; the rest is clean."""
    return floor_cell_gates(spark, d).select("session_id", "cx", "cy", "n", "frames", "stage")


def floor_cell_gates(spark, d):
    g = valid_points(spark, d).filter("frame_index is not null and z < -1.2").withColumns({"cx": F.floor(F.col("x") / 0.5), "cy": F.floor(F.col("y") / 0.5)})
    more = g.groupBy("session_id", "cx", "cy").agg(F.count_distinct("frame_index").alias("frames"), (F.max("z") - F.min("z")).alias("tall"))
    e = agg.with_eigen(agg.covariance(g, ["session_id", "cx", "cy"]).filter("n >= 5")).join(more, ["session_id", "cx", "cy"])
    up, rough = rnd(F.abs("v3z")), rnd(F.sqrt(F.greatest("l3", F.lit(0.0))))
    gates = [("frames", F.col("frames") < 3), ("height_span", F.col("tall") > 0.6), ("normal", F.coalesce(up < 0.6, F.lit(True))), ("roughness", rough > 0.12)]
    return e.withColumn("stage", ev.first_failing(gates, "clean"))


@query(f"""with {OKP}, g as (select *, floor(x/0.5)::bigint as cx, floor(y/0.5)::bigint as cy from ok where frame_index is not null and z < -1.2), c as (select session_id, cx, cy, count(distinct frame_index) as frames, max(z)-min(z) as tall, {_COV} from g group by 1, 2, 3 having count(*) >= 5), {eigen_sql("c")},
s as (select session_id, case when frames < 3 then 'frames' when tall > 0.6 then 'height_span' when v3z is null or abs(round(v3z, 6)) < 0.6 then 'normal' when round(sqrt(greatest(l3, 0)), 6) > 0.12 then 'roughness' else 'clean' end as stage from eg) select session_id, stage, count(*) as cells, round(count(*) / sum(count(*)) over (partition by session_id), 6) as share from s group by 1, 2""")
def floor_funnel(spark, d):
    """How many cells each gate stops."""
    g = floor_cell_gates(spark, d).groupBy("session_id", "stage").agg(F.count("*").alias("cells"))
    return g.withColumn("share", rnd(F.col("cells") / F.sum("cells").over(W.partitionBy("session_id"))))


@query()
def floor_regions(spark, d):
    """Clean floor cells joined to regions, and the four cells of the largest region that lie farthest apart; without enough
    clean cells the cells that only fail roughness stand in, with the reason."""
    from ..operators.fitting import per_group, spread_four

    c = floor_cell_gates(spark, d).filter("stage in ('clean', 'roughness')").select("session_id", "cx", "cy", (F.col("stage") == "clean").alias("clean"))

    def run(pdf):
        for rule, part in (("clean_cells", pdf[pdf["clean"]]), ("rough_cells_too", pdf)):
            cells = part[["cx", "cy"]].to_numpy("int64")
            if not len(cells):
                continue
            label = cl.min_labels(len(cells), *cl.cell_edges(cells))
            big = cells[label == max(set(label.tolist()), key=lambda k: ((label == k).sum(), -k))]
            if len(big) >= 4:
                four, apart = spread_four(big.astype("float64"))
                return [(rule, len(cells), len(big), [f"{int(a)}:{int(b)}" for a, b in big[four]], float(apart * 0.5))]
        return [("none", len(pdf), 0, [], None)]

    return per_group(c, ["session_id"], ["cx", "cy"], run, "rule string, cells bigint, largest bigint, chosen array<string>, apart_m double")


_NODES = [("TOP", 0.88, 1.03), ("UPPER", 0.68, 0.88), ("CENTER", 0.46, 0.68), ("BASE", 0.28, 0.46), ("LOWER", 0.12, 0.28), ("END", -0.03, 0.12)]


@query(f"""with {OKP}, f as (select session_id, x, y, z, median(x) over (partition by session_id) as cx, median(y) over (partition by session_id) as cy, median(z) over (partition by session_id) as cz from ok), c as (select session_id, {_COV} from ok group by 1 having count(*) >= 20), {eigen_sql("c")},
a as (select session_id, case when greatest(abs(v1x), abs(v1y), abs(v1z)) in (v1x, v1y, v1z) then 1 else -1 end as s, v1x, v1y, v1z from eg where v1x is not null), l as (select f.session_id, x, y, z, s*((x-cx)*v1x+(y-cy)*v1y+(z-cz)*v1z) as u from f join a using (session_id)),
q as (select session_id, quantile_cont(u, 0.02) as lo, quantile_cont(u, 0.98) as hi from l group by 1), n as (select l.session_id, case {" ".join(f"when (u-lo)/(hi-lo) >= {a} and (u-lo)/(hi-lo) < {b} then {k}" for k, (_, a, b) in enumerate(_NODES))} end as k, x, y, z from l join q using (session_id) where hi - lo >= 0.5),
g as (select session_id, k, count(*) as n, median(x) as x, median(y) as y, median(z) as z from n where k is not null group by 1, 2 having count(*) >= 6)
select session_id, ['TOP','UPPER','CENTER','BASE','LOWER','END'][k+1] as node, n, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z, case when lead(k) over (partition by session_id order by k) = k + 1 then ['TOP','UPPER','CENTER','BASE','LOWER','END'][k+2] end as joined_to from g""")
def region_skeletons(spark, d):
    """Median nodes of quantile slabs along the main axis, and the edges between neighbouring ones that are there."""
    return cl.axis_nodes(valid_points(spark, d), ["session_id"], _NODES, 6, 0.5, 20).select("session_id", "node", "n", *[rnd(c, 4).alias(c) for c in "xyz"], "joined_to")


@query(f"""with {OKP}, t as (select session_id, frame_index % 20 as track_id, avg(x) as x, avg(y) as y, count(*) as n from ok where frame_index is not null group by 1, 2), c as (select session_id, 100 + ring % 16 as candidate_id, avg(x) as x, avg(y) as y, count(*) as n from ok where ring is not null group by 1, 2),
p as (select t.session_id, t.track_id, c.candidate_id, sqrt((t.x-c.x)**2 + (t.y-c.y)**2) as dist from t join c on t.session_id = c.session_id where (t.x-c.x)**2 + (t.y-c.y)**2 <= 0.09 and greatest(t.n, c.n) / least(t.n, c.n)::double <= 1.5),
n as (select *, row_number() over w as rn, lead(dist) over w - dist as ld from p window w as (partition by session_id, track_id order by dist, candidate_id)), s as (select session_id, track_id, candidate_id, dist, case when ld < 0.03 or count(*) over (partition by session_id, candidate_id) > 1 then 'ambiguous' else 'matched' end as st from n where rn = 1)
select session_id, track_id, case when st = 'matched' then candidate_id end as candidate_id, round(dist, 6) as dist, coalesce(st, 'unmatched') as status from t left join s using (session_id, track_id)""")
def sized_association(spark, d):
    """Gated association in which the two sides may differ in size by half at most."""
    p = valid_points(spark, d)
    t = p.filter("frame_index is not null").groupBy("session_id", (F.col("frame_index") % 20).alias("track_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    c = p.filter("ring is not null").groupBy("session_id", (F.col("ring") % 16 + 100).alias("candidate_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return jn.gated_association(t, c, ["session_id"], 0.3, 0.03, ("n", 1.5)).withColumn("dist", rnd("dist"))


@query(f"""with {OKP}, z as (select zone_id, sensor_id, x_min, x_max, y_min, y_max, case when zone_id % 4 = 0 then 'fit' else 'validation' end as role, zone_id % 3 as grp from zones), m as (select session_id, z.zone_id, role, grp, point_id, ring from ok join z using (sensor_id) where frame_index % 3 = grp and x >= x_min and x < x_max and y >= y_min and y < y_max)
select session_id, zone_id, role, grp, count(*) as offered, count_if(ring % 2 = 0) as confirmed, 0::bigint as strangers from m group by 1, 2, 3, 4""")
def review_regions(spark, d):
    """Members of review regions: frame group and footprint decide, heights don't; confirmed rows must be among the offered."""
    z = table(spark, d, "zones").select("zone_id", "sensor_id", "x_min", "x_max", "y_min", "y_max", F.when(F.col("zone_id") % 4 == 0, "fit").otherwise("validation").alias("role"), (F.col("zone_id") % 3).alias("grp"))
    m = jn.footprint_members(valid_points(spark, d), z, "sensor_id", F.col("frame_index") % 3 == F.col("grp"))
    offered = m.select("session_id", "zone_id", "role", "grp", "point_id", "ring")
    confirmed = offered.filter("ring % 2 = 0").select("session_id", "zone_id", "point_id")
    strangers = confirmed.join(offered, ["session_id", "zone_id", "point_id"], "left_anti").groupBy("session_id", "zone_id").agg(F.count("*").alias("strangers"))
    g = offered.groupBy("session_id", "zone_id", "role", "grp").agg(F.count("*").alias("offered"), F.count_if(F.col("ring") % 2 == 0).alias("confirmed"))
    return g.join(strangers, ["session_id", "zone_id"], "left").fillna(0, ["strangers"])


@query("""with z as (select sensor_id, case when zone_id % 4 = 0 then 'fit' else 'validation' end as role, zone_id % 3 as grp from zones), g as (select sensor_id, count_if(role = 'fit') as fits, count_if(role = 'validation') as validations, count(distinct grp) as groups_, count(*) as n from z group by 1)
select sensor_id, fits, validations, case when fits <> 1 then 'fit_regions' when validations < 3 then 'validation_regions' when groups_ < 3 then 'frame_groups' else 'frozen' end as outcome, sha256(sensor_id || ':' || fits || ':' || validations || ':' || groups_) as selection_id from g""")
def region_selections(spark, d):
    """A selection is frozen with exactly one region to fit, three or more to validate and three frame groups."""
    z = table(spark, d, "zones").select("sensor_id", (F.col("zone_id") % 4 == 0).alias("fit"), (F.col("zone_id") % 3).alias("grp"))
    g = z.groupBy("sensor_id").agg(F.count_if("fit").alias("fits"), F.count_if(~F.col("fit")).alias("validations"), F.count_distinct("grp").alias("groups"))
    o = ev.first_failing([("fit_regions", F.col("fits") != 1), ("validation_regions", F.col("validations") < 3), ("frame_groups", F.col("groups") < 3)], "frozen")
    name = F.sha2(F.concat_ws(":", "sensor_id", F.col("fits").cast("string"), F.col("validations").cast("string"), F.col("groups").cast("string")), 256)
    return g.select("sensor_id", "fits", "validations", o.alias("outcome"), name.alias("selection_id"))


@query("""with e as (select vec_id, embedding as e, sqrt(embedding[7]::double**2 + embedding[8]::double**2 + embedding[9]::double**2 + embedding[10]::double**2) as n, vec_id % 5 as k from embeddings),
r as (select vec_id, case when k = 4 then null when len(e) < 6 then false else isfinite(e[1]) and isfinite(e[2]) and isfinite(e[3]) and isfinite(e[4]) and isfinite(e[5]) and isfinite(e[6]) end as six, case when k = 3 then null when n = 0 then false else round(n, 4) between 0.1 and 0.5 end as turned from e)
select vec_id, six as six_axis_finite, turned as orientation_usable, array_to_string(list_filter([case when six is null then 'measurement_unknown' when not six then 'measurement_nonfinite' end, case when turned is null then 'orientation_unknown' when not turned then 'orientation_unusable' end], lambda x: x is not null), ',') as reasons from r""")
def sensor_quality(spark, d):
    """Six axes finite and an orientation of plausible norm; what isn't known is no pass, and says so."""
    e, k = F.col("embedding"), F.col("vec_id") % 5
    n = F.round(F.sqrt(sum((F.get(e, i).cast("double") ** 2 for i in (7, 8, 9)), F.get(e, 6).cast("double") ** 2)), 4)
    six = F.when(k == 4, None).otherwise(ev.all_finite(F.slice(e, 1, 6), 6))
    turned = F.when(k == 3, None).otherwise((n > 0) & n.between(0.1, 0.5))
    r = table(spark, d, "embeddings").select("vec_id", six.alias("six_axis_finite"), turned.alias("orientation_usable"))
    why = F.array(F.when(F.col("six_axis_finite").isNull(), "measurement_unknown").when(~F.col("six_axis_finite"), "measurement_nonfinite"), F.when(F.col("orientation_usable").isNull(), "orientation_unknown").when(~F.col("orientation_usable"), "orientation_unusable"))
    return r.withColumn("reasons", F.array_join(why, ","))


@query()
def site_fits(spark, d):
    """The ground of each session's site by three estimators, or why there is none."""
    from ..operators import ground

    p = valid_points(spark, d).filter("frame_index is not null")
    f = ground.site_fits(p, ["session_id"], {"least_points": 20, "band_m": 0.15, "rms_m": 0.2, "check_p95_m": 0.6, "agree_deg": 6.0, "agree_m": 0.3, "spread_deg": 90.0, "mode": ground.Mode.ROBUST})
    return f.select("session_id", "status", "reason", *[rnd(c, 5).alias(c) for c in ("nx", "ny", "nz", "d", "rms", "check_p95")])
