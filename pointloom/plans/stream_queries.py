"""The streaming operators' step functions over whole tables (their batch twins)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..operators import windows as win
from ..streaming import stateful as st
from ..streaming import trackers as tr
from .adapters import OKP, REC, frame_rows, records, valid_points
from .geometry_queries import rnd
from .registry import query

KEY = ["session_id", "track_id"]
_O = "partition by session_id, track_id order by frame_index"


@query(f"with {REC}, s as (select session_id, track_id, frame_index, frame_index - lag(frame_index) over ({_O}) - 1 as g from rec) select session_id, track_id, frame_index, greatest(coalesce(g, 0), 0)::bigint as skipped from s")
def skipped_inputs(spark, d):
    return win.skipped(records(spark, d).select(*KEY, "frame_index"), KEY, ["frame_index"], "frame_index")


@query(f"with {REC}, s as (select session_id, track_id, frame_index, case when lag(generation) over w is distinct from generation and lag(frame_index) over w is not null then 1 else 0 end as c, lag(frame_index) over w is null as f from rec window w as ({_O})) select session_id, track_id, frame_index, sum(c) over ({_O})::int as binding_no, c = 1 or f as cleared from s")
def binding_generations(spark, d):
    r = records(spark, d).select(*KEY, "frame_index", "generation")
    return win.bindings(r, KEY, ["frame_index"], F.col("generation")).drop("generation")


@query(f"""with p as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, generation, recv_ts, record_id from posture_frames where track_id is not null and frame_index is not null),
c as (select *, case when row_number() over w > 1 and lag(generation) over w is distinct from generation then 1 else 0 end as c from p window w as (partition by session_id, track_id order by recv_ts nulls first, record_id)),
b as (select *, sum(c) over (partition by session_id, track_id order by recv_ts nulls first, record_id) as no from c),
v as (select *, case when row_number() over w = 1 then t is null else not coalesce(frame_index > lag(frame_index) over w and t > lag(t) over w, false) end as bad from b window w as (partition by session_id, track_id, no order by recv_ts nulls first, record_id)),
s as (select session_id, track_id, case when max(bad::int) over (partition by session_id, track_id, no order by recv_ts nulls first, record_id) = 1 then 'dropped' else 'accepted' end as status from v)
select session_id, track_id, status, count(*) as rows from s group by all""")
def monotonic_inputs(spark, d):
    """Arrival order by recv_ts: accepted until a sequence or stamp steps back, then dropped until the binding changes."""
    p = table(spark, d, "posture_frames").filter("track_id is not null and frame_index is not null").select(*KEY, "frame_index", "stamp_sec", "generation", "recv_ts", "record_id")
    r = win.monotonic(p, KEY, ["recv_ts", "record_id"], "frame_index", "stamp_sec", F.col("generation"))
    return r.groupBy(*KEY, "status").agg(F.count("*").alias("rows"))


@query(f"""with f as (select distinct session_id, frame_index from meta_frames where frame_index is not null), r as (select *, row_number() over w as rn, coalesce(frame_index <> lag(frame_index) over w + 1, false) as hole from f window w as (partition by session_id order by frame_index)),
h as (select session_id, min(rn) as h from r where hole and rn <= 11 group by 1) select r.session_id, frame_index, case when rn >= h then 'disabled' when rn > 10 then 'ready' else 'training' end as mode from r left join h using (session_id)""")
def warmup_modes(spark, d):
    f = frame_rows(spark, d).filter("frame_index is not null").select("session_id", "frame_index").distinct()
    return win.warmup(f, ["session_id"], "frame_index", 10)


@query(f"""with recursive {OKP}, c as (select session_id, (ring // 16)::int as band, floor((degrees(atan2(y, x)) + 180.0) / 45.0)::int as az, frame_index, avg(sqrt(x*x+y*y+z*z)) as r, count(*) >= 3 as frozen from ok where ring between 0 and 191 and frame_index is not null group by 1, 2, 3, 4),
o as (select *, row_number() over (partition by session_id, band, az order by frame_index) as rn from c),
e as (select session_id, band, az, frame_index, rn, r as mean, false as foreground from o where rn = 1
 union all select o.session_id, o.band, o.az, o.frame_index, o.rn, case when o.frozen or abs(o.r - e.mean) > 0.6 then e.mean else e.mean + 0.1 * (o.r - e.mean) end, abs(o.r - e.mean) > 0.6 from e join o on o.session_id = e.session_id and o.band = e.band and o.az = e.az and o.rn = e.rn + 1)
select session_id, band, az, frame_index, round(mean, 6) as mean, foreground from e""")
def background_adaptation(spark, d):
    """Slow mean of each direction cell; cells that stand out, and those frozen for holding several returns, are left
    alone."""
    p = valid_points(spark, d).filter("ring between 0 and 191 and frame_index is not null")
    az = F.floor((F.degrees(F.atan2("y", "x")) + 180.0) / 45.0).cast("int")
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    c = p.groupBy("session_id", F.floor(F.col("ring") / 16).cast("int").alias("band"), az.alias("az"), "frame_index").agg(F.avg(r).alias("r"), (F.count("*") >= 3).alias("frozen"))
    b = win.fold_rows(c, ["session_id", "band", "az"], ["frame_index"], ["r", "frozen"], st.background_step(0.1, 0.6), [("mean", "double"), ("foreground", "boolean")])
    return b.select("session_id", "band", "az", "frame_index", rnd("mean").alias("mean"), "foreground")


@query(f"""with recursive {OKP}, v as (select distinct session_id, floor(x/0.5)::bigint as cx, floor(y/0.5)::bigint as cy, floor(z/0.5)::bigint as cz, frame_index::double as t from ok where frame_index is not null),
o as (select *, row_number() over (partition by session_id, cx, cy, cz order by t) as rn, count(*) over (partition by session_id, cx, cy, cz) as n from v),
e as (select session_id, cx, cy, cz, rn, n, t, 1.0::double as heat, 1 as hits from o where rn = 1
 union all select o.session_id, o.cx, o.cy, o.cz, o.rn, o.n, o.t, e.heat * exp(-(o.t - e.t) / 8.0) + 1, case when o.t - e.t <= 8.0 then e.hits + 1 else 1 end from e join o on o.session_id = e.session_id and o.cx = e.cx and o.cy = e.cy and o.cz = e.cz and o.rn = e.rn + 1)
select session_id, cx, cy, cz, t, round(heat, 6) as heat, case when hits >= 2 and heat >= 1.2 then 'HOT' when heat >= 0.5 then 'GHOST' else 'COLD' end as label from e where rn = n""")
def freshness_map(spark, d):
    """Heat and label of each half-metre voxel at its last hit."""
    v = valid_points(spark, d).filter("frame_index is not null").select("session_id", *[F.floor(F.col(c) / 0.5).cast("bigint").alias(f"c{c}") for c in "xyz"], F.col("frame_index").cast("double").alias("t")).distinct()
    k = ["session_id", "cx", "cy", "cz"]
    h = win.fold_rows(v, k, ["t"], ["t"], st.freshness_step(8.0, 1.2, 0.5), [("heat", "double"), ("label", "string")])
    return h.groupBy(*k).agg(F.max(F.struct("t", "heat", "label")).alias("m")).select(*k, F.col("m.t").alias("t"), rnd("m.heat").alias("heat"), F.col("m.label").alias("label"))


@query(f"""with recursive {REC}, o as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, height_median_m as z, row_number() over ({_O}) as rn from rec),
k as (select session_id, track_id, frame_index, rn, case when t is not null then z end as x, case when t is not null and z is not null then 0.0::double end as v, 0.0064::double as a, 0.0::double as b, 1.0::double as c, t as last, 0 as missed, z is not null and t is not null as live,
  case when t is not null then z end as height, case when t is not null and z is not null then 0.0::double end as rate, case when t is null then 'invalid' else 'start' end as status from o where rn = 1
 union all select session_id, track_id, frame_index, rn,
  case when t is null then x when not live then z when ok then px + pa / (pa + 0.0064) * (z - px) when missed >= 8 then z else px end,
  case when t is null then v when not live then 0.0 when ok then v + pb / (pa + 0.0064) * (z - px) when missed >= 8 then 0.0 else v end,
  case when t is null then a when not live then 0.0064 when ok then pa * (1 - pa / (pa + 0.0064)) when missed >= 8 then 0.0064 else pa end,
  case when t is null then b when not live then 0.0 when ok then pb * (1 - pa / (pa + 0.0064)) when missed >= 8 then 0.0 else pb end,
  case when t is null then c when not live then 1.0 when ok then pc - pb / (pa + 0.0064) * pb when missed >= 8 then 1.0 else pc end,
  coalesce(t, last), case when t is null then missed when not live or ok or missed >= 8 then 0 else missed + 1 end, case when t is null then live when not live or (not ok and missed >= 8) then z is not null else true end,
  case when t is null then null when not live then z when ok then px + pa / (pa + 0.0064) * (z - px) when missed >= 8 then z else px end,
  case when t is null then null when not live then case when z is not null then 0.0 end when ok then v + pb / (pa + 0.0064) * (z - px) when missed >= 8 then null else v end,
  case when t is null then 'invalid' when not live then 'start' when ok then 'update' when missed >= 8 then 'restart' else 'coast' end
 from (select *, coalesce((z - px) ** 2 <= 16 * (pa + 0.0064), false) as ok from (select *, x + v * dt as px, a + dt * (2 * b + dt * c) + dt ** 4 / 4 as pa, b + dt * c + dt ** 3 / 2 as pb, c + dt * dt as pc from
  (select o.session_id, o.track_id, o.frame_index, o.rn, o.t, o.z, k.x, k.v, k.a, k.b, k.c, k.last, k.missed, k.live, greatest(0, o.t - k.last) as dt from k join o on o.session_id = k.session_id and o.track_id = k.track_id and o.rn = k.rn + 1))))
select session_id, track_id, frame_index, round(height, 5) as height, round(rate, 5) as rate, status from k""")
def kalman_heights(spark, d):
    r = records(spark, d).select(*KEY, "frame_index", "stamp_sec", "height_median_m")
    k = win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "height_median_m"], st.KalmanTrack(1.0, 0.08, 4.0, 8), [("height", "double"), ("rate", "double"), ("status", "string")])
    return k.select(*KEY, "frame_index", rnd("height", 5).alias("height"), rnd("rate", 5).alias("rate"), "status")


@query()
def multi_tracks(spark, d):
    """Tracks over the cluster centres of each frame."""
    p = valid_points(spark, d).filter("frame_index is not null")
    c = p.groupBy("session_id", "frame_index", F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).filter("n >= 2")
    f = c.groupBy("session_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("cx", "cy", "x", "y"))).alias("c"))
    f = f.select("session_id", "frame_index", (F.col("frame_index") * 0.1).alias("t"), F.transform("c", lambda s: s["x"]).alias("xs"), F.transform("c", lambda s: s["y"]).alias("ys"))
    tracks = st.Tracks(0.6, 3, 1.5, 0.1)
    r = win.fold_rows(f, ["session_id"], ["frame_index"], ["t", "xs", "ys"], _lists(tracks), [("confirmed", "array<int>"), ("held", "int")])
    return r.select("session_id", "frame_index", F.size("confirmed").alias("confirmed"), "held")


class _lists:
    """Arrow gives arrays; the step takes lists."""

    def __init__(self, step):
        self.step = step

    def __call__(self, state, t, xs, ys):
        return self.step(state, t, list(xs) if xs is not None else [], list(ys) if ys is not None else [])


@query(f"""with recursive {REC}, o as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, height_median_m as v, row_number() over ({_O}) as rn from rec),
e as (select session_id, track_id, frame_index, rn, case when v is not null then t end as last, case when t is not null then v end as lev, null::double as since, 'acquire' as mode from o where rn = 1
 union all select session_id, track_id, frame_index, rn, case when skip then last else t end, case when skip then lev when lev is null then v when far and held < 0.6 then lev when far then v else lev + least(greatest(v - lev, -0.5 * dt), 0.5 * dt) end,
  case when skip then since when lev is not null and far and held < 0.6 then coalesce(since, t) end, case when skip then case when lev is null then 'acquire' else 'hold' end when lev is null then 'acquire' when far and held < 0.6 then 'hold' when far then 'recover' else 'stable' end
 from (select o.session_id, o.track_id, o.frame_index, o.rn, o.t, o.v, e.last, e.lev, e.since, o.t is null or o.v is null as skip, abs(o.v - e.lev) > 0.4 as far, o.t - coalesce(e.since, o.t) as held, greatest(0, o.t - e.last) as dt from e join o on o.session_id = e.session_id and o.track_id = e.track_id and o.rn = e.rn + 1))
select session_id, track_id, frame_index, round(lev, 5) as level, mode from e""")
def level_follow(spark, d):
    r = records(spark, d).select(*KEY, "frame_index", "stamp_sec", "height_median_m")
    k = win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "height_median_m"], st.follow_step(0.4, 0.5, 0.6), [("level", "double"), ("mode", "string")])
    return k.select(*KEY, "frame_index", rnd("level", 5).alias("level"), "mode")


@query(f"with {OKP}, l as (select session_id, max(frame_index) as frame_index, count(*) - 1 as overwritten from (select distinct session_id, frame_index from ok where frame_index is not null) group by 1) select session_id, frame_index, overwritten from l")
def latest_wins(spark, d):
    """What a queue of one would hand over after the whole batch: the newest frame and how many it replaced."""
    f = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", F.lit(1).alias("one")).distinct()
    return st.latest_per_batch(f, ["session_id"], "frame_index").select("session_id", "frame_index", "overwritten")


def _centres(spark, d):
    """Cluster centres of each frame with at least two points, as arrays in the order of their cells."""
    p = valid_points(spark, d).filter("frame_index is not null")
    c = p.groupBy("session_id", "frame_index", F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), (F.max("z") + 2.4).alias("h"), F.count("*").alias("n")).filter("n >= 2")
    f = c.groupBy("session_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("cx", "cy", "x", "y", "h", "n"))).alias("c"))
    take = lambda k: F.transform("c", lambda s: s[k])
    return f.select("session_id", "frame_index", (F.col("frame_index") * 0.1).alias("t"), take("x").alias("xs"), take("y").alias("ys"), F.transform("c", lambda s: s["cx"] * 1000 + s["cy"]).alias("ids"), take("h").alias("hs"), F.transform("c", lambda s: s["n"] >= 3).alias("fresh"))


@query()
def target_lock(spark, d):
    """The first centre of a session is picked, then followed; picked again whenever it was lost or ambiguous for 20 frames."""
    f = _centres(spark, d).withColumn("pick", F.when(F.col("frame_index") % 20 == 0, 0)).withColumn("epoch", F.floor(F.col("frame_index") / 1000))
    r = win.fold_rows(f, ["session_id"], ["frame_index"], ["t", "epoch", "pick", "xs", "ys"], tr.TargetLock(0.5, 0.05, 2.0, 1.5), [("status", "string"), ("x", "double"), ("y", "double"), ("predicted", "boolean"), ("generation", "int")])
    return r.select("session_id", "frame_index", "status", rnd("x").alias("x"), rnd("y").alias("y"), "predicted", "generation")


@query()
def acquired_targets(spark, d):
    f = _centres(spark, d)
    r = win.fold_rows(f, ["session_id"], ["frame_index"], ["t", "ids", "xs", "ys", "hs"], tr.Acquisition(7, 0.8, 2.6, 0.05, 1.2), [("chosen", "bigint"), ("reason", "string")])
    return r.select("session_id", "frame_index", "chosen", "reason")


@query()
def anchor_memory(spark, d):
    f = _centres(spark, d)
    r = win.fold_rows(f, ["session_id"], ["frame_index"], ["t", "frame_index", "xs", "ys", "fresh"], tr.Anchors(0.6, 3.0, 30, 2), [("held", "int"), ("confirmed", "array<int>")])
    return r.select("session_id", "frame_index", "held", F.size("confirmed").alias("confirmed"))


@query()
def tracked_centroids(spark, d):
    """Six-number Kalman filter over the centroid of each frame."""
    p = valid_points(spark, d).filter("frame_index is not null").groupBy("session_id", "frame_index").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]).withColumn("t", F.col("frame_index") * 0.1)
    out = [("x", "double"), ("y", "double"), ("z", "double"), ("speed", "double"), ("status", "string")]
    r = win.fold_rows(p, ["session_id"], ["frame_index"], ["t", "mx", "my", "mz"], tr.KalmanPoint(), out)
    return r.select("session_id", "frame_index", *[rnd(c, 5).alias(c) for c in ("x", "y", "z", "speed")], "status")


@query()
def fall_episodes(spark, d):
    """Episodes of each track from its heights, postures and descent rates."""
    h = F.col("height_median_m")
    r = win.finite_velocity(records(spark, d), KEY, "stamp_sec", "frame_index", "height_median_m", 5.0)
    posture = F.when(h >= 1.2, "standing").when(h <= 0.45, "lying").when(h <= 0.9, "sitting").otherwise("unknown")
    r = r.select(*KEY, "frame_index", "stamp_sec", F.coalesce("measured", F.lit(False)).alias("seen"), h.alias("h"), posture.alias("posture"), (-F.col("velocity")).alias("rate"), F.lit(None).cast("double").alias("base"))
    out = [("state", "string"), ("reason", "string"), ("event", "int")]
    return win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "track_id", "seen", "h", "posture", "rate", "base"], tr.Episode(), out).select(*KEY, "frame_index", "state", "reason")


@query()
def stance_baselines(spark, d):
    h = F.col("height_median_m")
    r = records(spark, d).select(*KEY, "frame_index", "stamp_sec", h.alias("h"), F.when(h >= 1.0, "standing").when(h.isNull(), "unknown").otherwise("low").alias("posture"))
    out = [("status", "string"), ("baseline", "double"), ("reason", "string")]
    return win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "track_id", "h", "posture"], tr.StanceBaseline(2.0, 0.6, 0.4), out).select(*KEY, "frame_index", "status", "baseline", "reason")


@query()
def regions_of_interest(spark, d):
    f = target_lock(spark, d).withColumn("t", F.col("frame_index") * 0.1).withColumn("extent", F.lit(0.8))
    f = f.withColumnsRenamed({"x": "px", "y": "py"})
    out = [("roi", "string"), ("x", "double"), ("y", "double"), ("radius", "double")]
    r = win.fold_rows(f, ["session_id"], ["frame_index"], ["t", "status", "px", "py", "extent"], tr.RegionOfInterest(0.5, 3.0, 1.0, 0.3, 3.0), out)
    return r.select("session_id", "frame_index", "roi", *[rnd(c, 5).alias(c) for c in ("x", "y", "radius")])


@query()
def command_answers(spark, d):
    """Catalogue listings as commands: repeats of a request are replays or conflicts, late and foreign ones are refused."""
    c = table(spark, d, "session_catalog").filter("sid is not null and listed_ts is not null")
    c = c.select("sensor_id", F.col("sid").alias("request"), F.coalesce(F.col("frame_count").cast("string"), F.lit("")).alias("payload"), (F.unix_micros(F.col("listed_ts").cast("timestamp")) / 1e6).alias("receive"), F.coalesce("session_role", F.lit("none")).alias("action")).distinct()
    c = c.withColumns({"session": F.lit("s"), "schema": F.lit(1), "epoch": F.lit(0), "version": (F.row_number().over(W.partitionBy("sensor_id").orderBy("receive", "request", "payload")) - 1).cast("int")})
    gate = tr.CommandGate("s", 1, ("development", "review", "training", "test", "none"), 86_400.0 * 400)
    return win.fold_rows(c, ["sensor_id"], ["receive", "request", "payload"], ["request", "payload", "receive", "action", "session", "schema", "epoch", "version"], gate, [("answer", "string")]).select("sensor_id", "request", "payload", "answer")


@query()
def semi_markov_states(spark, d):
    """Online probabilities of upright and low with explicit durations, from heights."""
    import numpy as np

    r = records(spark, d).filter("stamp_sec is not null and not isnan(stamp_sec)")
    h = F.coalesce("height_median_m", F.lit(0.9))
    up = F.exp(-((h - 1.4) ** 2) / 0.18)
    low = F.exp(-((h - 0.4) ** 2) / 0.18)
    r = r.select(*KEY, "frame_index", "stamp_sec", F.array(up + 0.02, low + 0.02).alias("like"))
    m = win.SemiMarkov(np.array([0.8, 0.2]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([20.0, 6.0]), np.array([1.3, 1.3]), 60.0, 0.5)
    k = win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "like"], m, [("p", "array<double>")])
    return k.select(*KEY, "frame_index", rnd(F.get("p", 1), 5).alias("low_probability"))
