"""Temporal queries over height records, frames and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..operators import windows as win
from .adapters import FRM, OKP, REC, STA, frame_rows, frames, records, seconds, valid_points
from .geometry_queries import rnd
from .registry import query

KEY = ["session_id", "track_id"]
_K = "partition by session_id, track_id"
_O = f"{_K} order by frame_index"
_SEG = f"""{REC}, st as (select *, stamp_sec - lag(stamp_sec) over ({_O}) as step from rec), sg as (select *, sum(case when coalesce(step > 0 and step <= 0.5, false) then 0 else 1 end) over ({_O}) as segment from st)"""


def segmented(spark, d):
    return win.segments(records(spark, d), KEY, "stamp_sec", ["frame_index"], 0.5)


def low(limit=0.6):
    return F.coalesce(F.col("height_median_m") <= limit, F.lit(False))


@query(f"""with {_SEG}, lw as (select *, coalesce(height_median_m <= 0.6, false) as low from sg), ch as (select *, case when lag(low) over (partition by session_id, track_id, segment order by stamp_sec, frame_index) is not distinct from low then 0 else 1 end as c from lw),
rn as (select *, sum(c) over (partition by session_id, track_id, segment order by stamp_sec, frame_index) as run from ch), sn as (select *, stamp_sec - min(stamp_sec) over (partition by session_id, track_id, segment, run) as since from rn where low)
select session_id, track_id, segment, min(frame_index) as start_frame, max(frame_index) as end_frame, round(max(stamp_sec) - min(stamp_sec), 5) as duration_s, count(*) as frames, round(min(height_median_m), 6) as min_value, min(case when since >= 0.7 then frame_index end) as trigger_frame, count(case when since >= 0.7 then 1 end) > 0 as qualified
from sn group by session_id, track_id, segment, run""")
def sustained_low_intervals(spark, d):
    q = win.qualified_intervals(segmented(spark, d), [*KEY, "segment"], "stamp_sec", "frame_index", low(), "height_median_m", 0.7)
    return q.select(*KEY, "segment", "start_frame", "end_frame", rnd("duration_s", 5).alias("duration_s"), "frames", rnd("min_value").alias("min_value"), "trigger_frame", "qualified")


@query(f"with {_SEG} select session_id, track_id, count(distinct segment) as segments, count(*) as rows, max(segment) as last_segment from sg group by 1, 2")
def gap_segments(spark, d):
    return segmented(spark, d).groupBy(*KEY).agg(F.count_distinct("segment").alias("segments"), F.count("*").alias("rows"), F.max("segment").alias("last_segment"))


@query(f"""with {_SEG}, t as (select *, stamp_sec - min(stamp_sec) over (partition by session_id, track_id, segment) as ts from sg where stamp_sec is not null)
select session_id, track_id, frame_index, case when count(height_median_m) over w >= 2 then round(-regr_slope(height_median_m, ts) over w, 4) end as descent_rate from t window w as (partition by session_id, track_id, segment order by round(ts*1e6)::bigint range between 1200000 preceding and current row)""")
def descent_rates(spark, d):
    s = segmented(spark, d).filter("stamp_sec is not null")
    return win.descent_rate(s, [*KEY, "segment"], "stamp_sec", "height_median_m", 1.2).select(*KEY, "frame_index", rnd("descent_rate", 4).alias("descent_rate"))


_LOWRUN = f"""{_SEG}, lw as (select *, coalesce(height_median_m <= 0.6, false) as low from sg), ch as (select *, case when lag(low) over (partition by session_id, track_id, segment order by frame_index) is not distinct from low then 0 else 1 end as c from lw),
rn as (select *, sum(c) over (partition by session_id, track_id, segment order by frame_index) as run from ch), ld as (select *, case when low then stamp_sec - min(stamp_sec) over (partition by session_id, track_id, segment, run) else 0 end as low_s from rn)"""


@query(f"with {_LOWRUN} select session_id, track_id, frame_index, round(low_s, 5) as low_s, case when low_s >= 1.0 then 2 when low_s >= 0.4 then 1 else 0 end as level from ld")
def low_durations_and_levels(spark, d):
    r = win.low_duration(segmented(spark, d), [*KEY, "segment"], "stamp_sec", low(), ["frame_index"])
    return r.select(*KEY, "frame_index", rnd("low_s", 5).alias("low_s"), win.alert_level(F.col("low_s"), 0.4, 1.0).alias("level"))


@query(f"""with {REC}, lw as (select *, coalesce(height_median_m <= 0.6, false) as low, stamp_sec - lag(stamp_sec) over ({_O}) as step from rec), ad as (select *, case when low and lag(low) over ({_O}) and step > 0 and step <= 0.3 then step else 0 end as a from lw)
select session_id, track_id, round(sum(a), 4) as low_total_s from ad group by 1, 2""")
def accumulated_low_time(spark, d):
    r = win.accumulated_low(records(spark, d), KEY, "stamp_sec", ["frame_index"], low(), 0.3)
    return r.groupBy(*KEY).agg(rnd(F.max("low_total_s"), 4).alias("low_total_s"))


@query(f"""with {REC}, v as (select session_id, track_id, frame_index, case when frame_index = lag(frame_index) over w + 1 and stamp_sec - lag(stamp_sec) over w > 0 then least(greatest((height_median_m - lag(height_median_m) over w) / (stamp_sec - lag(stamp_sec) over w), -2.5), 2.5) end as v0,
 height_median_m - lag(height_median_m) over w as dv from rec window w as ({_O})) select session_id, track_id, frame_index, case when dv is not null then round(v0, 4) end as velocity from v""")
def bounded_velocities(spark, d):
    return win.finite_velocity(records(spark, d), KEY, "stamp_sec", "frame_index", "height_median_m", 2.5).select(*KEY, "frame_index", rnd("velocity", 4).alias("velocity"))


@query(f"with {REC} select session_id, track_id, frame_index, round(quantile_cont(height_median_m, 0.5) over ({_O} rows between 4 preceding and current row), 6) as median_k from rec")
def sliding_medians(spark, d):
    return win.sliding_median(records(spark, d), KEY, ["frame_index"], "height_median_m", 5).select(*KEY, "frame_index", rnd("median_k").alias("median_k"))


@query(f"""with recursive {REC}, o as (select session_id, track_id, frame_index, height_median_m as v, row_number() over ({_O}) as rn from rec where height_median_m is not null),
e as (select session_id, track_id, frame_index, rn, v as ema from o where rn = 1 union all select o.session_id, o.track_id, o.frame_index, o.rn, e.ema + 0.3 * (o.v - e.ema) from e join o on o.session_id = e.session_id and o.track_id = e.track_id and o.rn = e.rn + 1)
select session_id, track_id, frame_index, round(ema, 9) as ema from e""")
def exponential_means(spark, d):
    r = records(spark, d).filter("height_median_m is not null").select(*KEY, "frame_index", "height_median_m")
    return win.fold_rows(r, KEY, ["frame_index"], ["height_median_m"], win.ema_step(0.3), [("ema", "double")]).select(*KEY, "frame_index", rnd("ema", 9).alias("ema"))


@query(f"""with recursive {REC}, o as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, height_median_m as v, row_number() over ({_O}) as rn from rec),
e as (select session_id, track_id, frame_index, rn, case when v is not null then t end as t0, case when t is not null then v end as m, case when t is not null then v end as l, v as tr, case when v is null then 1 else 0 end as missed from o where rn = 1
 union all select session_id, track_id, frame_index, rn, case when v is null or t is null then t0 when m is null or t > t0 then t else t0 end, case when v is null or t is null then m when m is null then v when t > t0 then m + (1 - exp(-(t - t0) / 0.5)) * (v - m) else m end,
  case when v is null or t is null then l when l is null then v when t > t0 then l + least(greatest(v - l, -0.8 * (t - t0)), 0.8 * (t - t0)) else l end,
  case when v is null then case when missed + 1 >= 3 then null else tr end when tr is null or abs(v - tr) > 0.5 then v else tr + 0.3 * (v - tr) end, case when v is null then missed + 1 else 0 end
 from (select o.session_id, o.track_id, o.frame_index, o.rn, o.t, o.v, e.t0, e.m, e.l, e.tr, e.missed from e join o on o.session_id = e.session_id and o.track_id = e.track_id and o.rn = e.rn + 1))
select session_id, track_id, frame_index, round(m, 9) as ema, round(l, 9) as limited, round(tr, 9) as tracked from e""")
def irregular_means_and_slew(spark, d):
    r = records(spark, d).select(*KEY, "frame_index", "stamp_sec", "height_median_m")
    e = win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "height_median_m"], win.irregular_ema_step(0.5), [("ema", "double")])
    s = win.fold_rows(e, KEY, ["frame_index"], ["stamp_sec", "height_median_m"], win.slew_step(0.8), [("limited", "double")])
    j = win.fold_rows(s, KEY, ["frame_index"], ["height_median_m"], win.jump_ema_step(0.3, 0.5, 3), [("tracked", "double")])
    return j.select(*KEY, "frame_index", *[rnd(c, 9).alias(c) for c in ("ema", "limited", "tracked")])


@query(f"""with recursive {REC}, {STA}, o as (select session_id, track_id, frame_index, case when not isnan(stamp_sec) then stamp_sec end as t, plain as p, row_number() over ({_O}) as rn from sta),
e as (select session_id, track_id, frame_index, rn, p, null::varchar as held, case when t is not null then p end as cand, case when t is not null and p is not null then t end as since, t as last from o where rn = 1
 union all select session_id, track_id, frame_index, rn, p, case when done then c1 else held end, case when back or done then null else c1 end, case when back or done then null else s1 end, coalesce(t, last)
 from (select *, coalesce(not back and c1 is not null and t - s1 >= case when c1 = 'lying' then 1.5 else 0.2 end, false) as done from (select *, case when p is null or p is not distinct from held then null else p end as c1, case when p is null or p is not distinct from held then null when p is distinct from cand then t else since end as s1
 from (select o.session_id, o.track_id, o.frame_index, o.rn, o.t, o.p, e.held, e.cand, e.since, e.last, o.t is null or coalesce(o.t < e.last, false) as back from e join o on o.session_id = e.session_id and o.track_id = e.track_id and o.rn = e.rn + 1))))
select session_id, track_id, frame_index, p as posture, held from e""")
def dwell_postures(spark, d):
    from .streaming_states import plain_state

    r = records(spark, d).select(*KEY, "frame_index", "stamp_sec", plain_state(F.col("state")).alias("posture"))
    return win.fold_rows(r, KEY, ["frame_index"], ["stamp_sec", "posture"], win.dwell_step(0.2, {"lying": 1.5}), [("held", "string")]).select(*KEY, "frame_index", "posture", "held")


@query(f"""with {REC}, w as (select session_id, track_id, frame_index, stamp_sec, list({{'t': stamp_sec, 'v': height_median_m}}) over ({_O} rows between 15 preceding and current row) as h from rec where stamp_sec is not null),
f as (select *, list_transform(list_filter(h, lambda s: s.t >= stamp_sec - 1.2 and s.v is not null), lambda s: s.v) as v from w)
select session_id, track_id, frame_index, len(v)::int as held, round(list_min(v), 6) as held_min, round(list_max(v), 6) as held_max from f""")
def pruned_windows(spark, d):
    r = records(spark, d).filter("stamp_sec is not null")
    return win.pruned_window(r, KEY, "stamp_sec", ["frame_index"], "height_median_m", 1.2, 16).select(*KEY, "frame_index", "held", rnd("held_min").alias("held_min"), rnd("held_max").alias("held_max"))


_FT = f"""{FRM}, ft as (select session_id, frame_index, max(stamp_sec + stamp_nanosec / 1e9) as t, max(count_points) as c from frm where stamp_nanosec between 0 and 999999999 and stamp_sec is not null and not (stamp_sec = 0 and stamp_nanosec = 0) and count_points >= 0 and frame_index is not null group by 1, 2)"""


def frame_times(spark, d):
    from ..operators.geometry import stamp_ok

    f = frame_rows(spark, d).filter(stamp_ok() & (F.col("count_points") >= 0) & F.col("frame_index").isNotNull())
    return f.groupBy("session_id", "frame_index").agg(F.max(F.col("stamp_sec") + F.col("stamp_nanosec") / 1e9).alias("t"), F.max("count_points").alias("c"))


@query(f"with {_FT} select session_id, frame_index, round(c / nullif(max(c) over (partition by session_id order by round(t*1e6)::bigint range between 10000000 preceding and current row), 0)::double, 6) as visible from ft")
def peak_relative_visibility(spark, d):
    return win.peak_share(frame_times(spark, d), ["session_id"], "t", "c", 10.0).select("session_id", "frame_index", rnd("visible").alias("visible"))


@query(f"""with {_SEG}, v as (select session_id, track_id, frame_index, coalesce(avg((coalesce(height_median_m <= 0.6, false))::int) over (partition by session_id, track_id order by round(stamp_sec*1e6)::bigint range between 1000000 preceding and current row) > 0.5, false) as vote,
 coalesce(last_value(case when height_median_m >= 1.0 then true when height_median_m <= 0.5 then false end ignore nulls) over ({_O} rows between unbounded preceding and current row), false) as on_,
 sum(coalesce((height_median_m <= 0.6)::int, 0)) over ({_O} rows between 7 preceding and current row) >= 3 as confirmed from sg where stamp_sec is not null) select session_id, track_id, frame_index, vote, on_ as "on", confirmed from v""")
def votes_hysteresis_confirmation(spark, d):
    r = segmented(spark, d).filter("stamp_sec is not null")
    r = win.majority(r, KEY, "stamp_sec", low(), 1.0)
    r = win.hysteresis(r, KEY, ["frame_index"], F.col("height_median_m"), 1.0, 0.5)
    r = win.confirmed(r, KEY, ["frame_index"], F.col("height_median_m") <= 0.6, 3, 8)
    return r.select(*KEY, "frame_index", "vote", "on", "confirmed")


@query(f"""with {REC}, k as (select *, sum(coalesce((height_median_m <= 0.6)::int, 0)) over w as lo, sum(coalesce((height_median_m >= 1.0)::int, 0)) over w as hi from rec window w as ({_O} rows between 2 preceding and current row))
select session_id, track_id, frame_index, coalesce(last_value(case when hi = 3 then true when lo = 3 then false end ignore nulls) over ({_O} rows between unbounded preceding and current row), false) as latched from k""")
def latches(spark, d):
    return win.latch(records(spark, d), KEY, ["frame_index"], F.col("height_median_m"), 1.0, 0.6, 3).select(*KEY, "frame_index", "latched")


@query(f"""with {OKP}, c as (select session_id, frame_index, avg(x) as x, avg(y) as y from ok where frame_index is not null group by 1, 2), s as (select *, coalesce(sqrt((x - lag(x) over w)**2 + (y - lag(y) over w)**2), 0) as st from c window w as (partition by session_id order by frame_index)),
r as (select *, first_value(x) over w as fx, first_value(y) over w as fy, sum(st) over w - first_value(st) over w as path from s window w as (partition by session_id order by frame_index range between 5 preceding and current row))
select session_id, frame_index, round(sqrt((x-fx)**2 + (y-fy)**2), 5) as net_m, round(path, 5) as path_m from r""")
def motion_progress(spark, d):
    c = valid_points(spark, d).filter("frame_index is not null").groupBy("session_id", "frame_index").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return win.progress(c, ["session_id"], "frame_index", "x", "y", 5.0).select("session_id", "frame_index", rnd("net_m", 5).alias("net_m"), rnd("path_m", 5).alias("path_m"))


@query(f"""with {REC}, r as (select *, row_number() over ({_O}) - 1 as rn, count(*) over ({_K}) as n from rec), g as (select session_id, track_id, n, unnest(range(0, n - 20 + 1, 10)) as win from (select distinct session_id, track_id, n from r) where n >= 20)
select g.session_id, g.track_id, g.win as "window", count(*) as rows, round(avg(height_median_m), 9) as mean, round(stddev_pop(height_median_m), 6) as std, round(quantile_cont(height_median_m, 0.1), 6) as p10, round(quantile_cont(height_median_m, 0.9), 6) as p90, round(arg_max(height_median_m, frame_index) - arg_min(height_median_m, frame_index), 6) as change
from g join r on r.session_id = g.session_id and r.track_id = g.track_id and r.rn between g.win and g.win + 19 group by 1, 2, 3""")
def hopping_window_features(spark, d):
    h = win.hopping_rows(records(spark, d), KEY, ["frame_index"], 20, 10)
    v, has = "height_median_m", F.col("height_median_m").isNotNull()
    p = F.percentile(v, [0.1, 0.9])
    change = F.max_by(v, F.when(has, F.col("frame_index"))) - F.min_by(v, F.when(has, F.col("frame_index")))
    a = h.groupBy(*KEY, "window").agg(F.count("*").alias("rows"), rnd(F.avg(v), 9).alias("mean"), rnd(F.stddev_pop(v)).alias("std"), p.alias("p"), rnd(change).alias("change"))
    return a.select(*KEY, "window", "rows", "mean", "std", rnd(F.get("p", 0)).alias("p10"), rnd(F.get("p", 1)).alias("p90"), "change")


@query(f"with {_SEG}, p as (select *, (row_number() over (partition by session_id, track_id, segment order by frame_index) - 1) // 5 as packet from sg) select session_id, track_id, segment, packet, count(*) as rows, round(max(stamp_sec), 6) as stamp from p group by 1, 2, 3, 4")
def packet_aggregation(spark, d):
    p = win.packets(segmented(spark, d), [*KEY, "segment"], ["frame_index"], 5)
    return p.groupBy(*KEY, "segment", "packet").agg(F.count("*").alias("rows"), rnd(F.max("stamp_sec")).alias("stamp"))


@query(f"with {REC}, w as (select session_id, track_id, frame_index, generation as to_state, lag(generation) over ({_O}) as from_state, row_number() over ({_O}) as rn from rec) select session_id, track_id, frame_index, from_state, to_state from w where rn = 1 or from_state is distinct from to_state")
def state_transitions(spark, d):
    return win.transitions(records(spark, d).select(*KEY, "frame_index", "generation"), KEY, ["frame_index"], "generation").select(*KEY, "frame_index", "from_state", "to_state")


@query(f"""with {REC}, i as (select *, coalesce(height_median_m <= 0.5, false) as ins from rec), c as (select *, case when lag(ins) over ({_O}) is not distinct from ins then 0 else 1 end as ch from i), r as (select *, sum(ch) over ({_O}) as run from c),
e as (select session_id, track_id, run, min(frame_index) as s, max(frame_index) as e from r where ins group by 1, 2, 3) select session_id, track_id, row_number() over ({_K} order by run) as episode, s as start, e as "end" from e""")
def notification_episodes(spark, d):
    return win.episodes(records(spark, d), KEY, ["frame_index"], F.col("height_median_m") <= 0.5, "frame_index")


@query(f"with {_FT} select session_id, floor(t / 30)::bigint as bucket, count(*) as frames, round(quantile_cont(c, 0.5), 4) as p50, round(quantile_cont(c, 0.95), 4) as p95, round(count(*) / 30.0, 6) as rate from ft group by 1, 2")
def performance_windows(spark, d):
    p = F.percentile("c", [0.5, 0.95])
    a = frame_times(spark, d).groupBy("session_id", F.floor(F.col("t") / 30).alias("bucket")).agg(F.count("*").alias("frames"), p.alias("p"), rnd(F.count("*") / 30.0).alias("rate"))
    return a.select("session_id", "bucket", "frames", rnd(F.get("p", 0), 4).alias("p50"), rnd(F.get("p", 1), 4).alias("p95"), "rate")


@query(f"""with {REC}, l as (select *, last_value(case when not isnan(stamp_sec) then stamp_sec end ignore nulls) over ({_O} rows between unbounded preceding and 1 preceding) as lst from rec),
c as (select *, case when stamp_sec is null or isnan(stamp_sec) then 'invalid' when lst is null then 'first' when stamp_sec - lst = 0 then 'repeated' when stamp_sec - lst < 0 then 'regressed' when stamp_sec - lst > 1.0 then 'forward_jump' else 'ok' end as clock from l)
select session_id, track_id, frame_index, clock, sum(case when clock in ('regressed', 'forward_jump') then 1 else 0 end) over ({_O})::bigint as epoch from c""")
def clock_classes(spark, d):
    return win.clock_class(records(spark, d), KEY, ["frame_index"], "stamp_sec", 1.0).select(*KEY, "frame_index", "clock", "epoch")


@query(f"with {REC}, s as (select *, stamp_sec - lag(stamp_sec) over ({_O}) as st from rec) select session_id, track_id, count(*) as n, count_if(stamp_sec is null) as invalid, count_if(st = 0) as repeated, count_if(st < 0) as regressed, round(median(case when st > 0 then st end), 5) as median_step, round(max(case when st > 0 then st end), 5) as max_step from s group by 1, 2")
def timing_quality(spark, d):
    return win.timing_quality(records(spark, d), KEY, ["frame_index"], "stamp_sec").withColumns({c: rnd(c, 5) for c in ("median_step", "max_step")})


@query(f"""with {REC}, s as (select session_id, track_id, count(*) as n, round(avg(height_median_m), 9) as h from rec group by 1, 2), k as (select *, row_number() over w as rk, lead(n) over w as second from s window w as (partition by session_id order by n desc, h, track_id))
select session_id, track_id, n, second, coalesce(second >= 0.9 * n, false) as ambiguous from k where rk = 1""")
def choice_with_ambiguity(spark, d):
    s = records(spark, d).groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.avg("height_median_m"), 9).alias("h"))
    return win.choose_with_ambiguity(s, ["session_id"], [F.desc("n"), F.asc_nulls_last("h"), F.asc("track_id")], "n", "track_id", 0.9).select(*KEY, "n", "second", "ambiguous")


@query(f"""with {REC}, s as (select session_id, track_id, frame_index, case when height_median_m is null then 'none' when height_median_m <= 0.6 then 'low' else 'high' end as st from rec), p as (select lag(st) over ({_O}) as a, st as b from s), n as (select a, b, count(*) as n from p where a is not null group by 1, 2),
e as (select x.s as a, y.s as b from (values ('none'), ('low'), ('high')) x(s), (values ('none'), ('low'), ('high')) y(s)), j as (select e.a, e.b, coalesce(n, 0) as n from e left join n using (a, b)) select a as from_state, b as to_state, n, round((n + 1) / sum(n + 1) over (partition by a)::double, 6) as probability from j""")
def markov_counts(spark, d):
    st = F.when(F.col("height_median_m").isNull(), "none").when(F.col("height_median_m") <= 0.6, "low").otherwise("high")
    r = records(spark, d).select(*KEY, "frame_index", st.alias("st"))
    return win.transition_counts(r, KEY, ["frame_index"], "st", ["none", "low", "high"], 1.0).withColumn("probability", rnd("probability"))


@query()
def markov_paths(spark, d):
    """Causal filter and best path of a two-state model fitted on the written states."""
    import numpy as np
    import pandas as pd

    from ..core import group_starts, stream_groups
    from .streaming_states import plain_state

    r = records(spark, d).select(*KEY, "frame_index", F.when(plain_state(F.col("state")).isin("lying", "low_posture", "sitting"), 1).when(F.col("state").isNotNull(), 0).alias("truth"), F.coalesce(F.least(F.floor(F.col("height_median_m") / 0.3), F.lit(6)).cast("int"), F.lit(-1)).alias("obs"))
    pair = r.withColumn("was", F.lag("truth").over(win.over(KEY, ["frame_index"]))).filter("truth is not null")
    pairs = {(x[0], x[1]): x[2] for x in pair.filter("was is not null").groupBy("was", "truth").count().collect()}
    seen = {(x[0], x[1]): x[2] for x in pair.filter("obs >= 0").groupBy("truth", "obs").count().collect()}
    model = win.Hmm.fit(pairs, seen, 2, 7)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = group_starts(pdf, KEY)
        f, v = np.empty(len(pdf), "int32"), np.empty(len(pdf), "int32")
        obs = pdf["obs"].to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            f[lo:hi], v[lo:hi] = model.filter(obs[lo:hi]), model.viterbi(obs[lo:hi])
        return pdf[[*KEY, "frame_index"]].assign(filtered=f, path=v)

    return stream_groups(r, KEY, ["frame_index"], run, "session_id string, track_id string, frame_index int, filtered int, path int")


@query("""with e as (select *, epoch_us(ts) / 1e6 as t from events), g as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) <= 86400 then 0 else 1 end as new from e), s as (select *, sum(new) over (partition by user_id order by t, event_id) as session from g)
select user_id, session::bigint as session, count(*) as events, round(max(t) - min(t), 3) as duration_s, count_if(event_type = 'error') as errors, round(sum(value), 4) as value from s group by 1, 2""")
def event_sessions(spark, d):
    """Sessions of the event table by a gap of a day."""
    e = table(spark, d, "events").withColumn("t", seconds("ts"))
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) <= 86400, 0).otherwise(1)
    s = e.withColumn("__n", new).withColumn("session", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), rnd(F.max("t") - F.min("t"), 3).alias("duration_s"), F.count_if(F.col("event_type") == "error").alias("errors"), rnd(F.sum("value"), 4).alias("value"))
