"""Foreground, membership, clock, evidence and vector queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import table
from ..functions import arrays as fa
from ..operators import aggregates as agg
from ..operators import filters as flt
from .adapters import OKP, REC, records, valid_points
from .geometry_queries import _GRID, grid_cells, rnd
from .join_queries import _VOX, voxels
from .registry import query


@query(f"""with {_GRID}, m as (select ring, col, count(*) as n, median(range_m) as med from g group by 1, 2), a as (select g.ring, g.col, median(abs(range_m - med)) as mad from g join m using (ring, col) group by 1, 2),
b as (select ring, col, n, med, greatest(0.005, 1.4826 * mad) as sigma from m join a using (ring, col)), q as (select ring, col, range_m as q98 from (select *, row_number() over (partition by ring, col order by range_m) as rn, count(*) over (partition by ring, col) as n from g) where rn = least(floor(n * 0.98), n - 1) + 1)
select session_id, ring, col, case when n >= 5 then abs(range_m - med) > greatest(0.04, 4 * sigma) end as foreground, range_m - q98 < -0.15 as nearer from g join b using (ring, col) join q using (ring, col)""")
def foreground_cells(spark, d):
    """Off the robust background (null where it isn't known), and nearer than the 98 % order statistic."""
    g = grid_cells(spark, d)
    b = agg.robust_background(g, ["ring", "col"], "range_m", 5)
    q = agg.order_statistic(g, ["ring", "col"], "range_m", 0.98).withColumnRenamed("range_m", "q98")
    j = g.join(b, ["ring", "col"]).join(q, ["ring", "col"])
    fore = flt.foreground(F.col("range_m") - F.col("median"), F.col("sigma"), F.when(F.col("known"), True))
    return j.select("session_id", "ring", "col", fore.alias("foreground"), (F.col("range_m") - F.col("q98") < -0.15).alias("nearer"))


@query(f"""with {OKP}, t as (select point_id, session_id, case when ring is null then null else ring % 3 = 0 end as truth, z < -1.5 as said from ok) select session_id, count_if(said) as predicted, count_if(said and truth is null) as unlabelled,
 case when count_if(said and truth is null) > 0 then null else round(count_if(said and truth) / nullif(count_if(said), 0)::double, 6) end as purity, round(count_if(said and truth) / nullif(count_if(truth), 0)::double, 6) as recall from t group by 1""")
def membership_purity(spark, d):
    """Purity is unknown as soon as one predicted row has no label."""
    t = valid_points(spark, d).select("session_id", (F.col("ring") % 3 == 0).alias("truth"), (F.col("z") < -1.5).alias("said"))
    hit, said, none = F.count_if(F.col("said") & F.col("truth")), F.count_if("said"), F.count_if(F.col("said") & F.col("truth").isNull())
    return t.groupBy("session_id").agg(said.alias("predicted"), none.alias("unlabelled"), F.when(none == 0, rnd(hit / F.nullif(said, F.lit(0)))).alias("purity"), rnd(hit / F.nullif(F.count_if("truth"), F.lit(0))).alias("recall"))


@query("""with m as (select session_id, frame_index, max(bag_time_sec) as b, max(stamp_sec + stamp_nanosec / 1e9) as s from meta_frames where stamp_nanosec between 0 and 999999999 and stamp_sec is not null and bag_time_sec is not null and frame_index is not null and not isnan(bag_time_sec) group by 1, 2)
select session_id, count(*) as anchors, round(median(b - s), 4) as clock_offset, round(arg_max(b - s, frame_index) - arg_min(b - s, frame_index), 4) as drift from m group by 1""")
def clock_offsets(spark, d):
    """Median offset of recorder and device clock, and its drift from the first frame to the last."""
    f = table(spark, d, "meta_frames").filter("stamp_nanosec between 0 and 999999999 and stamp_sec is not null and bag_time_sec is not null and frame_index is not null and not isnan(bag_time_sec)")
    m = f.groupBy("session_id", "frame_index").agg(F.max("bag_time_sec").alias("b"), F.max(F.col("stamp_sec") + F.col("stamp_nanosec") / 1e9).alias("s")).withColumn("o", F.col("b") - F.col("s"))
    return m.groupBy("session_id").agg(F.count("*").alias("anchors"), rnd(F.percentile("o", 0.5), 4).alias("clock_offset"), rnd(F.max_by("o", "frame_index") - F.min_by("o", "frame_index"), 4).alias("drift"))


@query(f"""with {OKP}, c as (select distinct session_id, frame_index, floor(x/0.5)::bigint * 4096 + floor(y/0.5)::bigint as cell from ok where frame_index is not null), f as (select distinct session_id, frame_index from c),
e as (select f.session_id, f.frame_index, count(distinct cell) as n from f join c on c.session_id = f.session_id and c.frame_index between f.frame_index - 5 and f.frame_index - 3 group by 1, 2), l as (select f.session_id, f.frame_index, count(distinct cell) as n from f join c on c.session_id = f.session_id and c.frame_index between f.frame_index - 2 and f.frame_index group by 1, 2)
select session_id, frame_index, coalesce(e.n, 0) as early_cells, l.n as late_cells from l left join e using (session_id, frame_index)""")
def half_window_unions(spark, d):
    """Cells occupied in the three frames before the last three, and in the last three."""
    c = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", (F.floor(F.col("x") / 0.5) * 4096 + F.floor(F.col("y") / 0.5)).alias("cell")).distinct()
    s = c.groupBy("session_id", "frame_index").agg(F.collect_set("cell").alias("cells"))
    w = W.partitionBy("session_id").orderBy("frame_index")
    n = lambda a, b: F.size(F.array_distinct(F.flatten(F.collect_list("cells").over(w.rangeBetween(a, b))))).cast("bigint")
    return s.select("session_id", "frame_index", n(-5, -3).alias("early_cells"), n(-2, 0).alias("late_cells"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))), 4) as norm, len(embedding) as dims, (list_position(embedding, list_min(embedding)) - 1)::bigint as lowest, (list_position(embedding, list_max(embedding)) - 1)::bigint as highest, round(embedding[2]::double - embedding[1], 5) as first_step from embeddings""")
def vector_functions(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", rnd(fa.norm(e), 4).alias("norm"), F.size(e).alias("dims"), fa.argmin(e).alias("lowest"), fa.argmax(e).alias("highest"), rnd(F.get(fa.diff(F.transform(e, lambda x: x.cast("double"))), 0), 5).alias("first_step"))


@query(f"""with {REC}, r as (select session_id, track_id, height_median_m as v, (row_number() over (partition by session_id, track_id order by frame_index) - 1) // 16 as packet from rec where height_median_m is not null) select session_id, track_id, packet, round(sum(v), 6) as total, count(*) as n from r group by 1, 2, 3""")
def running_sums(spark, d):
    """Running sum of each packet of 16 heights; its last element is their total."""
    r = records(spark, d).filter("height_median_m is not null")
    w = W.partitionBy("session_id", "track_id").orderBy("frame_index")
    r = r.withColumn("rn", F.row_number().over(w) - 1).withColumn("packet", F.floor(F.col("rn") / 16))
    t = r.groupBy("session_id", "track_id", "packet").agg(F.array_sort(F.collect_list(F.struct("rn", "height_median_m"))).alias("a"))
    c = fa.cumsum(F.transform("a", lambda s: s["height_median_m"]))
    return t.select("session_id", "track_id", "packet", rnd(F.element_at(c, -1)).alias("total"), F.size("a").cast("bigint").alias("n"))


@query(f"""with {OKP}, p as (select session_id, frame_index, point_id, x, y from ok where frame_index is not null), h as (select a.session_id, a.frame_index as f0, a.point_id, a.x, a.y, b.x - a.x as vx, b.y - a.y as vy from p a join p b on a.session_id = b.session_id and b.frame_index = a.frame_index + 1 where (a.x-b.x)**2 + (a.y-b.y)**2 between 0.01 and 0.04),
k as (select h.session_id, h.point_id, h.f0, h.vx, h.vy, count(distinct c.frame_index) as hits from h join p c on c.session_id = h.session_id and c.frame_index between h.f0 + 2 and h.f0 + 5 and (h.x + h.vx * (c.frame_index - h.f0) - c.x)**2 + (h.y + h.vy * (c.frame_index - h.f0) - c.y)**2 <= 0.01 group by 1, 2, 3, 4, 5)
select session_id, count(*) as supported, max(hits) as best from k group by 1""")
def track_before_detect(spark, d):
    """Motion hypotheses from two frames, supported by later frames near where they lead."""
    from ..operators.joins import radius_join

    p = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", "point_id", "x", "y")
    nxt = p.withColumn("frame_index", F.col("frame_index") - 1)
    h = radius_join(p, nxt, ["session_id", "frame_index"], ["x", "y"], 0.2).filter((F.col("dist") * F.col("dist") >= 0.01))
    h = h.select("session_id", F.col("frame_index").alias("f0"), "point_id", "x", "y", (F.col("x_r") - F.col("x")).alias("vx"), (F.col("y_r") - F.col("y")).alias("vy"))
    at = h.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(2, 6)])))
    at = at.select("session_id", (F.col("f0") + F.col("k")).alias("frame_index"), "f0", "point_id", "vx", "vy", (F.col("x") + F.col("vx") * F.col("k")).alias("x"), (F.col("y") + F.col("vy") * F.col("k")).alias("y"))
    j = radius_join(at, p, ["session_id", "frame_index"], ["x", "y"], 0.1)
    k = j.groupBy("session_id", "point_id", "f0", "vx", "vy").agg(F.count_distinct("frame_index").alias("hits"))
    return k.groupBy("session_id").agg(F.count("*").alias("supported"), F.max("hits").alias("best"))
