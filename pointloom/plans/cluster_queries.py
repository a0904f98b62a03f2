"""Components, clusters, fits and assignments over the point and record tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..core import table
from ..operators import aggregates as agg
from ..operators import clustering as cl
from ..operators import fitting as fit
from .adapters import OKP, REC, eigen_sql, records, valid_points
from .aggregate_queries import _COV
from .geometry_queries import _GRID, grid_cells, rnd
from .registry import query


def _frames(spark, d):
    """Points with a group for each frame of each session."""
    return valid_points(spark, d).filter("frame_index is not null").withColumn("g", F.concat_ws(":", "session_id", "frame_index"))


def _recursive(nodes: str, edge: str, out: str) -> str:
    return f"""with recursive {nodes}, reach(g, root, n) as (select g, id, id from nd union select r.g, r.root, e.b from reach r join ed e on e.g = r.g and e.a = r.n), comp as (select g, n as id, min(root) as root from reach group by 1, 2) {out}"""


_VOXN = f"""{OKP}, v as (select session_id || ':' || frame_index as g, floor(x/0.5)::bigint as cx, floor(y/0.5)::bigint as cy, floor(z/0.5)::bigint as cz, count(*) as n from ok where frame_index is not null group by 1, 2, 3, 4),
nd as (select g, ((cx+100)*1000 + cy+100)*1000 + cz+100 as id, cx, cy, cz, n from v), ed as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and abs(a.cx-b.cx) <= 1 and abs(a.cy-b.cy) <= 1 and abs(a.cz-b.cz) <= 1)"""


@query(_recursive(_VOXN, "", "select comp.g, count(distinct root) as components, max(c) as largest from (select comp.g, root, count(*) over (partition by comp.g, root) as c from comp) comp group by 1"))
def voxel_components(spark, d):
    p = _frames(spark, d).select("g", *[F.floor(F.col(c) / 0.5).cast("bigint").alias(f"c{c}") for c in "xyz"]).distinct()
    c = cl.cell_components(p, ["g"], ["cx", "cy", "cz"]).groupBy("g", "component").agg(F.count("*").alias("n"))
    return c.groupBy("g").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


_GN = f"""{_GRID}, nd as (select session_id as g, ring * 100 + col as id, ring, col, range_m from g), ed as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and abs(a.ring - b.ring) <= 1 and abs(a.col - b.col) <= 1 and abs(a.range_m - b.range_m) <= greatest(0.15, 0.05 * least(a.range_m, b.range_m)))"""


@query(_recursive(_GN, "", "select g as session_id, id // 100 as ring, id % 100 as col, dense_rank() over (partition by g order by root) - 1 as component from comp"))
def grid_components(spark, d):
    """Eight-neighbour components with depth continuity, numbered by their first cell."""
    g = grid_cells(spark, d)
    c = cl.cell_components(g, ["session_id"], ["ring", "col"], True, ("range_m", 0.15, 0.05))
    return c.select("session_id", F.col("ring").cast("int").alias("ring"), F.col("col").cast("int").alias("col"), "component")


_XY = f"""{OKP}, v as (select distinct session_id || ':' || frame_index as g, floor(x/0.5)::bigint as cx, floor(y/0.5)::bigint as cy from ok where frame_index is not null), nd as (select g, (cx+100)*1000 + cy+100 as id, cx, cy from v),
ed as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and abs(a.cx-b.cx) + abs(a.cy-b.cy) <= 1)"""


@query(_recursive(_XY, "", "select g, count(distinct root) as components from comp group by 1"))
def four_neighbour_components(spark, d):
    p = _frames(spark, d).select("g", *[F.floor(F.col(c) / 0.5).cast("bigint").alias(f"c{c}") for c in "xy"]).distinct()
    return cl.cell_components(p, ["g"], ["cx", "cy"], diagonal=False).groupBy("g").agg(F.count_distinct("component").alias("components"))


_FR = f"""{OKP}, nd as (select session_id || ':' || frame_index as g, point_id as id, x, y, z from ok where frame_index is not null), ed as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.64)"""


@query(_recursive(_FR, "", "select g, count(*) as points, count(distinct root) as clusters from comp group by 1"))
def euclidean_clusters(spark, d):
    """Exact single-link clusters of each frame."""
    p = _frames(spark, d)
    c = cl.group_clusters(p, ["g"], "point_id", cl.single_link(0.8))
    return c.groupBy("g").agg(F.count("*").alias("points"), F.count_distinct("cluster").alias("clusters"))


@query(f"""with {OKP}, nd as (select session_id || ':' || frame_index as g, point_id as id, x, y, z from ok where frame_index is not null), pr as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 1.0),
dg as (select g, a as id, count(*) as n from pr group by 1, 2) select g, count(*) as points, count_if(n >= 3) as core, count_if(n < 3 and not exists (select 1 from pr p join dg q on q.g = p.g and q.id = p.b and q.n >= 3 where p.g = dg.g and p.a = dg.id)) as noise from dg group by 1""")
def density_clusters(spark, d):
    p = _frames(spark, d)

    def run(pdf):
        x = pdf[["x", "y", "z"]].to_numpy("float64")
        a, b = cl.radius_graph(x, 1.0)
        deg = np.bincount(a, minlength=len(x)) + np.bincount(b, minlength=len(x)) + 1
        return [(len(x), int((deg >= 3).sum()), int((cl.dbscan(x, 1.0, 3) < 0).sum()))]

    return fit.per_group(p.select("g", "point_id", "x", "y", "z"), ["g"], ["point_id"], run, "points bigint, core bigint, noise bigint")


@query(_recursive(_FR.replace("ed as (", "ed0 as (") + ", co as (select a.g, a.id as a, b.id as b from nd a join nd b on a.g = b.g and (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 2.56), ed as (select ed0.* from ed0 join co using (g, a, b))", "", "select g, count(distinct root) as clusters from comp group by 1"))
def coarse_fine_clusters(spark, d):
    """Clusters at 1.6 m, each split again at 0.8 m."""
    p = _frames(spark, d)
    return cl.group_clusters(p, ["g"], "point_id", cl.coarse_then_fine(1.6, 0.8)).groupBy("g").agg(F.count_distinct("cluster").alias("clusters"))


_ED = """ed0 as (select distinct 's:' || sid as a, 'n:' || sensor_id as b from session_catalog where sid is not null and sensor_id is not null)"""


@query(f"""with recursive {_ED}, ed as (select a, b from ed0 union select b, a from ed0), nd as (select distinct a as id from ed), reach(root, n) as (select id, id from nd union select r.root, e.b from reach r join ed e on e.a = r.n), comp as (select n as node, min(root) as component from reach group by 1) select node, component from comp""")
def distributed_components(spark, d):
    """Sessions and sensors joined through one another, over any number of partitions."""
    c = table(spark, d, "session_catalog").filter("sid is not null and sensor_id is not null")
    return cl.connected_components(c.select(F.concat(F.lit("s:"), "sid").alias("a"), F.concat(F.lit("n:"), "sensor_id").alias("b")))


@query("""with recursive p as (select distinct 'l:' || frame_count as a, 'r:' || substr(sid, 5, 6) as b from session_catalog where sid is not null and frame_count is not null), ed as (select a, b from p union select b, a from p), reach(root, n) as (select distinct a, a from ed union select r.root, e.b from reach r join ed e on e.a = r.n), c as (select n, min(root) as block from reach group by 1) select substr(n, 1, 1) as side, substr(n, 3) as id, block from c""")
def block_closure(spark, d):
    c = table(spark, d, "session_catalog").filter("sid is not null and frame_count is not null")
    return cl.closure(c.select(F.col("frame_count").alias("l"), F.substring("sid", 5, 6).alias("r")).distinct())


@query(f"""with {OKP}, a as (select distinct session_id, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz from ok where frame_index % 2 = 0), b as (select distinct session_id, floor(x/0.4)::bigint as cx, floor(y/0.4)::bigint as cy, floor(z/0.4)::bigint as cz from ok where frame_index % 2 = 1),
s as (select b.session_id, i.v as sx, j.v as sy, k.v as sz, b.cx + i.v as cx, b.cy + j.v as cy, b.cz + k.v as cz from b cross join (values (-1),(0),(1)) i(v) cross join (values (-1),(0),(1)) j(v) cross join (values (-1),(0),(1)) k(v)),
n as (select session_id, sx, sy, sz, count(*) as common from s join a using (session_id, cx, cy, cz) group by 1, 2, 3, 4), r as (select *, common - case when sx = 0 and sy = 0 and sz = 0 then 0 else 2.5 end as score from n), k as (select *, row_number() over (partition by session_id order by score desc, sx, sy, sz) as rn from r)
select session_id, sx, sy, sz, common, round(score, 3) as score from k where rn = 1""")
def best_tile_shifts(spark, d):
    c = valid_points(spark, d).select("session_id", "frame_index", *[F.floor(F.col(c) / 0.4).cast("bigint").alias(f"c{c}") for c in "xyz"])
    now, past = (c.filter(f"frame_index % 2 = {k}").drop("frame_index").distinct() for k in (0, 1))
    return cl.best_shift(now, past, ["session_id"], 2.5).withColumn("score", rnd("score", 3))


@query(f"""with {OKP}, c as (select session_id, {_COV} from ok where z < -1.9 group by 1 having count(*) >= 10), {eigen_sql("c")}
select session_id, n, round(v3x * sign(v3z), 3) as nx, round(v3y * sign(v3z), 3) as ny, round(v3z * sign(v3z), 3) as nz, round(-(v3x*mx + v3y*my + v3z*mz) * sign(v3z), 3) as d, round(sqrt(greatest(l3, 0)), 4) as rms, round(l2 / l1, 4) as degeneracy from eg""")
def ground_planes(spark, d):
    """Least-squares ground plane per session from mergeable covariances, in closed form: unit normal upward, offset,
    residual and degeneracy ratio; no plane where it is not clear of the next axis."""
    c = agg.covariance(valid_points(spark, d).filter("z < -1.9"), ["session_id"]).filter("n >= 10")
    e = agg.with_eigen(c)
    up = F.signum("v3z")
    n = {k: F.col(f"v3{k}") * up for k in "xyz"}
    off = -(n["x"] * F.col("mx") + n["y"] * F.col("my") + n["z"] * F.col("mz"))
    return e.select("session_id", "n", *[rnd(v, 3).alias(f"n{k}") for k, v in n.items()], rnd(off, 3).alias("d"), rnd(F.sqrt(F.greatest("l3", F.lit(0.0))), 4).alias("rms"), rnd(F.col("l2") / F.col("l1"), 4).alias("degeneracy"))


@query()
def peeled_planes(spark, d):
    """Up to six planes per session by seeded RANSAC, near-duplicates dropped."""

    def run(pdf):
        x = pdf[["x", "y", "z"]].to_numpy("float64")
        got = fit.distinct_planes(fit.peel_planes(x, 0.05, 120, 7), 5.0, 0.05)
        return [(k, *[round(float(v), 5) for v in n], round(dd, 5), s) for k, (n, dd, s) in enumerate(got)]

    p = valid_points(spark, d).select("session_id", "point_id", "x", "y", "z")
    return fit.per_group(p, ["session_id"], ["point_id"], run, "plane int, nx double, ny double, nz double, d double, support bigint")


@query(f"""with {OKP}, f as (select * from ok where frame_index is not null), c as (select session_id, frame_index, {_COV} from f group by 1, 2 having count(*) >= 6), {eigen_sql("c")},
k as (select *, v3y*v1z - v3z*v1y as v2x, v3z*v1x - v3x*v1z as v2y, v3x*v1y - v3y*v1x as v2z from eg where v1x is not null and v3x is not null),
p as (select k.session_id, k.frame_index, n, (x-mx)*v1x + (y-my)*v1y + (z-mz)*v1z as a, (x-mx)*v2x + (y-my)*v2y + (z-mz)*v2z as b, (x-mx)*v3x + (y-my)*v3y + (z-mz)*v3z as c, mx, my, mz, v1x, v1y, v1z, v2x, v2y, v2z, v3x, v3y, v3z from f join k on f.session_id = k.session_id and f.frame_index = k.frame_index),
g as (select session_id, frame_index, n, (max(a)-min(a))/2 as h1, (max(b)-min(b))/2 as h2, (max(c)-min(c))/2 as h3, (max(a)+min(a))/2 as ca, (max(b)+min(b))/2 as cb, (max(c)+min(c))/2 as cc, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, any_value(v1x) as v1x, any_value(v1y) as v1y, any_value(v1z) as v1z, any_value(v2x) as v2x, any_value(v2y) as v2y, any_value(v2z) as v2z, any_value(v3x) as v3x, any_value(v3y) as v3y, any_value(v3z) as v3z from p group by 1, 2, 3)
select session_id, frame_index, n, round(h1, 4) as half_1, round(h2, 4) as half_2, round(h3, 4) as half_3, round(mx + ca*v1x + cb*v2x + cc*v3x, 4) as center_x, round(my + ca*v1y + cb*v2y + cc*v3y, 4) as center_y, round(mz + ca*v1z + cb*v2z + cc*v3z, 4) as center_z from g""")
def oriented_boxes(spark, d):
    """Oriented box of each frame's points whose axes are clear: half sizes, largest spread first, and the centre."""

    def run(pdf):
        x = pdf[["x", "y", "z"]].to_numpy("float64")
        if len(x) < 6:
            return []
        values = np.linalg.eigvalsh(np.cov(x.T, bias=True))
        if values[2] <= 1.1 * values[1] or values[1] <= 1.1 * values[0]:
            return []
        c, _, half = fit.oriented_box(x)
        return [(len(x), *map(float, half), *map(float, c))]

    p = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", "point_id", "x", "y", "z")
    names = ["half_1", "half_2", "half_3", "center_x", "center_y", "center_z"]
    got = fit.per_group(p, ["session_id", "frame_index"], ["point_id"], run, "n bigint, " + ", ".join(f"{c} double" for c in names))
    return got.select("session_id", "frame_index", "n", *[rnd(c, 4).alias(c) for c in names])


@query()
def registered_halves(spark, d):
    """Registers the odd frames of a session onto the even ones: rotation angle, shift and residual."""

    def run(pdf):
        x, odd = pdf[["x", "y", "z"]].to_numpy("float64"), (pdf["frame_index"] % 2 == 1).to_numpy()
        if odd.sum() < 10 or (~odd).sum() < 10:
            return []
        r, t, err = fit.icp(x[odd], x[~odd], trim=0.7)
        return [(round(float(np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))), 4), round(float(np.linalg.norm(t)), 5), round(err, 5))]

    p = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", "point_id", "x", "y", "z")
    return fit.per_group(p, ["session_id"], ["point_id"], run, "angle_deg double, shift_m double, rms_m double")


@query()
def merged_fragments(spark, d):
    """Fragments of each frame merged along measured gaps under limits of growth, height and span: the component of every
    point, with the largest edge of the fragments' least spanning tree."""

    def run(pdf):
        x = pdf[["x", "y", "z"]].to_numpy("float64")
        lab = cl.single_link(0.8)(x)
        parts = [x[lab == k] for k in range(int(lab.max()) + 1)]
        largest, _ = fit.gap_graph(parts, 1.5)
        links = [(g, i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)) if (g := fit.measured_gap(parts[i], parts[j])) <= 1.5]
        owner = fit.merge_measured(x, lab, links, np.array([0.0, 0.0, 1.0, 2.4]), max_span=3.0)
        merged = cl.compact(owner)
        return [(int(p), int(f), int(merged[f]), round(largest, 5)) for p, f in zip(pdf["point_id"], lab)]

    p = valid_points(spark, d).filter("frame_index is not null").select("session_id", "frame_index", "point_id", "x", "y", "z")
    return fit.per_group(p, ["session_id", "frame_index"], ["point_id"], run, "point_id bigint, fragment int, component int, largest_gap double")


@query()
def assignments(spark, d):
    """Tracks of consecutive frames assigned three ways: least cost, greedy, most pairs."""

    def run(pdf):
        a, b = pdf[pdf["frame_index"] % 2 == 0], pdf[pdf["frame_index"] % 2 == 1]
        x, y = a[["x", "y"]].to_numpy("float64"), b[["x", "y"]].to_numpy("float64")
        if not len(x) or not len(y):
            return []
        c = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        c[c > 2.0] = np.inf
        out = []
        for name, got in (("optimal", fit.assign_optimal(c, 2.0)), ("greedy", fit.assign_greedy(c)), ("most", fit.assign_most(c))):
            out.append((name, sum(j >= 0 for j in got), round(float(sum(c[i, j] for i, j in enumerate(got) if j >= 0)), 5)))
        return out

    p = valid_points(spark, d).filter("frame_index is not null").withColumn("pair", F.floor(F.col("frame_index") / 2)).select("session_id", "pair", "frame_index", "point_id", "x", "y")
    return fit.per_group(p, ["session_id", "pair"], ["frame_index", "point_id"], run, "method string, pairs int, cost double")


@query()
def alarm_matching(spark, d):
    """Low-height alarms matched to labelled suspected falls of the same track by earliest deadline."""
    from ..operators.intervals import usable_intervals
    from ..operators.windows import transitions

    e = usable_intervals(table(spark, d, "label_intervals")).filter("label in ('suspected_fall', 'sustained_low_posture')")
    e = e.select("session_id", "track_id", F.lit(0).alias("kind"), F.col("start_frame").cast("double").alias("a"), F.col("end_frame").cast("double").alias("b"))
    low = records(spark, d).withColumn("low", F.coalesce(F.col("height_median_m") <= 0.4, F.lit(False))).select("session_id", "track_id", "frame_index", "low")
    al = transitions(low, ["session_id", "track_id"], ["frame_index"], "low").filter("to_state").select("session_id", "track_id", F.lit(1).alias("kind"), F.col("frame_index").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    quiet = usable_intervals(table(spark, d, "label_intervals")).filter("label in ('upright', 'sitting')")
    quiet = quiet.select("session_id", "track_id", F.lit(2).alias("kind"), F.col("start_frame").cast("double").alias("a"), (F.col("end_frame") + 1).cast("double").alias("b"))

    def run(pdf):
        ev, no = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 2]
        got = fit.match_alarms_scored([(k, a, b) for k, (a, b) in enumerate(zip(ev["a"], ev["b"]))], pdf.loc[pdf["kind"] == 1, "a"].tolist(), list(zip(no["a"], no["b"])))
        return [(int(t), i, o) for t, i, o in got]

    return fit.per_group(e.unionByName(al).unionByName(quiet), ["session_id", "track_id"], ["kind", "a", "b"], run, "alarm_frame int, event int, outcome string")
