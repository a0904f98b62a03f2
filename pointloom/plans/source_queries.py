"""Ledger, retention, digest and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import models
from ..sources import files
from .adapters import FRM, OKP, REC, frame_rows, records, valid_points
from .geometry_queries import rnd
from .registry import query


@query("""select sid, frame_count, session_role from (select *, row_number() over (partition by sid order by listed_ts desc nulls last, frame_count desc nulls last, session_role desc nulls last) as rn from (select distinct sid, frame_count, session_role, listed_ts from session_catalog where sid is not null)) where rn = 1""")
def session_table_upsert(spark, d):
    """The catalogue after its repeated listings: the last listing of a sid wins."""
    from ..core import latest_per_key

    c = table(spark, d, "session_catalog").filter("sid is not null")
    return latest_per_key(c, ["sid"], ["listed_ts", "frame_count", "session_role"], ["frame_count", "session_role"])


@query("select distinct sid, sensor_id, evict from (select *, row_number() over (partition by sensor_id order by p desc, created_ts desc, sid desc) > 3 as evict from (select sid, max(sensor_id) as sensor_id, max(created_ts) as created_ts, case when max(session_role) = 'review' then 1 else 0 end as p from session_catalog where sid is not null group by 1))")
def retention_policy(spark, d):
    c = table(spark, d, "session_catalog").filter("sid is not null").groupBy("sid").agg(F.max("sensor_id").alias("sensor_id"), F.max("created_ts").alias("created_ts"), F.when(F.max("session_role") == "review", 1).otherwise(0).alias("p"))
    return files.retention(c, ["sensor_id"], "p", "created_ts", 3, "sid").select("sid", "sensor_id", "evict")


@query("select file_id, sha256(raw_json) as digest, length(raw_json) as chars from (select distinct file_id, raw_json from session_files where raw_json is not null)")
def document_digests(spark, d):
    f = table(spark, d, "session_files").filter("raw_json is not null").select("file_id", "raw_json").distinct()
    return f.select("file_id", F.sha2("raw_json", 256).alias("digest"), F.length("raw_json").alias("chars"))


@query(f"with {FRM}, f as (select session_id, frame_index, max(offset_points) as o, max(count_points) as c from frm where frame_index is not null group by 1, 2), l as (select *, lag(o) over w as po, lag(c) over w as pc, frame_index - lag(frame_index) over w as df from f window w as (partition by session_id order by frame_index)) select session_id, count(*) as frames, count_if(coalesce(df = 1 and o < po, false)) as falling, count_if(coalesce(df = 1 and c >= 0 and pc >= 0 and o = po + pc, false)) as contiguous, count_if(coalesce(df > 1, false)) as holes from l group by 1")
def frame_index_consistency(spark, d):
    """Whether offsets rise and join, and where frame numbers have holes."""
    from pyspark.sql import Window as W

    f = frame_rows(spark, d).filter("frame_index is not null").groupBy("session_id", "frame_index").agg(F.max("offset_points").alias("o"), F.max("count_points").alias("c"))
    w = W.partitionBy("session_id").orderBy("frame_index")
    l = f.withColumns({"po": F.lag("o").over(w), "pc": F.lag("c").over(w), "df": F.col("frame_index") - F.lag("frame_index").over(w)})
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    one = F.col("df") == 1
    return l.groupBy("session_id").agg(F.count("*").alias("frames"), yes(one & (F.col("o") < F.col("po"))).alias("falling"), yes(one & (F.col("c") >= 0) & (F.col("pc") >= 0) & (F.col("o") == F.col("po") + F.col("pc"))).alias("contiguous"), yes(F.col("df") > 1).alias("holes"))


@query("select event_type, json_extract_string(props, '$.k') as k, count(*) as events, round(avg(value), 6) as mean_value from events group by all")
def ledger_projection(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("events"), rnd(F.avg("value")).alias("mean_value"))


@query(f"""with {OKP}, a as (select session_id, frame_index, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, quantile_cont(z, 0.1) as p10, quantile_cont(z, 0.5) as p50, quantile_cont(z, 0.9) as p90, var_pop(x) as vx, var_pop(y) as vy, var_pop(z) as vz, avg(intensity) as mi, count_if(z < -1.8) / count(*)::double as low_share from ok group by 1, 2)
select session_id, frame_index, n, round(mx, 6) as mx, round(my, 6) as my, round(mz, 6) as mz, round(p10, 6) as p10, round(p50, 6) as p50, round(p90, 6) as p90, round(vx, 6) as vx, round(vy, 6) as vy, round(vz, 6) as vz, round(mi, 6) as mi, round(low_share, 6) as low_share from a""")
def frame_features(spark, d):
    return _features(spark, d).select("session_id", "frame_index", "n", *[rnd(c).alias(c) for c in _FEATURES[1:]])


_FEATURES = ["n", "mx", "my", "mz", "p10", "p50", "p90", "vx", "vy", "vz", "mi", "low_share"]


def _features(spark, d):
    p = F.percentile("z", [0.1, 0.5, 0.9])
    a = valid_points(spark, d).groupBy("session_id", "frame_index").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], p.alias("p"), *[F.var_pop(c).alias(f"v{c}") for c in "xyz"], F.avg("intensity").alias("mi"), (F.count_if(F.col("z") < -1.8) / F.count("*")).alias("low_share")
    )
    return a.withColumns({"p10": F.get("p", 0), "p50": F.get("p", 1), "p90": F.get("p", 2)}).drop("p")


@query()
def forest_scores(spark, d):
    """A small forest fitted on a bounded sample (at most 2000 frames by hash) scores every frame; windows to sessions."""
    f = _features(spark, d).withColumn("label", (F.col("low_share") > 0.3).cast("int"))
    s = f.dropna(subset=_FEATURES).orderBy(F.xxhash64("session_id", "frame_index")).limit(2000).toPandas()
    cols = [c for c in _FEATURES if c != "low_share"]
    m = models.Forest.fit(s[cols].to_numpy("float64"), s["label"].to_numpy("int64"), 2, 12, 5, 3)
    r = models.score(f, cols, m, 2)
    return models.mean_share(r, ["session_id"], 2).select("session_id", "windows", rnd("s1").alias("low_probability"), "class")


@query(f"with {REC} select session_id, (cast('0x' || substr(md5('11:' || session_id), 1, 8) as bigint) % 5)::int as fold, count(*) as rows from rec group by 1, 2")
def fold_rows_kept(spark, d):
    """Group folds: each session in one fold, no row lost or doubled."""
    return models.group_folds(records(spark, d), "session_id", 5).groupBy("session_id", "fold").agg(F.count("*").alias("rows"))
