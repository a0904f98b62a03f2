"""Queries of the llm operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from . import language, leakage, runs, splits, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.posture_runs(table(spark, d, "posture_frames"), runs.EXACT)
    return found.filter("frames >= 2").select("session_id", "track_id", "state", "start_frame", "end_frame")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.posture_runs(table(spark, d, "posture_frames"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = splits.session_components(table(spark, d, "session_catalog"))
    return c.filter("component < sid").select(F.col("component").alias("group_sid"), "sid")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.session_splits(table(spark, d, "session_catalog"), table(spark, d, "meta_frames"), table(spark, d, "split_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(spark, table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(spark, table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_languages(spark, d).filter("is_case").select("doc_id", "lang_code")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(spark, table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(spark, table(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_splits, p7_ids, p8_found, p8_leaks, p9_found, p9_languages, p9_segments)}


_P1 = """
with held as (
  select session_id, track_id, frame_index, stamp_sec,
    regexp_replace(lower(translate(state, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ',
      'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')), '[^a-z]', '', 'g') as bare,
    row_number() over (partition by session_id, track_id, frame_index order by recv_ts desc nulls last, record_id desc) as rn
  from posture_frames where track_id is not null and frame_index is not null),
forms(form, plain) as (values ('upright','upright'),('descending','descending'),('low_posture','lowposture'),('lying','lying'),('sitting','sitting'),('unknown','unknown')),
spelled as (select bare, arg_min(form, levenshtein(bare, plain)) as st from (select distinct bare from held where bare <> '') cross join forms group by bare),
rec as (select h.session_id, h.track_id, h.frame_index, h.stamp_sec, s.st from held h left join spelled s using (bare) where rn = 1),
"""

ORACLE = {
    "p1_found": _P1
    + """
step as (select *, case when st is not null and lag(st) over w = st and stamp_sec - lag(stamp_sec) over w > 0
    and stamp_sec - lag(stamp_sec) over w <= 0.5 then 0 else 1 end as new
  from rec window w as (partition by session_id, track_id order by frame_index)),
run as (select *, sum(new) over (partition by session_id, track_id order by frame_index) as k from step)
select session_id, track_id, st as state, min(frame_index) as start_frame, max(frame_index) as end_frame
from run where st is not null group by session_id, track_id, st, k having count(*) >= 2
""",
    # the same dynamic programme, a step of every stretch at a time: costs of the six states, then back along the choices
    "p1_runs": _P1.replace("with held", "with recursive held")
    + """
words(c, form, plain) as (values (1,'upright','upright'),(2,'descending','descending'),(3,'low_posture','lowposture'),(4,'lying','lying'),(5,'sitting','sitting'),(6,'unknown','unknown')),
apart as (select a.c, a.form, list(case when a.c = b.c then 0 else 100 + 10 * levenshtein(a.plain, b.plain) end order by b.c) as d from words a cross join words b group by a.c, a.form),
cutting as (select *, case when st is not null and lag(st) over w is not null and stamp_sec - lag(stamp_sec) over w > 0 and stamp_sec - lag(stamp_sec) over w <= 0.5 then 0 else 1 end as cut
  from rec window w as (partition by session_id, track_id order by frame_index)),
stretch as (select *, sum(cut) over (partition by session_id, track_id order by frame_index) as g from cutting where st is not null),
change as (select *, case when cut = 0 and lag(st) over (partition by session_id, track_id order by frame_index) = st then 0 else 1 end as np from stretch),
packed as (select *, sum(np) over (partition by session_id, track_id order by frame_index) as k from change),
pack as (select session_id, track_id, g, k, st, count(*) as n, min(frame_index) as a, max(frame_index) as b, min(stamp_sec) as t0, max(stamp_sec) as t1 from packed group by all),
step as (select p.*, dense_rank() over (order by session_id, track_id, g) as sid, row_number() over (partition by session_id, track_id, g order by k) as i, apart.c, list_transform(apart.d, lambda x: x * n) as w from pack p join apart on apart.form = p.st),
dp(sid, i, cost, back) as (
  select sid, i, w, [1,2,3,4,5,6] from step where i = 1
  union all
  select s.sid, s.i, list_transform([1,2,3,4,5,6], lambda k: least(dp.cost[k], list_min(dp.cost) + 200) + s.w[k]),
    list_transform([1,2,3,4,5,6], lambda k: case when dp.cost[k] <= list_min(dp.cost) + 200 then k else list_position(dp.cost, list_min(dp.cost)) end)
  from dp join step s on s.sid = dp.sid and s.i = dp.i + 1),
walk(sid, i, own, was) as (
  select sid, max(i), arg_max(list_position(cost, list_min(cost)), i), arg_max(back, i) from dp group by sid
  union all
  select dp.sid, dp.i, walk.was[walk.own], dp.back from walk join dp on dp.sid = walk.sid and dp.i = walk.i - 1),
chosen as (select s.*, walk.own, case when s.i > 1 and lag(walk.own) over (partition by s.sid order by s.i) = walk.own then 0 else 1 end as new from step s join walk on walk.sid = s.sid and walk.i = s.i),
run as (select *, sum(new) over (partition by sid order by i) as r from chosen)
select any_value(session_id) as session_id, any_value(track_id) as track_id, any_value(words.form) as state, min(a) as start_frame, max(b) as end_frame, sum(n)::bigint as frames,
  sum(case when run.c = own then n else 0 end)::bigint as same_frames, max(t1) - min(t0) as duration_sec
from run join words on words.c = run.own group by sid, r
""",
    "p2_found": """
with recursive norm as (
  select sid, unnest([
    's:' || regexp_replace(regexp_replace(lower(subject), '[^\\p{L}\\p{N}]', '', 'g'), '^(subject|subj)', ''),
    'a:' || regexp_replace(lower(author), '[^\\p{L}\\p{N}]', '', 'g'),
    'b:' || regexp_replace(regexp_replace(lower(source_bag_sha256), '[^\\p{L}\\p{N}]', '', 'g'), '^sha256', '')]) as tok
  from session_catalog where sid is not null),
link as (select distinct sid, tok from norm where tok is not null and not regexp_matches(tok, '^.:(unknown|none|na|tbd|anon|notrecorded|pending|0*)$')),
hub as (select tok, min(sid) as h from link group by tok),
edge as (select distinct sid as a, h as b from link join hub using (tok) union select h, sid from link join hub using (tok)),
reach(root, n) as (select distinct a, a from edge union select r.root, e.b from reach r join edge e on e.a = r.n),
comp as (select n as sid, min(root) as group_sid from reach group by n)
select group_sid, sid from comp where group_sid < sid
""",
}


def oracle_sql():
    return dict(ORACLE)
