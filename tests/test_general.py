"""The general training-data operators against brute force, and their edge cases."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.operators import drift, intervals, regular_grid, spatial

spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=25)


def covered(rows):
    return {f for a, n in rows for f in range(a, a + n + 1)}


@settings(max_examples=200, deadline=None)
@given(spans)
def test_interval_map(rows):
    m = intervals.IntervalMap()
    for a, n in rows:
        m.insert(a, a + n)
    frames = covered(rows)
    assert {f for a, b in zip(m.starts, m.ends) for f in range(a, b + 1)} == frames
    assert all(e + 1 < s for e, s in zip(m.ends, m.starts[1:]))
    if frames:
        assert {f for a, b in m.gaps for f in range(a, b + 1)} == set(range(min(frames), max(frames) + 1)) - frames
    assert m.gaps == intervals.IntervalMap(m.starts, m.ends).gaps


LABELS = "interval_id long, session_id string, track_id string, label string, start_frame int, end_frame int, saved_ts timestamp, extra string, piece string"


def test_label_periods_edges(spark):
    import datetime as dt

    t = [dt.datetime(2026, 1, 1, h) for h in range(5)]
    rows = [
        (1, "s", "t", " Lying　", 0, 10, t[0], None, "x"), (2, "s", "t", "lying", 11, 20, t[0], None, "x"), (3, "s", "t", "LYING", 30, 40, t[0], "a", "x"),
        (4, "s", "t", "lying", 100, 200, t[0], None, "x"), (4, "s", "t", "lying", 5, 4, t[1], None, "x"),  # the later delivery is unusable
        (5, "s", None, "lying", 0, 5, t[0], None, "x"), (6, "s", "t", " ", 0, 5, t[0], None, "x"), (7, "s", "t", None, 0, 5, t[0], None, "x"), (8, "s", "t", "lying", None, 5, t[0], None, "x"),
        (9, "s", "t", "lying", -1, 5, t[0], None, "x"), (10, None, "t", "lying", 1, 2, None, None, "x"), (10, None, "t", "lying", 1, 2, None, None, "x"),
    ]
    got = {tuple(r) for r in intervals.label_periods(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {("s", "t", "lying", "period", 0, 20), ("s", "t", "lying", "gap", 21, 29), ("s", "t", "lying", "period", 30, 40), (None, "t", "lying", "period", 1, 2)}
    assert intervals.label_periods(spark.createDataFrame([], LABELS)).count() == 0


def test_hot_entity_is_merged_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr("'s' as e", "cast(id % 5000 as int) * 3 as a", "cast(id % 5000 as int) * 3 + cast(id % 2 as int) as b").repartition(4)
    got = intervals.merge_intervals(df, ["e"], "a", "b").toPandas()
    assert (got["piece"] == "period").sum() == 5000 and (got["piece"] == "gap").sum() == 4999


def test_entities_over_many_batches(spark):
    """Batches of a few rows: an entity goes on from batch to batch with its last period, null entities too."""
    rng = np.random.RandomState(7)
    rows = [(["a", "b", None][rng.randint(3)], int(x), int(x) + int(rng.randint(0, 40))) for x in rng.randint(0, 20_000, 900)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = intervals.merge_intervals(spark.createDataFrame(rows, "e string, a int, b int").repartition(3), ["e"], "a", "b").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for e in ("a", "b", None):
        m = intervals.IntervalMap()
        for k, x, y in rows:
            if k == e:
                m.insert(x, y)
        assert sorted((r["piece"], r["a"], r["b"]) for r in got if r["e"] == e) == sorted(m.pieces())


META = "session_id string, frame_index int, stamp_sec long, stamp_nanosec long, count_points long, recv_ts string, slot_no int"


def dense_smoother(slots, readings):
    """Joint Gaussian of level and trend at every node, solved at once."""
    nodes = sorted([(t, 0, y, n) for t, y, n in readings] + [((k + 0.5) * 0.5, 1, k, 0) for k in range(slots)])
    m = len(nodes)
    h, g = np.zeros((2 * m, 2 * m)), np.zeros(2 * m)
    at = 0.0
    for k, (t, kind, y, n) in enumerate(nodes):
        dt = t - at
        f = np.array([[1, dt], [0, 1.0]])
        q = regular_grid._predict(0, 0, 0, 0, 0, dt)
        cov = np.array([[q[2], q[3]], [q[3], q[4]]]) + 1e-12 * np.eye(2)
        s = slice(2 * k, 2 * k + 2)
        if k == 0:
            h[s, s] += np.linalg.inv(f @ np.diag(regular_grid.PRIOR) @ f.T + cov)
        else:
            p, i = slice(2 * k - 2, 2 * k), np.linalg.inv(cov)
            h[s, s] += i
            h[p, p] += f.T @ i @ f
            h[s, p] -= i @ f
            h[p, s] -= f.T @ i
        if kind == 0:
            h[2 * k, 2 * k] += n
            g[2 * k] += n * y
        at = t
    x, c = np.linalg.solve(h, g), np.linalg.inv(h)
    return {nodes[k][2]: (x[2 * k], np.sqrt(c[2 * k, 2 * k])) for k in range(m) if nodes[k][1] == 1}


def test_smoother_matches_dense_solution():
    rng = np.random.RandomState(1)
    readings = [(k * 0.5 + 0.1 + 0.2 * rng.rand(), float(rng.randn() + k * 0.3), int(rng.randint(1, 4))) for k in (0, 1, 2, 6, 7, 12)]
    # two lanes of different length side by side
    some = readings[:3]
    t, y, n = (np.array(x) for x in zip(*readings, *some))
    lane = np.array([0] * len(readings) + [1] * len(some))
    v, d = regular_grid._smooth_lanes(lane, t, y, n, np.array([13, 5]), np.tile(regular_grid._START, (2, 1)), np.zeros((2, 5)))
    for at, slots, r in ((0, 13, readings), (13, 5, some)):
        want = dense_smoother(slots, r)
        assert np.allclose(v[at : at + slots], [want[k][0] for k in range(slots)], atol=1e-4) and np.allclose(d[at : at + slots], [want[k][1] for k in range(slots)], atol=1e-4)


def test_grid_chunks_give_the_uncut_result(spark, monkeypatch):
    rng = np.random.RandomState(2)
    rows = []
    for s, n in (("a", 90), ("b", 3)):
        t = np.cumsum(rng.exponential(0.4, n)) + 100
        t[n // 2 :] += 12.0
        rows += [(s, k, int(x), int((x % 1) * 1e9), int(1000 + 50 * np.sin(x)), "r", 7) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows + rows[:20], META)
    whole = regular_grid.regular_grid(df).toPandas().sort_values(["session_id", "slot_no"], ignore_index=True)
    monkeypatch.setattr(regular_grid, "CHUNK", 16)
    # the workers see the patched constant through the pickled functions' module only in this process, so fold by hand
    cut = _regrid(df.toPandas(), 16).sort_values(["session_id", "slot_no"], ignore_index=True)
    assert len(whole) == len(cut) and np.allclose(whole["value"], cut["value"], atol=1e-5) and np.allclose(whole["sd"], cut["sd"], atol=1e-5)


def _regrid(pdf, chunk):
    """The chunked path of one process: elements, messages, smoothing."""
    pdf = pdf.drop_duplicates()
    pdf["slot_no"] = pdf["stamp_sec"] * 2 + (pdf["stamp_nanosec"] >= 500_000_000)
    pdf["t"] = (pdf["stamp_nanosec"] % 500_000_000) / 1e9
    g = pdf.groupby(["session_id", "slot_no"]).agg(n=("t", "size"), t=("t", "mean"), y=("count_points", "mean"), v=("count_points", lambda x: x.var(ddof=0))).reset_index()
    out = []
    for s, r in g.groupby("session_id"):
        within = (r["n"] * r["v"]).sum() / max((r["n"] - 1).sum(), 1)
        scale = np.sqrt(within) if within > 0 else (np.sqrt(r["y"].var(ddof=0)) or 1.0)
        r = r.assign(first=r["slot_no"].min(), last=r["slot_no"].max(), mean=(r["n"] * r["y"]).sum() / r["n"].sum(), scale=scale)
        r["chunk"] = (r["slot_no"] - r["first"]) // chunk
        marks = pd.DataFrame({"session_id": s, "slot_no": np.nan, "n": 0, "t": np.nan, "y": np.nan, "first": r["first"].iloc[0], "last": r["last"].iloc[0], "mean": r["mean"].iloc[0], "scale": scale, "chunk": range(int(r["last"].iloc[0] - r["first"].iloc[0]) // chunk + 1)})
        every = pd.concat([marks, r.drop(columns="v")]).sort_values(["chunk", "slot_no"], na_position="first", ignore_index=True)
        if len(marks) > 1:
            m = regular_grid._messages(regular_grid._elements(every))
            marked = marks.merge(m, on=["session_id", "chunk"])
            every = pd.concat([marked, r.drop(columns="v")]).sort_values(["chunk", "slot_no"], na_position="first", ignore_index=True)
        else:
            every = r.drop(columns="v").assign(**{c: np.nan for c in regular_grid._MSG})
        out += list(regular_grid._smoothed(every.reset_index(drop=True)))
    return pd.concat(out)


def test_grid_edges(spark):
    rows = [("a", 0, 10, 0, 5, "r", 1), ("a", 0, 10, 0, 5, "q", 1), ("a", 1, 12, 600_000_000, 7, "r", 1), ("a", 2, 0, 0, 7, "r", 1), ("a", 3, None, 5, 7, "r", 1), ("a", 4, 11, 1_000_000_000, 7, "r", 1), ("a", 5, 11, 5, -1, "r", 1), ("b", 0, 3, 3, 3, "r", 1), ("c", 0, 3, None, 3, "r", 1)]
    got = regular_grid.regular_grid(spark.createDataFrame(rows, META)).toPandas()
    a = got[got["session_id"] == "a"].sort_values("slot_no")
    assert a["slot_no"].tolist() == list(range(20, 26)) and a["missing"].tolist() == [False, True, True, True, True, False] and a["readings"].tolist() == [1, 0, 0, 0, 0, 1]
    assert len(got[got["session_id"] == "b"]) == 1 and not (got["session_id"] == "c").any() and got["value"].notna().all()
    assert regular_grid.regular_grid(spark.createDataFrame([], META)).count() == 0


def test_grid_long_source_runs_in_chunks(spark):
    df = spark.range(9000).selectExpr("'s' as session_id", "cast(id as int) as frame_index", "id * 3 as stamp_sec", "5L as stamp_nanosec", "1000 + id % 7 as count_points", "'r' as recv_ts", "1 as slot_no")
    got = regular_grid.regular_grid(df).toPandas()
    assert len(got) == (9000 - 1) * 6 + 1 and got["slot_no"].is_unique and got["missing"].sum() == (9000 - 1) * 5
    assert got["value"].between(995, 1012).all() and got["sd"].gt(0).all()


FIELDS = [("meta", "format", "string"), ("meta", "size_bytes", "integer"), ("meta", "ratio", "number"), ("meta", "box", "object"), ("meta", "box.names", "array"), ("meta", "box.end", "string")]


def drift_of(spark, docs):
    good = {"format": "clip_v1", "size_bytes": 28, "ratio": 1.5, "box": {"names": ["x", "y"], "end": "little"}}
    texts = [json.dumps(good | {"size_bytes": 28 + k % 2}) for k in range(12)] + docs
    files = spark.createDataFrame([(k, "s", "meta", None, t, "z") for k, t in enumerate(texts)], "file_id long, session_id string, file_kind string, saved_ts timestamp, raw_json string, field_path string")
    fields = spark.createDataFrame(FIELDS, "file_kind string, field_path string, json_type string")
    got = drift.schema_drift(files, fields).collect()
    assert all(r[0] >= 12 for r in got)
    return [sorted((r[1], r[2]) for r in got if r[0] == 12 + k) for k in range(len(docs))], files, fields


def test_drift_kinds(spark):
    good = {"format": "clip_v1", "size_bytes": 28, "ratio": 1.5, "box": {"names": ["x", "y"], "end": "little"}}
    no = lambda *k: {a: b for a, b in good.items() if a not in k}
    docs = [
        json.dumps(no("format")), json.dumps(no("format") | {"fmt": "clip_v1"}), json.dumps(good | {"size_bytes": "28"}), json.dumps(good | {"size_bytes": 28.0}), json.dumps(good | {"ratio": 2}), json.dumps(good | {"note": "night shift"}),
        json.dumps(no("box") | {"container": {"names": ["x", "y"], "endian": "little"}}), json.dumps(good | {"box": "none"}), json.dumps(no("box")), json.dumps(good | {"ratio": None}), "", "{", None, "[1]", json.dumps(good) + json.dumps(good), '{"format": NaN}',
        json.dumps(no("size_bytes") | {"SizeBytes": "28", "done": True}), " \n" + json.dumps(good),
    ]
    got, files, fields = drift_of(spark, docs)
    bad = [("$", "unreadable")]
    assert got[:6] == [[("format", "removed")], [("format", "renamed")], [("size_bytes", "retyped")], [("size_bytes", "retyped")], [], [("note", "added")]]
    assert got[6] == [("box", "renamed"), ("box.end", "renamed")] and got[7] == [("box", "retyped")] and got[8] == [("box", "removed")] and got[9] == []
    assert got[10] == got[11] == got[12] == bad and got[14] == bad and got[15] == bad
    assert got[13] == sorted((p, "removed") for _, p, _ in FIELDS if "." not in p)
    assert got[16] == sorted([("size_bytes", "renamed"), ("size_bytes", "retyped"), ("done", "added")]) and got[17] == []
    t = {r["file_id"]: r for r in drift.consistent_table(files, fields).collect()}
    assert t[13]["format"] == "clip_v1" and t[14]["size_bytes"] == 28 and t[18]["box_end"] == "little" and t[28]["size_bytes"] == 28 and 22 not in t


def test_names_decide_before_numbers_that_fit_anywhere(spark):
    """total_points under a new name is 0, as total_dropped_points mostly is; a retyped format is 1, as format_version is."""
    names = ["format", "format_version", "total_points", "total_dropped_points"]
    fields = spark.createDataFrame([("meta", n, "string" if n == "format" else "integer") for n in names], "file_kind string, field_path string, json_type string")
    good = {"format": "clip_v1", "format_version": 1, "total_points": 1_000_000, "total_dropped_points": 0}
    texts = [json.dumps(good | {"total_points": 1_000_000 + 7 * k}) for k in range(40)]
    texts += ['{"format": "clip_v1", "format_version": 1, "n_points": 0}', '{"doc_format": 1, "total_points": 1000001, "total_dropped_points": 0}', '{"Format": 1, "total_points": 1000001, "total_dropped_points": 0}']
    files = spark.createDataFrame([(k, "s", "meta", None, t) for k, t in enumerate(texts)], "file_id long, session_id string, file_kind string, saved_ts timestamp, raw_json string")
    got = {tuple(r) for r in drift.schema_drift(files, fields).collect()}
    both = {(k, f, d) for k in (41, 42) for f, d in (("format", "renamed"), ("format", "retyped"), ("format_version", "removed"))}
    assert got == {(40, "total_points", "renamed"), (40, "total_dropped_points", "removed")} | both


def test_values_and_failed_casts(spark):
    """Integers stay exact, and what a type can't hold is null and listed."""
    names = {"t": "integer", "n": "number", "b": "boolean", "a": "array", "s": "string"}
    fields = spark.createDataFrame([("meta", n, t) for n, t in names.items()], "file_kind string, field_path string, json_type string")
    ok = {"t": 1764172069123456789, "n": 1.5, "b": True, "a": ["x", 1], "s": "é"}
    texts = [
        json.dumps(ok), '{"t": "1764172069123456789", "n": "2e3", "b": "true", "a": "x,y", "s": 1.50}', '{"t": "1_000", "n": "nan", "b": "maybe", "a": 3, "s": {"x": 1, "y": 2}}', '{"t": %d, "n": 1e999, "b": 1, "a": {}, "s": [7]}' % 10**30,
        '{"t": 28.0, "n": null, "b": null, "a": null, "s": null}', '{"t": [5], "n": 1764172069123456789, "b": "True", "a": {"0": 1, "1": 2}, "s": ""}', "[]", "5",
    ]
    files = spark.createDataFrame([(k, "s", "meta", None, t) for k, t in enumerate(texts)], "file_id long, session_id string, file_kind string, saved_ts timestamp, raw_json string")
    got = {r["file_id"]: r for r in drift.consistent_table(files, fields).collect()}
    row = lambda k: tuple(got[k][c] for c in ("t", "n", "b", "a", "s", "failed_casts"))
    assert row(0) == (1764172069123456789, 1.5, True, '["x", 1]', "é", []) and row(1) == (1764172069123456789, 2000.0, True, '["x", "y"]', "1.50", [])
    assert row(2) == (None, None, None, '["3"]', None, ["b", "n", "s", "t"]) and row(3) == (None, None, None, None, "7", ["a", "b", "n", "t"])
    assert row(4) == (28, None, None, None, None, []) and row(5) == (5, 1764172069123456789.0, None, "[1, 2]", "", ["b"])
    assert row(6) == row(7) == (None,) * 5 + ([],)


def test_path_maps(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1e3}}}}}}}, "a.b": 2, "n": 12345678901234567890123, "x": "' + "y" * 200 + '"}'
    files = spark.createDataFrame([(1, "s", "meta", None, deep), (2, "s", "meta", None, "{"), (3, "s", "meta", None, "[1, 2.50]"), (4, "s", "meta", None, None)], "file_id long, session_id string, file_kind string, saved_ts timestamp, raw_json string")
    got = {r["file_id"]: r for r in drift.path_maps(files).collect()}
    e = {k: tuple(v) for k, v in got[1]["entries"].items()}
    assert e["a.b.c.d.e.f.g.h"] == ("number", "1e3") and e["n"] == ("integer", "12345678901234567890123") and e["x"][1] == "y" * 200 and e["a.b"] == ("object", None) and e[""] == ("object", None)
    assert not got[2]["readable"] and not got[4]["readable"] and got[2]["entries"] == {} and got[3]["entries"][""]["type"] == "array"
    assert {(r["field_path"], r["json_type"], r["files"]) for r in drift.path_statistics(files).collect()} >= {("$", "object", 1), ("$", "array", 1), ("a.b.c.d.e.f.g.h", "number", 1)}
    assert drift.leaves(json.loads(deep)["a"]) == ["1000"]


POINTS = "point_id long, session_id string, sensor_id string, x float, y float, z float, key_a int, zone_id int"
ZONES = "zone_id long, sensor_id string, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double"


def cloud(rng, n):
    p = np.round(rng.rand(n, 3) * [0.5, 0.5, 0.2] - [0.25, 0.25, 0.1] + rng.choice([0.0, 2.0, -2.0], (n, 1)), 3)
    return [(k, f"s{k % 2}", f"n{k % 3}", *map(float, np.float32(p[k])), 1, 2) for k in range(n)]


def test_near_and_zone_match_brute_force(spark):
    rng = np.random.RandomState(4)
    rows = cloud(rng, 700)
    zones = []
    for k in range(60):
        lo = rng.rand(3) * 4 - 2.2
        zones.append((k, f"n{k % 4}", *[float(v) for c in range(3) for v in (lo[c], lo[c] + 0.5 + rng.rand() * 3)]))
    zones += [(99, "n0", 1.0, 0.5, 0.0, 1.0, 0.0, 1.0), (98, "n1", None, 1.0, 0.0, 1.0, 0.0, 1.0)]
    extra = rows[:40] + [(900, "s0", "n0", float("nan"), 0.0, 0.0, 1, 1), (901, "s0", "n0", None, 0.0, 0.0, 1, 1), (902, "s0", "n0", 0.0, 0.0, 0.0, 1, 1), (903, "s0", "n0", float("inf"), 1.0, 1.0, 1, 1), (904, "s0", "n0", 100.0, 1.0, 0.0, 1, 1)]
    pts, zs = spark.createDataFrame(rows + extra, POINTS), spark.createDataFrame(zones, ZONES)
    got = {tuple(r) for r in spatial.near_and_zone(spark, pts, zs).collect()}
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] == b[1] and sum((u - v) ** 2 for u, v in zip(a[3:6], b[3:6])) <= 0.0305**2:
                want.add(("near", a[0], b[0]))
        hit = [z[0] for z in zones if z[1] == a[2] and all(v is not None for v in z[2:]) and all(z[2 + 2 * c] <= a[3 + c] < z[3 + 2 * c] for c in range(3))]
        if hit:
            want.add(("zone", a[0], max(hit)))
    assert got == want and any(r[0] == "near" for r in want) and any(r[0] == "zone" for r in want)
    slabs = {tuple(r) for r in spatial.zone_of_points(spark, spatial.valid_points(pts), zs, limit=5).collect()}
    assert slabs == {r[1:] for r in want if r[0] == "zone"}
    rows_ = spatial.valid_points(pts).select(F.col("point_id").alias("key_a"), "sensor_id", *[F.col(c).cast("double") for c in "xyz"])
    cut = spatial.zone_by_slabs(spark, rows_, zs, slab_edges=3, most_slabs=6, slab_points=40).groupBy("key_a").agg(F.max("key_b").alias("key_b"))
    assert {tuple(r) for r in cut.collect()} == slabs
    near = {r[1:] for r in want if r[0] == "near"}
    for some, few in ((20, 100), (2, 100), (20, 0)):  # hot blocks are cut, listed or joined
        got = [tuple(r) for r in spatial.near_pairs(spatial.valid_points(pts), block_points=some, hot_list=few).collect()]
        assert len(got) == len(set(got)) and set(got) == near


def test_many_overlapping_zones_of_one_sensor():
    rng = np.random.RandomState(5)
    n, m = 5000, 20_000
    low = rng.rand(n, 3) * 8 - 5
    high = low + rng.rand(n, 3) * [4, 4, 2]
    z = pd.DataFrame({"zone_id": rng.permutation(n), "sensor_id": "n"} | {f"{c}_{k}": v[:, i] for k, v in (("min", low), ("max", high)) for i, c in enumerate("xyz")})
    p = rng.rand(m, 3) * 10 - 5
    start = time.time()
    got = spatial.Slabs(z).locate(pd.Series(["n"] * m), *p.T)
    assert time.time() - start < 30
    ids = z["zone_id"].to_numpy()
    for k in rng.choice(m, 500, replace=False):
        hit = ids[((low <= p[k]) & (p[k] < high)).all(1)]
        assert got[k] == (hit.max() if len(hit) else -1)


def test_one_block_of_a_million_points(spark):
    df = spark.range(1_000_000).selectExpr("id as point_id", "'s' as session_id", "cast((id % 100) * 0.0199 + 0.001 as float) as x", "cast((id div 100 % 100) * 0.0199 + 0.001 as float) as y", "cast((id div 10000) * 0.0199 + 0.001 as float) as z")
    got = spatial.near_pairs(df, 0.0200)
    assert got.count() == 3 * 99 * 100 * 100 and got.distinct().count() == 3 * 99 * 100 * 100


def test_spatial_empty(spark):
    pts, zs = spark.createDataFrame([], POINTS), spark.createDataFrame([], ZONES)
    assert spatial.near_and_zone(spark, pts, zs).count() == 0


@pytest.mark.parametrize("raw,ok", [("1e3", True), ("﻿{}", False), ("[1,]", False), ('{"a": 1} x', False), ("nul", False)])
def test_reads_one_document(raw, ok):
    assert drift.read_document(raw)[0] is ok
