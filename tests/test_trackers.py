"""Trackers, episodes, models and fits against known answers and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import aggregates, evidence, fitting, ground, models, windows
from pointloom.sources import files
from pointloom.streaming import stateful, trackers


def play(step, rows):
    state, out = None, []
    for r in rows:
        state, got = step(state, *r)
        out.append(got)
    return out


def test_target_lock():
    lock = trackers.TargetLock(0.5, 0.1, 2.0, 1.0)
    seen = play(lock, [(0.0, 1, None, [0.0], [0.0]), (0.1, 1, 0, [0.0, 3.0], [0.0, 0.0]), (0.2, 1, None, [0.1, 3.0], [0.0, 0.0]), (0.3, 1, None, [3.0], [0.0]), (0.4, 1, None, None, None), (0.6, 1, None, [0.5], [0.0])])
    assert [s[0] for s in seen] == ["unselected", "locked", "locked", "occluded", "occluded", "locked"]
    assert seen[3][1] == pytest.approx(0.2) and seen[4][1] == pytest.approx(0.3) and seen[3][3] and not seen[5][3]  # from the last measurement
    head = [(0.0, 1, 0, [0.0], [0.0])]
    assert play(lock, head + [(0.1, 1, None, [0.1, -0.1], [0.0, 0.0]), (0.2, 1, None, [0.0], [0.0])])[1:] == [("ambiguous", 0.0, 0.0, True, 2), ("ambiguous", None, None, False, 2)]
    assert [play(lock, head + [r])[1][0] for r in ((1.5, 1, None, [0.0], [0.0]), (-0.1, 1, None, [0.0], [0.0]), (0.1, 2, None, [0.0], [0.0]), (None, 1, None, [0.0], [0.0]))] == ["lost", "lost", "lost", "occluded"]


def test_acquisition():
    a = trackers.Acquisition(7, 0.8, 2.2, 0.3, 1.2)
    walk = [(k * 0.1, ["a", "b"], [2 + 0.06 * k, 6.0], [0.0, 0.0], [1.7, 1.7]) for k in range(25)]
    assert play(a, walk)[-1] == ("a", "height_and_motion")
    assert play(a, [(k * 0.1, ["a", "b"], [2 + 0.06 * k, 5 + 0.06 * k], [0.0, 0.0], [1.7, 1.7]) for k in range(25)])[-1] == (None, "competing_movers")
    assert all(p[0] is None for p in play(a, [(k * 0.1, ["a"], [2.4 if k == 10 else 2.0], [0.0], [1.7]) for k in range(60)]))
    assert all(p[0] is None for p in play(a, [(k * 0.1, ["a"], [2.0 + 0.01 * (k % 2)], [0.0], [1.7]) for k in range(60)]))
    for h in (0.45, 2.4):
        assert play(a, [(k * 0.1, ["a"], [2 + 0.06 * k], [0.0], [h]) for k in range(40)])[-1] == (None, "height_out_of_range")
    assert play(a, [(0.0, None, [], [], [])])[-1] == (None, "no_candidate")


def body(t, track="t", seen=True, h=1.5, posture="standing", rate=None, base=None):
    return (t, track, seen, h, posture, rate, base)


STAND = [body(k * 0.1) for k in range(4)]
FALL = body(0.4, h=0.9, posture="sitting", rate=0.6)


def lying(*times, **kw):
    return [body(t, h=0.25, posture="lying", **kw) for t in times]


def test_episodes():
    gone = lambda t: body(t, None, False, None, "unknown")
    got = play(trackers.Episode(), STAND + [FALL] + [gone(t) for t in (0.5, 0.6, 0.7)] + lying(0.8, 1.0, 1.4, 2.2, 2.4))
    assert got[4][0] == "descending" and all(g[:2] == ("unknown", "target_held_gap") for g in got[5:8]) and got[-1][:2] == ("suspected", "descent")
    got = play(trackers.Episode(), STAND + [FALL, gone(3.0)] + lying(3.1, 3.4, 3.9, 4.9, 5.1))
    assert got[5][1] == "no_target" and got[-1][0] == "low_posture_unclassified"
    got = play(trackers.Episode(), STAND + [FALL, body(0.5, "u", h=0.4)] + lying(0.6, 2.6, track="u"))
    assert got[5][1] == "target_changed" and got[-1][0] == "low_posture_unclassified"
    got = play(trackers.Episode(), STAND + lying(1.0, 1.5, 2.0, 2.6, 2.7))
    assert got[-1][:2] == ("suspected", "posture_transition_supported")
    assert all(g[0] != "suspected" for g in play(trackers.Episode(), STAND + [body(t, h=0.6, posture="sitting") for t in (1.0, 1.6, 2.2, 2.8)]))
    got = play(trackers.Episode(), STAND + [FALL] + [body(0.6 + k * 0.1) for k in range(15)])
    assert got[-1][0] == "upright" and "recovered" in [g[1] for g in got] and "recovering" in [g[0] for g in got]
    sure = trackers.Episode(confirm=True)
    assert all(g[2] is None and g[0] != "confirmed" for g in play(sure, STAND + lying(0.4, 1.4, 2.4, 3.4, 4.4, base=1.5)))
    got = play(sure, STAND + [FALL] + lying(0.5, 1.4, 2.4, 3.4, 4.4, 5.0, base=1.5))
    assert [g[2] for g in got if g[2] is not None] == [1] and got[-1][0] == "confirmed"
    assert play(trackers.Episode(), [body(1.0), body(0.5)])[1][1] == "clock_regressed"


def test_stance_and_region_and_anchors():
    base = trackers.StanceBaseline(1.0, 0.4, 0.2)
    assert play(base, [(k * 0.1, "a", 1.5 + 0.01 * (k % 3), "standing") for k in range(12)])[-1][:2] == ("ready", 1.51)
    bad = {"target_changed": (0.3, "b", 1.5, "standing"), "clock_regressed": (0.1, "a", 1.5, "standing"), "measurement_gap": (2.0, "a", 1.5, "standing"), "not_standing": (0.3, "a", 0.4, "lying"), "height_unstable": (0.3, "a", 1.9, "standing")}
    for reason, row in bad.items():
        assert play(base, [(0.1 + 0.1 * k, "a", 1.5, "standing") for k in range(2)] + [row])[-1] == ("failed", None, reason)
    roi = trackers.RegionOfInterest(0.5, 3.0, 1.0, 0.3, 2.0)
    got = play(roi, [(0.0, "unselected", None, None, None), (0.1, "locked", 1.0, 2.0, 0.0), (0.2, "occluded", None, None, None), (0.9, "occluded", None, None, None), (1.0, "locked", 1.1, 2.0, 0.0), (2.5, "locked", 1.1, 2.0, 0.0), (5.0, "occluded", None, None, None)])
    assert [g[0] for g in got] == ["SEARCH", "LOCKED", "LOCKED", "LOST", "RECOVER", "LOCKED", "SEARCH"] and got[3][3] == pytest.approx(1.2) and got[4][3] == pytest.approx(1.1)
    assert play(roi, [(0.1, "locked", 1.0, 2.0, 0.0), (0.1, "locked", 1.0, 2.0, 0.0)])[1][0] == "SEARCH"
    held = play(trackers.Anchors(0.5, 2.0, 5, 2), [(0.0, 0, [0.0], [0.0], [True]), (0.1, 1, [0.1, 4.0], [0.0, 0.0], [True, False]), (0.2, 2, [0.1], [0.0], [False]), (0.4, 4, [0.1], [0.0], [True]), (0.9, 9, [3.0], [0.0], [True]), (1.0, 10, [], [], [])])
    assert [h[0] for h in held] == [1, 1, 1, 1, 2, 1] and held[1][1] == [1] and held[3][1] == []


def test_kalman_point_and_commands():
    got = play(trackers.KalmanPoint(), [(k * 0.1, 0.1 * k, 0.0, 1.0) if k % 7 else (k * 0.1, None, None, None) for k in range(1, 60)])
    assert got[-1][4] == "update" and got[-1][0] == pytest.approx(5.9, abs=0.05) and got[-1][3] == pytest.approx(1.0, abs=0.1) and {g[4] for g in got} == {"start", "update", "coast"}
    assert [g[4] for g in play(trackers.KalmanPoint(coast=1), [(0.0, 0.0, 0.0, 0.0), (0.1, 9.0, 0.0, 0.0), (0.2, 9.0, 0.0, 0.0), (0.3, 9.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0)])] == ["start", "coast", "lost", "start", "invalid"]
    gate = trackers.CommandGate("s", 1, ("select",), 100.0)
    row = lambda r, p="p", t=1.0, a="select", s="s", k=1, e=0, v=0: (r, p, t, a, s, k, e, v)
    rows = [row("a"), row("a"), row("a", "q"), row(None), row("b", t=None), row("b", a="x"), row("b", s="z"), row("b", k=2), row("b", e=None), row("b", e=4), row("b", t=0.5, v=1), row("b", v=0), row("b", v=5), row("b", v=1), row("a", t=500.0, v=2)]
    want = ["accepted", "replay", "request_id_conflict", "missing_field", "invalid_receive_time", "unknown_action", "session_mismatch", "unsupported_schema", "invalid_epoch", "epoch_mismatch", "nonmonotonic_receive_time", "stale_version", "invalid_version", "accepted", "accepted"]
    assert [g[0] for g in play(gate, rows)] == want


def test_semi_markov():
    m = windows.SemiMarkov(np.array([0.5, 0.5]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([2.0, 1.0]), np.array([1.0, 1.0]), 30.0, 0.01)
    p = play(m, [(t, [1.0, 1.0]) for t in np.linspace(0, 20, 81)])
    assert p[-1][0][0] == pytest.approx(2 / 3, abs=0.02)  # exponential stays: shares are as their lengths
    stay = windows.SemiMarkov(np.array([1.0, 0.0]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([5.0, 5.0]), np.array([4.0, 4.0]), 10.0, 0.01)
    p = play(stay, [(t, [1.0, 1.0]) for t in (0.0, 2.0, 5.0, 7.0)])
    assert [g[0][0] > 0.5 for g in p] == [True, True, False, False] and p[2][0][0] == pytest.approx(math.exp(-1), abs=0.02)
    assert play(m, [(0.0, [1.0, 0.0]), (0.0, [0.0, 1.0]), (None, None)])[-1][0].sum() == pytest.approx(1)


def test_models(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(400, 2)
    y = (rng.rand(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).unionByName(spark.createDataFrame([(None, 1.0, 1), (float("nan"), 1.0, 0)], "a double, b double, y long"))
    b = models.logistic(df, ["a", "b"], "y")
    g = np.column_stack([np.ones(400), x])
    assert np.abs(g.T @ (y - 1 / (1 + np.exp(-g @ b)))).max() < 1e-3 and np.allclose(b, [0.5, 1.0, -2.0], atol=0.5)
    assert np.allclose(models.logistic(df.limit(0), ["a", "b"], "y"), 0)
    net = models.Layers(np.zeros(2), np.ones(2), [np.array([[1.0, -1.0]]), np.array([[2.0]])], [np.array([0.0]), np.array([-1.0])])
    assert np.allclose(net.predict(np.array([[3.0, 1.0], [0.0, 5.0]]))[:, 1], 1 / (1 + np.exp([-3.0, 1.0])))
    with pytest.raises(ValueError):
        models.Layers(np.zeros(2), np.ones(2), [np.ones((1, 2)), np.ones((1, 3))], [np.ones(1), np.ones(1)])
    w, u, c = rng.randn(6, 3), rng.randn(6, 2), rng.randn(6)
    gru, seq = models.Gru(w, u, c, np.eye(2), np.zeros(2)), rng.randn(4, 5, 3)
    for s, got in zip(seq, gru.predict(seq)):
        h = np.zeros(2)
        for v in s:
            z, r = (1 / (1 + np.exp(-(w[k] @ v + c[k] + u[k] @ h))) for k in (slice(0, 2), slice(2, 4)))
            h = z * h + (1 - z) * np.tanh(w[4:] @ v + c[4:] + r * (u[4:] @ h))
        assert np.allclose(got, np.exp(h) / np.exp(h).sum())


def test_poisson_interval():
    for k, low, high in ((0, 0.0, 3.6889), (1, 0.0253, 5.5716), (5, 1.6235, 11.6683), (20, 12.2165, 30.8884)):
        a, b = aggregates.poisson_interval(k)
        assert a == pytest.approx(low, abs=2e-4) and b == pytest.approx(high, abs=2e-4)


def test_fits_on_measured_points():
    rng = np.random.RandomState(3)
    a = np.concatenate([rng.rand(60, 3) + c for c in ([0, 0, 0], [1.4, 0, 0], [5, 0, 0])])
    parts = [a[:60], a[60:120], a[120:]]
    g = [[min(np.linalg.norm(p - q) for p in x for q in y) for y in parts] for x in parts]
    assert fitting.measured_gap(parts[0], parts[2]) == pytest.approx(g[0][2])
    largest, label = fitting.gap_graph(parts, 1.0)
    assert largest == pytest.approx(g[1][2]) and label == [0, 0, 2]
    lab = np.repeat([0, 1, 2], 60)
    links = [(g[0][1], 0, 1), (g[1][2], 1, 2)]
    up = np.array([0.0, 0.0, 1.0, 0.0])
    assert fitting.merge_measured(a, lab, links, up, max_span=4.0).tolist() == [0, 0, 2]
    assert fitting.merge_measured(a, lab, links, up, max_span=1.0).tolist() == [0, 1, 2] and fitting.merge_measured(a, lab, links, up, max_span=9.0, growth=1.5).tolist() == [0, 1, 2]
    assert fitting.merge_measured(a, lab, links, np.array([0.0, 0.0, 1.0, 2.0]), max_span=9.0).tolist() == [0, 1, 2]
    assert fitting.spread_blocks([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")]) == {1, 2, 3} and fitting.spread_blocks([]) == set()
    p = rng.rand(9, 2)
    apart = lambda c: min(np.linalg.norm(p[i] - p[j]) for i, j in itertools.combinations(c, 2))
    four, d = fitting.spread_four(p)
    assert d == pytest.approx(max(apart(c) for c in itertools.combinations(range(9), 4))) and len(fitting.spread_four(rng.rand(80, 2))[0]) == 4
    assert fitting.match_alarms_scored([(0, 1.0, 3.0)], [2.0, 2.5, 5.0, 9.0], [(4.0, 6.0)]) == [(2.0, 0, "hit"), (2.5, 0, "duplicate"), (5.0, None, "false"), (9.0, None, "unscored")]


def test_registration_and_plane_search():
    rng = np.random.RandomState(4)
    n = 1500
    wall = np.concatenate([np.column_stack([rng.rand(n) * 3, rng.rand(n) * 3, np.zeros(n)]), np.column_stack([np.zeros(n), rng.rand(n) * 3, rng.rand(n) * 2]), np.column_stack([rng.rand(n) * 3, np.zeros(n), rng.rand(n) * 2])])
    th = 0.03
    turn = np.array([[math.cos(th), -math.sin(th), 0], [math.sin(th), math.cos(th), 0], [0, 0, 1]])
    moved = (wall[::3] - [0.04, -0.03, 0.02]) @ turn
    r, t, rms = fitting.icp_to_planes(moved, wall, 0.2)
    assert np.abs(moved @ r.T + t - wall[::3]).max() < 0.01 and rms < 0.005
    i, j = fitting.nearest_by_cells(moved[:50], wall, 0.3)
    d = np.linalg.norm(moved[:50, None] - wall[None], axis=2)
    assert i.tolist() == np.flatnonzero(d.min(1) <= 0.3).tolist() and np.allclose(d[i, j], d.min(1)[i])
    cloud = np.concatenate([np.column_stack([rng.rand(900, 2) * 4 - 2, -2 + rng.randn(900) * 0.01]), np.column_stack([rng.rand(300, 2) * 4 - 2, np.full(300, -1.0)]), rng.rand(400, 3) * [2, 2, 2] - [1, 1, 1.9]])
    (m, off), count = fitting.declared_plane_search(cloud, rounds=400)
    assert abs(m[2]) > 0.999 and off == pytest.approx(2.0, abs=0.02) and sum(count.values()) == 400 and count["kept"] >= 1
    assert fitting.declared_plane_search(cloud[:2])[0] is None


def test_distances_scores_and_samples(spark):
    rng = np.random.RandomState(5)
    a, b = rng.rand(40, 3), rng.rand(30, 3) + [4, 0, 0]
    frame = lambda p, k: spark.createDataFrame([(k, *map(float, v)) for v in p], "k string, x double, y double, z double")
    got = evidence.exact_set_distance(frame(a, "s").unionByName(frame(a, "t")), frame(b, "s").unionByName(frame(a[:1], "t")), ["k"]).collect()
    want = {"s": min(np.linalg.norm(p - q) for p in a for q in b), "t": 0.0}
    assert {r["k"] for r in got} == {"s", "t"} and all(r["gap"] == pytest.approx(want[r["k"]]) for r in got)
    bad = spark.createDataFrame([("s", 1.0), ("s", float("inf"))], "k string, v double")
    with pytest.raises(Exception, match="not finite"):
        evidence.distribution(bad, ["k"], "v").collect()
    assert evidence.distribution(bad.filter("v < 9").unionByName(spark.createDataFrame([("s", None)], "k string, v double")), ["k"], "v").first()["samples"] == 1
    rows = spark.createDataFrame([(k, "a" if k < 7 else "b" if k < 9 else None) for k in range(10)], "id long, label string")
    n = {(r["label"], r["c"]) for r in evidence.oversample(rows, "label", "id").groupBy("label").agg(F.count("*").alias("c")).collect()}
    assert n == {("a", 7), ("b", 7)} and evidence.oversample(rows.limit(0), "label", "id").count() == 0


def test_streams_of_freshness_and_distinct_events(spark, tmp_path):
    import time

    rows = [("a", 1, "2026-01-01T00:00:00", 1.0), ("a", 2, "2026-01-01T00:00:01", 2.0), ("b", 2, "2026-01-01T00:00:02", 3.0), ("a", 1, "2026-01-01T00:00:03", 4.0)]
    df = spark.createDataFrame(rows, "k string, event int, ts string, t double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.distinct_events(source(), "event", "ts", "1 hour").writeStream.format("memory").queryName("distinct_events_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["event"] for r in spark.table("distinct_events_out").collect()) == [1, 2]
    q = stateful.watchdog(source(), ["k"], "t", 300).writeStream.format("memory").queryName("watchdog_out").outputMode("append").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and spark.table("watchdog_out").filter("status = 'unknown'").count() < 2:
        time.sleep(0.5)
    q.stop()
    got = {tuple(r) for r in spark.table("watchdog_out").collect()}
    assert got == {("a", 4.0, "fresh"), ("b", 3.0, "fresh"), ("a", 4.0, "unknown"), ("b", 3.0, "unknown")}


def test_site_fit():
    rng = np.random.RandomState(6)
    n = 40
    frame = np.repeat(np.arange(30), n)
    p = np.column_stack([rng.rand(30 * n, 2) * 4 - 2, -2.4 + rng.randn(30 * n) * 0.01])
    body = np.column_stack([rng.rand(300, 2), rng.rand(300) * 1.5 - 2.2])
    f, q = np.concatenate([frame, rng.randint(0, 30, 300)]), np.concatenate([p, body])
    got = ground.fit_site(f, q)
    assert got.status == "fitted" and got.offset == pytest.approx(2.4, abs=0.02) and got.normal[2] > 0.999 and got.rms < 0.05
    assert ground.fit_site(f, q, validator=lambda n, d: d < 1).reason == "rejected"
    assert ground.fit_site(np.where(f >= 20, f + 5, f), q).reason == "no_contiguous_frames" and ground.fit_site(f[:0], q[:0]).reason == "no_contiguous_frames"
    assert ground.fit_site(f, q, ground.SiteSettings(least_points=10**6)).reason == "few_points"
    held = q.copy()
    held[np.isin(f, [25, 26, 27])] += [0, 0, 0.25]
    assert ground.fit_site(f, held).reason == "held_out"
    for bad in ({"no_such": 1}, {"rms_m": "x"}, {"rms_m": float("nan")}, {"fit_frames": 2.5}, {"mode": "strict"}):
        with pytest.raises(ValueError):
            ground.SiteSettings.resolve(**bad)
    with pytest.raises(ValueError):
        ground.register_estimator("tls", fitting.plane_svd)


def test_rotation_pairs_and_verified_planes(spark, tmp_path):
    import json
    import os

    rows = spark.createDataFrame([(k,) for k in range(10)], "k long").coalesce(1)
    for _ in range(3):
        files.append_records(rows, str(tmp_path / "log"), 2, keep_files=6)
    assert len([f for f in os.listdir(tmp_path / "log") if f.startswith("part-")]) == 6
    for name in "abc":
        files.save_pair(str(tmp_path / "fits" / name), {"name": name, "rms": 0.1}, {"d": 2.4})
    with pytest.raises(FileExistsError):
        files.save_pair(str(tmp_path / "fits" / "a"), {}, {})
    digest = {n: files.sha256_file(str(tmp_path / "fits" / n / "report.json")) for n in "abc"}
    (tmp_path / "fits" / "b" / "report.json").write_text("{}")
    seal = tmp_path / "fits" / "c" / "plane.json"
    seal.write_text(json.dumps(json.loads(seal.read_text()) | {"report_sha256": "0"}))
    files.save_pair(str(tmp_path / "fits" / "d"), {"x": 1}, {"d": 1.0})
    got = {r["name"]: (r["outcome"], r["plane"]) for r in files.verified_planes(spark, str(tmp_path / "fits"), spark.createDataFrame(list(digest.items()), "name string, report_sha256 string")).collect()}
    assert got == {"a": ("verified", '{"d":2.4}'), "b": ("report_changed", None), "c": ("seal_differs", None), "d": ("not_declared", None)}
