"""Step functions, clustering, fitting, files and streams against slow or known answers."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import aggregates, clustering, fitting, geometry, models, windows
from pointloom.sources import bags, files
from pointloom.streaming import stateful


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(6))
def test_components_and_clusters(seed):
    rng = np.random.RandomState(seed)
    cells = np.unique(rng.randint(-6, 6, (120, 3)), axis=0)
    a, b = clustering.cell_edges(cells)
    want = {(i, j) for i in range(len(cells)) for j in range(i + 1, len(cells)) if np.abs(cells[i] - cells[j]).max() <= 1}
    assert {tuple(sorted(e)) for e in zip(a.tolist(), b.tolist())} == want
    assert clustering.min_labels(len(cells), a, b).tolist() == components(len(cells), want)
    p = rng.rand(80, 3) * 3
    a, b = clustering.radius_graph(p, 0.5)
    assert {tuple(e) for e in zip(a.tolist(), b.tolist())} == {(i, j) for i in range(80) for j in range(i + 1, 80) if np.linalg.norm(p[i] - p[j]) <= 0.5}
    lab = clustering.dbscan(p, 0.5, 4)
    deg = [(np.linalg.norm(p - q, axis=1) <= 0.5).sum() for q in p]
    assert all((lab[i] >= 0) == (deg[i] >= 4 or any(deg[j] >= 4 and np.linalg.norm(p[i] - p[j]) <= 0.5 for j in range(80))) for i in range(80))


def test_fits_and_assignment():
    rng = np.random.RandomState(0)
    p = rng.rand(300, 3) * [4, 4, 0]
    p[:, 2] = 0.1 * p[:, 0] - 1 + rng.randn(300) * 0.002
    p = np.concatenate([p, rng.rand(60, 3) * 3])
    n, d, inside = fitting.plane_ransac(p, 0.02, 200, 1)
    want = np.array([-0.1, 0, 1]) / math.hypot(0.1, 1)
    assert np.allclose(n, want, atol=0.01) and abs(d - 1 / math.hypot(0.1, 1)) < 0.02 and inside.sum() >= 295
    assert len(fitting.distinct_planes(fitting.peel_planes(p, 0.02, 200, 1), 5, 0.05)) >= 1
    r0 = fitting.rigid_fit(np.eye(3), np.eye(3))[0]
    assert np.allclose(r0, np.eye(3))
    q = rng.rand(100, 3)
    th = 0.05
    rot = np.array([[math.cos(th), -math.sin(th), 0], [math.sin(th), math.cos(th), 0], [0, 0, 1]])
    r, t, err = fitting.icp(q, q @ rot.T + [0.01, 0, 0.01], sample=100, rounds=40)
    assert err < 0.02 and np.allclose(r, rot, atol=0.05)
    import itertools

    for _ in range(20):
        c = rng.rand(3, 4)
        best = min(sum(c[i, j] if j >= 0 else 0.4 for i, j in enumerate(s)) for s in itertools.product(range(-1, 4), repeat=3) if len({j for j in s if j >= 0}) == sum(j >= 0 for j in s))
        got = fitting.assign_optimal(c, 0.4)
        assert abs(sum(c[i, j] if j >= 0 else 0.4 for i, j in enumerate(got)) - best) < 1e-12
        assert sum(j >= 0 for j in fitting.assign_most(c)) == 3 and sum(j >= 0 for j in fitting.assign_greedy(c)) == 3
    assert fitting.match_alarms([(1, 0, 10), (2, 5, 8)], [6, 7, 7.5, 20]) == [(6, 2, "hit"), (7, 1, "hit"), (7.5, 2, "duplicate"), (20, None, "false")]
    assert fitting.largest_gap(np.array([[0, 0, 0], [1, 0, 0], [5, 0, 0.0]])) == 4.0
    assert fitting.merge_constrained(np.array([[0, 0, 0, 1, 1, 1], [1, 0, 0, 1.5, 1, 1], [9, 9, 0, 10, 10, 5.0]]), [5, 5, 5], [(0.1, 0, 1), (0.2, 1, 2)], 2.2, 2.0, 3.0).tolist() == [0, 0, 1]


def test_eigen_closed_form(spark):
    rng = np.random.RandomState(3)
    rows = []
    for _ in range(50):
        m = rng.randn(3, 5)
        c = m @ m.T
        rows.append((c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2], *[float(v) for v in np.linalg.eigvalsh(c)[::-1]]))
    rows.append((1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "xx double, xy double, xz double, yy double, yz double, zz double, a double, b double, c double")
    e = aggregates.eigenvalues(*[F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])
    got = df.select(*[F.abs(v - F.col(k)).alias(k) for v, k in zip(e, "abc")]).agg(*[F.max(k) for k in "abc"]).first()
    assert max(got) < 1e-6
    lo, hi = aggregates.poisson_interval(3)
    assert abs(lo - 0.6187) < 1e-3 and abs(hi - 8.7673) < 1e-3 and aggregates.poisson_interval(0)[0] == 0.0


def test_steps():
    def run(step, rows):
        s, out = None, []
        for r in rows:
            s, v = step(s, *r)
            out.append(v)
        return out

    assert run(stateful.skipped_step, [(3,), (4,), (8,), (8,), (None,)]) == [(0,), (0,), (3,), (0,), (None,)]
    assert [v[0] for v in run(stateful.monotonic_step, [(1, 1.0, "a"), (2, 2.0, "a"), (2, 3.0, "a"), (9, 9.0, "a"), (1, 1.0, "b")])] == ["accepted", "accepted", "dropped", "dropped", "accepted"]
    assert run(stateful.generation_step, [("a",), ("a",), ("b",)]) == [(0, True), (0, False), (1, True)]
    assert [v[0] for v in run(stateful.warmup_step(2), [(0,), (1,), (2,), (9,)])] == ["training", "training", "ready", "ready"]
    assert [v[0] for v in run(stateful.warmup_step(2), [(0,), (2,), (3,)])] == ["training", "disabled", "disabled"]
    assert [v[0] for v in run(stateful.once_step(2), [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 1), ("a", 1)])] == ["apply", "replay", "conflict", "apply", "apply", "apply"]
    assert [v[1] for v in run(stateful.follow_step(0.5, 1.0, 1.0), [(0.0, 1.0), (0.5, 1.2), (1.0, 5.0), (1.5, 5.0), (2.0, 5.0)])] == ["acquire", "stable", "hold", "hold", "recover"]
    assert run(stateful.background_step(0.5, 1.0), [(1.0, False), (1.5, False), (9.0, False), (1.5, True)]) == [(1.0, False), (1.25, False), (1.25, True), (1.25, False)]
    assert run(stateful.motion_gate_step(3, 0.5, 2.0), [(0, 0, 0), (1, 0.1, 0), (2, 0.9, 0)])[-1] == (True,)
    assert run(stateful.KalmanTrack(1.0, 0.1, 4.0, 1), [(0.0, 1.0), (0.1, 1.0), (0.2, 50.0), (0.3, 50.0)])[-1][2] == "restart"
    tr = stateful.Tracks(0.5, 2, 1.0, 0.05)
    assert run(tr, [(0.0, [0.0], [0.0]), (0.1, [0.1], [0.0]), (0.2, [0.2, 5.0], [0.0, 5.0]), (3.0, [], [])]) == [([], 1), ([1], 1), ([1], 2), ([], 0)]
    assert [v[0] for v in run(windows.dwell_step(0.2, {"lying": 1.5}), [(0.0, "up"), (0.2, "up"), (0.3, "lying"), (1.0, "lying"), (1.8, "lying"), (1.9, None)])] == [None, "up", "up", "up", "lying", "lying"]
    assert [v[0] for v in run(windows.jump_ema_step(0.5, 1.0, 2), [(1.0,), (2.0,), (9.0,), (None,), (None,)])] == [1.0, 1.5, 9.0, 9.0, None]
    m = windows.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.8, 0.2], [0.2, 0.8]]))
    obs = [0, 0, 1, 0, 1, 1, 1, -1, 1]
    import itertools

    def weight(path):
        w = 0.5
        for k, (s, o) in enumerate(zip(path, obs)):
            w *= (m.move[path[k - 1], s] if k else 1) * (m.emit[s, o] if o >= 0 else 1)
        return w

    assert tuple(m.viterbi(obs)) == max(itertools.product((0, 1), repeat=len(obs)), key=weight)
    long = m.filter(obs)
    assert all(m.filter(obs[:k]) == long[:k] for k in range(1, len(obs)))  # the future doesn't change the past


def test_fold_rows_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 2 as k", "cast(id as int) as i", "cast(id as double) as v")
        got = windows.fold_rows(df, ["k"], ["i"], ["v"], windows.ema_step(1.0), [("e", "double")]).filter("e <> v").count()
        n = windows.fold_rows(df, ["k"], ["i"], ["i"], stateful.skipped_step, [("s", "bigint")]).agg(F.sum("s")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == 0 and n == 98


def test_index_lists(spark):
    df = spark.createDataFrame([("s", [4, 9]), ("r", [3, 3]), ("m", [1, 2, 7, 1]), ("x", [1]), ("m", [])], "t string, v array<long>")
    assert [r[0] for r in df.select(geometry.index_list(F.col("t"), F.col("v"))).collect()] == [[4, 9], [3, 4, 5], [1, 2, 7], None, []]


def frame(n, k):
    return pd.DataFrame({"x": np.arange(n) + k, "y": 1.0, "z": 2.0, "intensity": 3.0, "ring": np.arange(n) % 5, "ts": 0.5}).astype("float64")


def test_sessions_and_layouts(spark, tmp_path):
    a = frame(4, 0)
    a.loc[1, "x"] = np.nan
    files.write_session(str(tmp_path / "s 1"), "s1", [a, frame(3, 10), frame(0, 0)])
    files.write_session(str(tmp_path / "s2"), "s2", [])
    for n in (1, 512):
        got = files.read_sessions(spark, str(tmp_path), n).orderBy("source_row").toPandas()
        assert got["x"].tolist() == [0, 2, 3, 10, 11, 12] and got["frame_index"].tolist() == [0, 0, 0, 1, 1, 1] and got["session_id"].eq("s1").all()
    with pytest.raises(FileExistsError):
        files.write_session(str(tmp_path / "s 1"), "s1", [])
    with pytest.raises(ValueError):
        files.decode_wire(b"1234", [("a", 0, 7), ("b", 2, 4)], 4)


FIELDS = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 12, 7), ("ring", 16, 4), ("timestamp", 18, 8)]


def cloud_message(rows, seq=3, stamp=(7, 500_000_000), pad=0, fields=FIELDS, tail=b"\x01"):
    import struct

    text = lambda t: struct.pack("<I", len(t)) + t.encode()
    data = b"".join(struct.pack("<ffffHd", *r) for r in rows) + b"\0" * pad
    out = struct.pack("<III", seq, *stamp) + text("lidar") + struct.pack("<II", 1, len(rows)) + struct.pack("<I", len(fields))
    out += b"".join(text(n) + struct.pack("<IBI", o, k, 1) for n, o, k in fields)
    return out + struct.pack("<?III", False, 26, 26 * len(rows) + pad, len(data)) + data + tail


def bag_file(path, chunks, closed=True):
    """A bag of format 2.0: chunks are lists of (connection, topic, type, seconds, data) with a compression each."""
    import bz2
    import struct

    def record(head, data):
        h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v for k, v in head.items())
        return struct.pack("<I", len(h)) + h + struct.pack("<I", len(data)) + data

    def connection(k, topic, typ):
        inner = b"".join(struct.pack("<I", len(n) + 1 + len(v)) + n + b"=" + v for n, v in ((b"topic", topic.encode()), (b"type", typ.encode()), (b"md5sum", b"*"), (b"message_definition", b"")))
        return record({b"op": b"\x07", b"conn": struct.pack("<I", k), b"topic": topic.encode()}, inner)

    body, places, known, base = b"", [], {}, len(b"#ROSBAG V2.0\n") + 4096
    for kind, messages in chunks:
        inner = b""
        for k, topic, typ, t, data in messages:
            if k not in known:
                inner += connection(k, topic, typ)
                known[k] = (topic, typ)
            sec = int(t)
            inner += record({b"op": b"\x02", b"conn": struct.pack("<I", k), b"time": struct.pack("<II", sec, round((t - sec) * 1e9))}, data)
        places.append(base + len(body))
        packed = bz2.compress(inner) if kind == "bz2" else inner
        body += record({b"op": b"\x05", b"compression": kind.encode(), b"size": struct.pack("<I", len(inner))}, packed)
        body += record({b"op": b"\x04", b"ver": struct.pack("<I", 1), b"conn": struct.pack("<I", 0), b"count": struct.pack("<I", 0)}, b"")
    index = base + len(body) if closed else 0
    head = {b"op": b"\x03", b"index_pos": struct.pack("<Q", index), b"conn_count": struct.pack("<I", len(known)), b"chunk_count": struct.pack("<I", len(places))}
    h = record(head, b"")
    h = record(head, b" " * (4096 - len(h)))
    tail = b"".join(connection(k, *v) for k, v in known.items()) + b"".join(record({b"op": b"\x06", b"ver": struct.pack("<I", 1), b"chunk_pos": struct.pack("<Q", p), b"start_time": b"\0" * 8, b"end_time": b"\0" * 8, b"count": struct.pack("<I", 0)}, b"") for p in places)
    path.write_bytes(b"#ROSBAG V2.0\n" + h + body + (tail if closed else b"\x10\0\0\0half"))


@pytest.mark.parametrize("closed", [True, False])
def test_bag_to_session(spark, tmp_path, closed):
    row = lambda k, x=None: (float(k) if x is None else x, 1.0, 2.0, 3.0, k % 7, 0.25)
    pc = "sensor_msgs/PointCloud2"
    clouds = [cloud_message([row(k), row(k + 1), row(k, float("nan"))][: 3 if k else 0], seq=10 + k, pad=4 * (k == 2)) for k in range(5)]
    chunks = [
        ("none", [(0, "/points", pc, 5.5, clouds[2]), (1, "/imu", "sensor_msgs/Imu", 5.1, b"i" * 40), (0, "/points", pc, 5.25, clouds[1])]),
        ("bz2", [(2, "/other", pc, 6.0, cloud_message([row(9)])), (1, "/imu", "sensor_msgs/Imu", 6.1, b"j"), (0, "/points", pc, 6.5, clouds[3])]),
        ("none", [(0, "/points", pc, 4.0, clouds[0]), (0, "/points", pc, 7.0, clouds[4])]),
    ]
    path = tmp_path / "r.bag"
    bag_file(path, chunks, closed)
    spark.dataSource.register(bags.RosBag)
    for n in ("1", "16"):
        m = spark.read.format("rosbag").option("chunks", n).load(str(path))
        assert m.count() == 8 and bags.busiest_topic(m) == "/points"
        f = bags.extract_frames(m, "s1")
        got = f.orderBy("frame_index").toPandas()
        assert got["seq"].tolist() == [10, 11, 12, 13, 14] and got["count_points"].tolist() == [0, 2, 2, 2, 2] and got["dropped_points"].tolist() == [0, 1, 1, 1, 1]
        assert got["offset_points"].tolist() == [0, 0, 2, 4, 6] and got["bag_time_sec"].tolist() == [4.0, 5.25, 5.5, 6.5, 7.0] and got["stamp_nanosec"].eq(500_000_000).all()
        p = bags.frame_points(f).orderBy("source_row").toPandas()
        assert p["source_row"].tolist() == list(range(8)) and p["x"].tolist() == [1, 2, 2, 3, 3, 4, 4, 5] and p["ring"].tolist() == [1, 2, 2, 3, 3, 4, 4, 5] and p["ts"].eq(0.25).all()
    assert bags.extract_frames(m.limit(0), "s1").count() == 0


def test_cloud_messages_are_bounded():
    good = cloud_message([(1.0, 2.0, float("inf"), 4.0, 5, 6.0), (1.0, 2.0, 3.0, 4.0, 5, 6.0)])
    c = bags.parse_cloud(good)
    assert (c.seq, c.sec, c.nanosec, c.frame_id, c.width, c.dense) == (3, 7, 500_000_000, "lidar", 2, True)
    assert len(c.rows()) == 2 and np.isinf(c.rows()["z"][0]) and bags.pack_points(c)[1:] == (1, 1)
    for bad in (good[:-1], good + b"x", good[:40], b"", cloud_message([], stamp=(1, 1_000_000_000)), good[:12] + b"\xff" * 4 + good[16:]):
        with pytest.raises(ValueError):
            bags.parse_cloud(bad)
    with pytest.raises(ValueError):
        bags.pack_points(bags.parse_cloud(cloud_message([(1.0, 2.0, 3.0, 4.0, 5, 6.0)], fields=FIELDS[:3])))
    with pytest.raises(ValueError):
        bags.parse_cloud(cloud_message([(1.0, 2.0, 3.0, 4.0, 5, 6.0)], fields=[("x", 0, 99)]))


def test_archives_documents_and_seals(spark, tmp_path):
    import zipfile

    np.savez(tmp_path / "c.npz", points=np.arange(20.0).reshape(5, 4), frame_offsets=[0, 2, 5], timestamps=[0.1, 0.2])
    got = files.read_archives(spark, str(tmp_path)).orderBy("row").toPandas()
    assert got["frame"].tolist() == [0, 0, 1, 1, 1] and got["x"].tolist() == [0, 4, 8, 12, 16]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(2):
            z.writestr(f"{k:03d}.bin", np.full((2, 3), float(k)).tobytes())
    assert files.read_zipped_bins(spark, str(tmp_path)).count() == 4
    os.mkdir(tmp_path / "doc")
    (tmp_path / "doc" / "a.json").write_text("{}")
    m = spark.createDataFrame([("a.json", files.sha256_file(str(tmp_path / "doc" / "a.json")).upper())], "name string, sha256 string")
    assert files.verified_documents(spark, str(tmp_path / "doc"), m).first()["digest_ok"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.seal(df, str(tmp_path / "sealed"))
    assert sorted(map(tuple, files.unseal(spark, str(tmp_path / "sealed")).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception):
        files.seal(df, str(tmp_path / "sealed"))
    broken = spark.read.parquet(str(tmp_path / "sealed")).withColumn("v", F.lit("x"))
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception):
        files.unseal(spark, str(tmp_path / "broken")).collect()
    (tmp_path / "az.csv").write_text("1, 2\n3,4\n")
    (tmp_path / "el.csv").write_text("5,6\n7,8\n")
    g = files.read_scan_grid(spark, str(tmp_path / "az.csv"), str(tmp_path / "el.csv")).orderBy("ring", "col").collect()
    assert [tuple(r) for r in g] == [(0, 0, 1.0, 5.0), (0, 1, 2.0, 6.0), (1, 0, 3.0, 7.0), (1, 1, 4.0, 8.0)]


def test_forest_and_spark_learner(spark):
    rng = np.random.RandomState(5)
    x = rng.rand(400, 3)
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    m = models.Forest.fit(x, y, 2, 10, 5, 1)
    assert (m.predict(x).argmax(1) == y).mean() > 0.9
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)] + [(None, 0.1, 0.2, 0)], "a double, b double, c double, y int")
    s = models.score(df, ["a", "b", "c"], m, 2)
    assert s.filter("class is null").count() == 1 and s.filter("class = y").count() > 350
    v, rf = models.random_forest(df.dropna(), ["a", "b", "c"], "y")
    assert rf.transform(v.transform(df)).filter("prediction = y").count() > 340


def test_streams_match_their_batch_twins(spark, tmp_path):
    rows = [(f"k{i % 3}", i, float(i % 5), i * 2, i * 2 + i % 4) for i in range(60)]
    schema = "k string, i int, v double, a int, b int"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = drain(stateful.stream_rows(src(), ["k"], ["i"], ["v"], windows.ema_step(0.5), [("e", "double")]), "t_ema")
    twin = windows.fold_rows(spark.createDataFrame(rows, schema), ["k"], ["i"], ["v"], windows.ema_step(0.5), [("e", "double")])
    assert sorted(map(tuple, got.select("i", "e").collect())) == sorted(map(tuple, twin.select("i", "e").collect()))
    from pointloom.operators.intervals import merge_intervals

    pieces = drain(stateful.stream_intervals(src(), ["k"], "a", "b"), "t_int")
    pdf = pieces.toPandas()
    last = pdf[pdf["version"] == pdf.groupby("k")["version"].transform("max")][["k", "piece", "start", "end"]]
    want = merge_intervals(spark.createDataFrame(rows, schema), ["k"], "a", "b").select("k", "piece", "a", "b")
    assert sorted(map(tuple, last.values.tolist())) == sorted(map(tuple, want.collect()))
