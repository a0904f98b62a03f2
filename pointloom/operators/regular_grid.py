"""Irregular readings onto a regular grid: a Kalman smoother with a continuous-time local trend per source.

State: level and trend; d(level) = trend dt + noise, d(trend) = noise. Variances are in units of the source's reading
noise (the pooled variance within slots), so the noise ratios are plain parameters. Readings of one slot enter as one
observation (mean value at mean time, variance 1/n), which a partial aggregate forms before any shuffle.

A source longer than ``CHUNK`` slots is cut: each chunk is folded into one Gaussian filtering element, the few
elements of a source are chained into an exact forward and backward message per chunk, and each chunk is smoothed by
itself between its messages. The result equals one uncut pass, and no task ever holds a whole hot source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import group_starts, stream_groups

#: Slots smoothed by one call.
CHUNK = 4096
SLOT_SEC = 0.5
#: Level and trend noise per second against the reading noise; spread of level and trend before any reading.
LEVEL_NOISE, TREND_NOISE, PRIOR = 0.5, 0.05, (1e6, 1e4)

_MSG = [f"m{i}" for i in range(10)]
_ELEMENT = [f"e{i}" for i in range(14)]


def usable_readings(meta: DataFrame) -> DataFrame:
    """(session_id, frame_index, slot_no, t, y): usable rows of meta_frames, each frame once.

    slot_no = floor((sec * 1e9 + nanosec) / 5e8) in integers; t is seconds from the slot's start.
    """
    ok = meta.filter(
        "stamp_sec is not null and stamp_nanosec >= 0 and stamp_nanosec < 1000000000 and count_points >= 0"
        " and not (stamp_sec = 0 and stamp_nanosec = 0)"
    )
    half = F.col("stamp_nanosec") >= 500_000_000
    return ok.select(
        "session_id",
        "frame_index",
        (F.col("stamp_sec") * 2 + half.cast("bigint")).alias("slot_no"),
        ((F.col("stamp_nanosec") - F.when(half, 500_000_000).otherwise(0)) / 1e9).alias("t"),
        F.col("count_points").cast("double").alias("y"),
    ).distinct()


def _slots(readings: DataFrame) -> DataFrame:
    s = readings.groupBy("session_id", "slot_no").agg(
        F.count("*").alias("n"), F.avg("t").alias("t"), F.avg("y").alias("y"), F.var_pop("y").alias("v")
    )
    return s


def _sources(slots: DataFrame) -> DataFrame:
    """Per source: first and last slot, mean, and the scale (standard deviation) of its reading noise."""
    n = F.sum("n")
    within = F.sum(F.col("n") * F.col("v")) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))
    return slots.groupBy("session_id").agg(
        F.min("slot_no").alias("first"),
        F.max("slot_no").alias("last"),
        (F.sum(F.col("n") * F.col("y")) / n).alias("mean"),
        F.sqrt(F.coalesce(F.nullif(within, F.lit(0.0)), F.nullif(F.var_pop("y"), F.lit(0.0)), F.lit(1.0))).alias("scale"),
    )


def _predict(l, v, a, b, c, dt):
    q0, q1 = LEVEL_NOISE, TREND_NOISE
    return (
        l + v * dt,
        v,
        a + dt * (2 * b + dt * c) + q0 * dt + q1 * dt**3 / 3,
        b + dt * c + q1 * dt * dt / 2,
        c + q1 * dt,
    )


def _combine(e, f):
    """The filtering elements of e followed by f, many at once; an element is (A, b, C, eta, J) with vectors as columns."""
    a1, b1, c1, h1, j1 = e
    a2, b2, c2, h2, j2 = f
    eye = np.eye(2)
    d = np.linalg.inv(eye + c1 @ j2)
    g = np.linalg.inv(eye + j2 @ c1)
    t1, t2 = a1.swapaxes(-1, -2), a2.swapaxes(-1, -2)
    return (a2 @ d @ a1, a2 @ d @ (b1 + c1 @ h2) + b2, a2 @ d @ c1 @ t2 + c2, t1 @ g @ (h2 - j2 @ b1) + h1, t1 @ g @ j2 @ a1 + j1)


def _steps(dt: np.ndarray, y: np.ndarray, r: np.ndarray):
    """Elements of steps of ``dt`` seconds, each with a reading y of variance r at its end (an infinite one: none)."""
    n = len(dt)
    zero, one = np.zeros(n), np.ones(n)
    f = np.stack([np.stack([one, dt], -1), np.stack([zero, one], -1)], -2)
    _, _, a, b, c = _predict(0.0, 0.0, 0.0, 0.0, 0.0, dt)
    q = np.stack([np.stack([a, b], -1), np.stack([b, c], -1)], -2)
    s = a + r
    k = np.stack([a / s, b / s], -1)[..., None]
    h = np.array([[1.0, 0.0]])
    ikh = np.eye(2) - k @ h
    fh = f.swapaxes(-1, -2) @ h.T
    return ikh @ f, k * y[:, None, None], ikh @ q, fh * (y / s)[:, None, None], fh @ fh.swapaxes(-1, -2) / s[:, None, None]


def _fold_chunk(ts, ys, ns, length: float):
    """The element of a chunk that runs from 0 to ``length`` seconds: its steps are combined in pairs, pairs of pairs, ..."""
    at = np.concatenate([[0.0], ts, [length]])
    e = _steps(np.diff(at), np.append(ys, 0.0), np.append(1.0 / np.asarray(ns, "float64"), np.inf))
    while len(e[0]) > 1:
        n = len(e[0]) // 2 * 2
        pairs = _combine([x[0:n:2] for x in e], [x[1:n:2] for x in e])
        e = [np.concatenate([p, x[n:]]) for p, x in zip(pairs, e)]
    a, b, c, h, j = (x[0] for x in e)
    return a, b[:, 0], c, h[:, 0], j


#: Nodes (readings and grid times) that are smoothed side by side.
NODES = 1_000_000


def _smooth_lanes(lane, ts, ys, ns, slots, forward, backward):
    """Smoothed level and its deviation at the centres of all slots of several chunks, lane by lane.

    lane, ts, ys, ns: the readings of all lanes; slots: slots of each lane; forward, backward: a row of messages each. All
    lanes take a step at once, the longest first, so Python's cost is that of the longest lane.
    """
    lanes = len(slots)
    slot_lane = np.repeat(np.arange(lanes), slots)
    slot = np.arange(len(slot_lane)) - np.repeat(np.cumsum(slots) - slots, slots)
    where = np.concatenate([lane, slot_lane])
    t = np.concatenate([ts, (slot + 0.5) * SLOT_SEC])
    kind = np.concatenate([np.zeros(len(lane), "int8"), np.ones(len(slot), "int8")])
    size = np.bincount(where, minlength=lanes)
    rank = np.empty(lanes, "int64")
    longest = np.argsort(-size, kind="stable")
    rank[longest] = np.arange(lanes)
    order = np.lexsort((kind, t, rank[where]))
    size = size[longest]
    col = rank[where][order]
    row = np.arange(len(order)) - (np.cumsum(size) - size)[col]
    depth = int(size[0]) if lanes else 0
    time, seen = np.zeros((depth, lanes)), np.zeros((depth, lanes), bool)
    value, noise, target = np.zeros((depth, lanes)), np.ones((depth, lanes)), np.full((depth, lanes), -1)
    time[row, col], seen[row, col] = t[order], kind[order] == 0
    value[row, col] = np.concatenate([ys, np.zeros(len(slot))])[order]
    noise[row, col] = np.concatenate([1.0 / np.asarray(ns, "float64"), np.ones(len(slot))])[order]
    target[row, col] = np.concatenate([np.full(len(lane), -1), np.arange(len(slot))])[order]
    live = np.searchsorted(-size, -np.arange(depth), "left")
    state, at = forward[longest].T.copy(), np.zeros(lanes)
    before, after = np.zeros((depth, 5, lanes)), np.zeros((depth, 5, lanes))
    for k in range(depth):
        m = live[k]
        l, v, a, b, c = before[k, :, :m] = np.stack(_predict(*state[:, :m], time[k, :m] - at[:m]))
        s = a + noise[k, :m]
        z = np.where(seen[k, :m], value[k, :m] - l, 0.0)
        k0, k1 = np.where(seen[k, :m], a / s, 0.0), np.where(seen[k, :m], b / s, 0.0)
        after[k, :, :m] = state[:, :m] = np.stack([l + k0 * z, v + k1 * z, a * (1 - k0), b * (1 - k0), c - k1 * b])
        at[:m] = time[k, :m]
    length = slots[longest] * SLOT_SEC
    nxt = np.stack(_predict(*state, length - at))
    l, v, a, b, c = nxt
    h0, h1, j00, j01, j11 = backward[longest].T
    # posterior of the end state: precision P^-1 + J, by (I + P J)^-1 P
    m00, m01, m10, m11 = 1 + a * j00 + b * j01, a * j01 + b * j11, b * j00 + c * j01, 1 + b * j01 + c * j11
    det = m00 * m11 - m01 * m10
    u0, u1 = l + a * h0 + b * h1, v + b * h0 + c * h1
    smooth = np.stack([(m11 * u0 - m01 * u1) / det, (m00 * u1 - m10 * u0) / det, (m11 * a - m01 * b) / det, (m11 * b - m01 * c) / det, (m00 * c - m10 * b) / det])
    at = length
    out, dev = np.empty(len(slot)), np.empty(len(slot))
    for k in range(depth - 1, -1, -1):
        m = live[k]
        l, v, a, b, c = after[k, :, :m]
        pl, pv, pa, pb, pc = nxt[:, :m]
        dt = at[:m] - time[k, :m]
        # gain G = P F' (predicted P)^-1
        f0, f1, f2, f3 = a + b * dt, b, b + c * dt, c
        det = pa * pc - pb * pb
        ok = det > 0
        det = np.where(ok, det, 1.0)
        g00, g01 = np.where(ok, (f0 * pc - f1 * pb) / det, 1.0), np.where(ok, (f1 * pa - f0 * pb) / det, 0.0)
        g10, g11 = np.where(ok, (f2 * pc - f3 * pb) / det, 0.0), np.where(ok, (f3 * pa - f2 * pb) / det, 1.0)
        dl, dv, da, db, dc = smooth[:, :m] - nxt[:, :m]
        x00, x01, x10, x11 = g00 * da + g01 * db, g00 * db + g01 * dc, g10 * da + g11 * db, g10 * db + g11 * dc
        smooth[:, :m] = np.stack([l + g00 * dl + g01 * dv, v + g10 * dl + g11 * dv, a + x00 * g00 + x01 * g01, b + x00 * g10 + x01 * g11, c + x10 * g10 + x11 * g11])
        grid = np.flatnonzero(~seen[k, :m])
        out[target[k, grid]], dev[target[k, grid]] = smooth[0, grid], np.sqrt(np.maximum(smooth[2, grid], 0.0))
        nxt[:, :m], at[:m] = before[k, :, :m], time[k, :m]
    return out, dev


_START = (0.0, 0.0, PRIOR[0], 0.0, PRIOR[1])
_NONE = (0.0,) * 5


def _observations(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of the rows that hold readings: row, slot within the chunk, seconds from the chunk's start, scaled value, count."""
    row = np.flatnonzero((pdf["n"] > 0).to_numpy())
    r = pdf.iloc[row]
    at = (r["slot_no"].to_numpy("float64") - r["first"].to_numpy("float64")).astype("int64") - r["chunk"].to_numpy("int64") * CHUNK
    return row, at, at * SLOT_SEC + r["t"].to_numpy("float64"), ((r["y"] - r["mean"]) / r["scale"]).to_numpy("float64"), r["n"].to_numpy("int64")


def _elements(pdf: pd.DataFrame) -> pd.DataFrame:
    cuts, out = group_starts(pdf, ["session_id", "chunk"]), []
    row, _, ts, ys, ns = _observations(pdf)
    at = np.searchsorted(row, cuts)
    for lo, x, y in zip(cuts[:-1], at[:-1], at[1:]):
        a, b, c, h, j = _fold_chunk(ts[x:y], ys[x:y], ns[x:y], CHUNK * SLOT_SEC)
        out.append((pdf["session_id"].iat[lo], int(pdf["chunk"].iat[lo]), *a.ravel(), *b, c[0, 0], c[0, 1], c[1, 1], *h, j[0, 0], j[0, 1], j[1, 1]))
    return pd.DataFrame(out, columns=["session_id", "chunk", *_ELEMENT])


def _messages(pdf: pd.DataFrame) -> pd.DataFrame:
    cuts, out = group_starts(pdf, ["session_id"]), []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        elements = []
        for r in pdf[_ELEMENT].iloc[lo:hi].to_numpy():
            elements.append((r[:4].reshape(2, 2), r[4:6], np.array([[r[6], r[7]], [r[7], r[8]]]), r[9:11], np.array([[r[11], r[12]], [r[12], r[13]]])))
        forward = [_START]
        m, p = np.zeros(2), np.diag(PRIOR)
        for a, b, c, h, j in elements[:-1]:
            d = np.linalg.inv(np.eye(2) + p @ j)
            m, p = a @ d @ (m + p @ h) + b, a @ d @ p @ a.T + c
            forward.append((m[0], m[1], p[0, 0], p[0, 1], p[1, 1]))
        backward = [_NONE]
        h2, j2 = np.zeros(2), np.zeros((2, 2))
        for a, b, c, h, j in reversed(elements[1:]):
            g = np.linalg.inv(np.eye(2) + j2 @ c)
            h2, j2 = a.T @ g @ (h2 - j2 @ b) + h, a.T @ g @ j2 @ a + j
            backward.append((h2[0], h2[1], j2[0, 0], j2[0, 1], j2[1, 1]))
        for k, (f, g) in enumerate(zip(forward, reversed(backward))):
            out.append((pdf["session_id"].iat[lo], int(pdf["chunk"].iat[lo + k]), *f, *g))
    return pd.DataFrame(out, columns=["session_id", "chunk", *_MSG])


def _smoothed(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    cuts = group_starts(pdf, ["session_id", "chunk"])
    head = pdf.iloc[cuts[:-1]]
    start = head["first"].to_numpy("int64") + head["chunk"].to_numpy("int64") * CHUNK
    slots = np.minimum(CHUNK, head["last"].to_numpy("int64") - start + 1)
    # messages stand in one row of a chunk, if its source is longer than one
    lane_of = np.repeat(np.arange(len(start)), np.diff(cuts))
    forward, backward = np.tile(np.array(_START), (len(start), 1)), np.zeros((len(start), 5))
    told = np.flatnonzero(pdf[_MSG[0]].notna().to_numpy())
    known = pdf[_MSG].iloc[told].to_numpy("float64")
    forward[lane_of[told]], backward[lane_of[told]] = known[:, :5], known[:, 5:]
    row, at, ts, ys, ns = _observations(pdf)
    lane = lane_of[row]
    size = slots + np.bincount(lane, minlength=len(slots))
    # side by side as many chunks of like length as fit
    by_size = np.argsort(-size, kind="stable")
    lo = 0
    while lo < len(by_size):
        hi = lo + max(1, NODES // int(size[by_size[lo]]))
        some = by_size[lo:hi]
        lo = hi
        place = np.full(len(slots), -1)
        place[some] = np.arange(len(some))
        mine = place[lane] >= 0
        here = place[lane[mine]]
        value, dev = _smooth_lanes(here, ts[mine], ys[mine], ns[mine], slots[some], forward[some], backward[some])
        n = np.zeros(len(value), "int64")
        n[(np.cumsum(slots[some]) - slots[some])[here] + at[mine]] = ns[mine]
        long = np.repeat(some, slots[some])
        mean, scale = head["mean"].to_numpy("float64")[long], head["scale"].to_numpy("float64")[long]
        first = np.repeat(start[some] - (np.cumsum(slots[some]) - slots[some]), slots[some])
        yield pd.DataFrame({"session_id": head["session_id"].to_numpy()[long], "slot_no": first + np.arange(len(long)), "value": value * scale + mean, "sd": dev * scale, "missing": n == 0, "readings": n})


def regular_grid(meta: DataFrame) -> DataFrame:
    """One row per half second of each session's device clock, from its first to its last slot with a usable reading:
    (session_id, slot_no, value, sd, missing, readings).

    value is the smoothed reading at the slot's centre and sd its standard deviation (wider in holes); missing marks
    slots without a reading. Unusable rows take no part; repeated rows count once; a session without a usable reading
    gives no row; one reading gives one row. Extra columns are ignored.
    """
    slots = _slots(usable_readings(meta))
    src = _sources(slots)
    # On the null-safe key: a null session is a source of its own.
    s = src.withColumnRenamed("session_id", "__sid")
    rows = slots.join(s, slots["session_id"].eqNullSafe(s["__sid"])).select(
        "session_id", "slot_no", "n", "t", "y", "first", "last", "mean", "scale", F.floor((F.col("slot_no") - F.col("first")) / CHUNK).cast("bigint").alias("chunk")
    )
    blank = {"slot_no": "bigint", "n": "bigint", "t": "double", "y": "double"}
    long = src.filter(F.col("last") - F.col("first") >= CHUNK)
    marks = long.select(
        "session_id", *[F.lit(0 if c == "n" else None).cast(k).alias(c) for c, k in blank.items()], "first", "last", "mean", "scale",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - F.col("first")) / CHUNK).cast("bigint"))).alias("chunk"),
    )
    cut = rows.filter(F.col("last") - F.col("first") >= CHUNK).unionByName(marks)
    num = lambda names: ", ".join(f"{c} double" for c in names)
    elements = stream_groups(cut, ["session_id", "chunk"], ["slot_no"], _elements, f"session_id string, chunk bigint, {num(_ELEMENT)}")
    messages = stream_groups(elements, ["session_id"], ["chunk"], _messages, f"session_id string, chunk bigint, {num(_MSG)}")
    m = messages.select(F.col("session_id").alias("__sid"), F.col("chunk").alias("__chunk"), *_MSG)
    marked = marks.join(m, marks["session_id"].eqNullSafe(m["__sid"]) & (marks["chunk"] == m["__chunk"])).drop("__sid", "__chunk")
    allrows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in _MSG]).unionByName(marked)
    return stream_groups(
        allrows, ["session_id", "chunk"], ["slot_no"], _smoothed, "session_id string, slot_no bigint, value double, sd double, missing boolean, readings bigint"
    )
