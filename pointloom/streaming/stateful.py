"""Keyed state in Structured Streaming, each operator one step function shared with its batch twin.

A step takes the state and one row and gives the new state and the row's values; ``stream_rows`` runs it per key over
micro-batches (rows of a batch in order; what comes late is the step's business), ``windows.fold_rows`` over a table.
State is kept as one pickled column, so any step fits; it must stay small, and every step here is bounded.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap


def stream_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], step: Callable, out: Sequence[tuple[str, str]], idle_ms: int | None = None
) -> DataFrame:
    """The streaming form of fold_rows: append mode, every row comes out with its values. With ``idle_ms`` the state of a key
    without rows for so long (processing time) is dropped, and the key starts over if it comes back."""
    keys, order, names = list(keys), list(order), [n for n, _ in out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {k}" for n, k in out])

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        rows = []
        for values in zip(*[pdf[c].tolist() for c in inputs]):
            held, got = step(held, *[None if v is None or (isinstance(v, float) and v != v) else v for v in values])
            rows.append(got)
        state.update((pickle.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pdf.assign(**{n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def stream_intervals(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """(entity, piece, start, end, version): after each micro-batch the periods and gaps of the entities it touched, from
    an ordered disjoint-interval map in keyed state. The greatest version of an entity is its present state."""
    entity = list(entity)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in entity) + ", piece string, start bigint, end bigint, version bigint"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, version = pickle.loads(state.get[0]) if state.exists else ([], [], 0)
        kept = IntervalMap(starts, ends)
        for pdf in batches:
            for a, b in zip(pdf[start].tolist(), pdf[end].tolist()):
                if a is not None and b is not None and a <= b:
                    kept.insert(int(a), int(b))
        state.update((pickle.dumps((kept.starts, kept.ends, version + 1)),))
        rows = [(*key, p, a, b, version + 1) for p, a, b in kept.pieces()]
        yield pd.DataFrame(rows, columns=[*entity, "piece", "start", "end", "version"])

    return df.groupBy(*entity).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def watchdog(df: DataFrame, keys: Sequence[str], time: str, ttl_ms: int) -> DataFrame:
    """(keys, last_time, status): 'fresh' with every batch, 'unknown' once no row came for ``ttl_ms`` of processing time."""
    keys = list(keys)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", last_time double, status string"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, status = state.get[0], "unknown"
            state.remove()
        else:
            last, status = max(float(b[time].max()) for b in batches), "fresh"
            state.update((last,))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(*key, last, status)], columns=[*keys, "last_time", "status"])

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def distinct_events(df: DataFrame, event_id: str, time: str, lateness: str) -> DataFrame:
    """Each event id once; its state is dropped after ``lateness``."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark([event_id])


def latest_per_batch(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For foreachBatch: only the newest row of each key (load shedding), with how many it replaced."""
    rest = [c for c in batch.columns if c not in keys]
    g = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s"), (F.count("*") - 1).alias("overwritten"))
    return g.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest], "overwritten")


# ---- steps ------------------------------------------------------------------------------------------------------


def skipped_step(state, index):
    """Rows missing before this one."""
    if index is None:
        return state, (None,)
    return max(index, state if state is not None else index), (0 if state is None else max(0, index - state - 1),)


def monotonic_step(state, seq, stamp, binding):
    """accepted, or dropped from the first repeat or step back on until the binding changes (no reordering)."""
    last_seq, last_stamp, bound, broken = state or (None, None, None, False)
    if state is None or binding != bound:
        ok = seq is not None and stamp is not None
        return (seq, stamp, binding, not ok), ("accepted" if ok else "dropped",)
    if broken or seq is None or stamp is None or last_seq is None or seq <= last_seq or stamp <= last_stamp:
        return (last_seq, last_stamp, bound, True), ("dropped",)
    return (seq, stamp, bound, False), ("accepted",)


def generation_step(state, binding):
    """Number of bindings seen before; it grows with each change and tells followers to clear their state."""
    if state is None:
        return (binding, 0), (0, True)
    changed = binding != state[0]
    gen = state[1] + changed
    return (binding, gen), (gen, bool(changed))


def warmup_step(need: int):
    """training for the first ``need`` consecutive indices, then ready; a hole before that disables for good."""

    def step(state, index):
        last, n, mode = state or (None, 0, "training")
        if mode == "training":
            if index is None or (last is not None and index != last + 1):
                mode = "disabled"
            else:
                n += 1
                mode = "ready" if n > need else "training"
        return (index, n, mode), (mode,)

    return step


def background_step(alpha: float, threshold: float):
    """Slow background of a cell: moves by alpha of the residual, only where it isn't frozen and nothing stands before it."""

    def step(state, value, frozen):
        if value is None:
            return state, (state, None)
        if state is None:
            return value, (value, False)
        fore = abs(value - state) > threshold
        new = state if frozen or fore else state + alpha * (value - state)
        return new, (new, fore)

    return step


def freshness_step(tau: float, hot: float, cold: float):
    """Occupancy of a voxel: decays with time, a second hit within tau confirms. HOT, GHOST (seen once) or COLD."""

    def step(state, t):
        if t is None:
            return state, (None, None)
        heat, last, hits = state or (0.0, None, 0)
        dt = 0.0 if last is None else max(0.0, t - last)
        heat = heat * math.exp(-dt / tau) + 1.0
        hits = hits + 1 if last is not None and dt <= tau else 1
        label = "HOT" if hits >= 2 and heat >= hot else "GHOST" if heat >= cold else "COLD"
        return (heat, max(t, last) if last is not None else t, hits), (heat, label)

    return step


class Tracks:
    """Several tracks of one source: nearest candidate within a gate, birth after ``birth`` hits, explicit ambiguity,
    expiry ``lost`` seconds after the last hit, ids never used again. As many tracks are held as were seen within that
    time."""

    def __init__(self, gate: float, birth: int, lost: float, margin: float):
        self.gate, self.birth, self.lost, self.margin = gate, birth, lost, margin

    def __call__(self, state, t, xs, ys):
        tracks, next_id = state or ({}, 1)
        tracks = {i: tr for i, tr in tracks.items() if t - tr[2] <= self.lost}
        cand = [(float(x), float(y)) for x, y in zip(xs or [], ys or [])]
        wish: dict[int, list[tuple[float, int]]] = {}
        for i, (x, y, last, _, vx, vy) in tracks.items():
            px, py = x + vx * (t - last), y + vy * (t - last)
            d = sorted((math.hypot(a - px, b - py), j) for j, (a, b) in enumerate(cand))
            d = [(r, j) for r, j in d if r <= self.gate]
            if d and not (len(d) > 1 and d[1][0] - d[0][0] < self.margin):
                wish.setdefault(d[0][1], []).append((d[0][0], i))
        used, out = set(), []
        for j, who in wish.items():
            used.add(j)
            if len(who) == 1:
                i = who[0][1]
                x, y, last, n, _, _ = tracks[i]
                dt = t - last
                a, b = cand[j]
                tracks[i] = (a, b, t, n + 1, (a - x) / dt if dt > 0 else 0.0, (b - y) / dt if dt > 0 else 0.0)
                if n + 1 >= self.birth:
                    out.append(i)
        for j, (a, b) in enumerate(cand):
            near_any = any(math.hypot(a - tr[0], b - tr[1]) <= self.gate for tr in tracks.values())
            if j not in used and not near_any:
                tracks[next_id] = (a, b, t, 1, 0.0, 0.0)
                next_id += 1
        return (tracks, next_id), (sorted(out), len(tracks))


class KalmanTrack:
    """Constant-velocity filter of one position; a measurement outside ``gate`` deviations coasts, after ``coast``
    misses the track starts anew."""

    def __init__(self, accel: float, noise: float, gate: float, coast: int):
        self.q, self.r, self.gate, self.coast = accel * accel, noise * noise, gate, coast

    def __call__(self, state, t, z):
        if t is None:
            return state, (None, None, "invalid")
        if state is None:
            return (None if z is None else (z, 0.0, self.r, 0.0, 1.0, t, 0)), (z, 0.0 if z is not None else None, "start")
        x, v, a, b, c, last, missed = state
        dt = max(0.0, t - last)
        x += v * dt
        a, b, c = a + dt * (2 * b + dt * c) + self.q * dt**4 / 4, b + dt * c + self.q * dt**3 / 2, c + self.q * dt * dt
        s = a + self.r
        if z is None or (z - x) ** 2 > self.gate**2 * s:
            missed += 1
            if missed > self.coast:
                return (None if z is None else (z, 0.0, self.r, 0.0, 1.0, t, 0)), (z, None, "restart")
            return (x, v, a, b, c, t, missed), (x, v, "coast")
        k0, k1, e = a / s, b / s, z - x
        return (x + k0 * e, v + k1 * e, a * (1 - k0), b * (1 - k0), c - k1 * b, t, 0), (x + k0 * e, v + k1 * e, "update")


def once_step(most: int):
    """Idempotent commands: 'apply' the first time, 'replay' for a known id with the same payload, 'conflict' with
    another; the last ``most`` ids are known."""

    def step(state, request, payload):
        known = dict(state or {})
        if request in known:
            return known, ("replay" if known[request] == payload else "conflict",)
        known[request] = payload
        while len(known) > most:
            known.pop(next(iter(known)))
        return known, ("apply",)

    return step


def follow_step(jump: float, rate: float, hold_s: float):
    """Level that follows estimates: a jump is held back until it lasts ``hold_s``, then adopted; else it moves by at
    most ``rate`` a second. States: acquire, stable, hold, recover."""

    def step(state, t, v):
        if t is None or v is None:
            return state, (state[1] if state else None, "hold" if state else "acquire")
        if state is None:
            return (t, v, None), (v, "acquire")
        last, level, since = state
        dt = max(0.0, t - last)
        if abs(v - level) > jump:
            since = t if since is None else since
            if t - since < hold_s:
                return (t, level, since), (level, "hold")
            return (t, v, None), (v, "recover")
        level += min(max(v - level, -rate * dt), rate * dt)
        return (t, level, None), (level, "stable")

    return step


def motion_gate_step(frames: int, move: float, window_s: float):
    """Persistent movers: acquired once seen in ``frames`` rows and moved ``move`` metres within ``window_s`` seconds."""

    def step(state, t, x, y):
        hist, n, got = state or ([], 0, False)
        if t is None or x is None or y is None:
            return (hist, 0, got), (got,)
        hist = [h for h in hist if t - window_s <= h[0] < t] + [(t, x, y)]
        n += 1
        far = max(math.hypot(x - a, y - b) for _, a, b in hist)
        got = got or (n >= frames and far >= move)
        return (hist, n, got), (got,)

    return step
