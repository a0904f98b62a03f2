"""Steps that follow a target: lock, acquisition, stance, episodes, region of interest, anchors, commands.

Each is called as step(state, *inputs) -> (state, values), over a stream or a table (see ``stateful``). State holds what the
rules need and is pruned by time, never by a count that would drop something alive.
"""

from __future__ import annotations

import math

import numpy as np


def _finite(*values) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


class TargetLock:
    """One chosen target among the candidates of each frame.

    Inputs: t, epoch, pick (index of the candidate to lock, or null), xs, ys. Values: status, x, y, predicted, generation.
    locked: measured in this frame; occluded: predicted from the last measurement (never from a prediction); ambiguous: two
    candidates within ``margin`` of each other; lost: no measurement for ``lost`` seconds, a clock that steps back or another
    epoch. Ambiguous and lost hold until the next pick. generation grows whenever history must be forgotten.
    """

    def __init__(self, gate: float, margin: float, speed: float, lost: float, smooth: float = 0.5):
        self.gate, self.margin, self.speed, self.lost, self.smooth = gate, margin, speed, lost, smooth

    def __call__(self, state, t, epoch, pick, xs, ys):
        s = dict(state) if state else {"status": "unselected", "gen": 0, "epoch": epoch, "at": None, "t": None, "v": None}
        cand = [(float(x), float(y)) for x, y in zip(xs if xs is not None else [], ys if ys is not None else []) if _finite(x, y)]
        pick = None if pick is None else int(pick)
        if pick is not None and 0 <= pick < len(cand) and _finite(t):
            s.update(status="locked", at=cand[pick], t=t, v=None, epoch=epoch, gen=s["gen"] + 1)
            return s, ("locked", *s["at"], False, s["gen"])
        if s["status"] not in ("locked", "occluded"):
            return s, (s["status"], None, None, False, s["gen"])
        if epoch != s["epoch"] or not _finite(t) or t < s["t"] or t - s["t"] > self.lost:
            if epoch == s["epoch"] and not _finite(t):  # the frame's time is refused, the last measurement stands
                s["status"] = "occluded"
                return s, ("occluded", *s["at"], True, s["gen"])
            s.update(status="lost", epoch=epoch, gen=s["gen"] + 1)
            return s, ("lost", None, None, True, s["gen"])
        dt = t - s["t"]
        v = s["v"] or (0.0, 0.0)
        px, py = s["at"][0] + v[0] * dt, s["at"][1] + v[1] * dt
        near = sorted((math.hypot(x - px, y - py), k) for k, (x, y) in enumerate(cand))
        near = [n for n in near if n[0] <= self.gate + self.speed * dt]
        if len(near) > 1 and near[1][0] - near[0][0] < self.margin:
            s.update(status="ambiguous", gen=s["gen"] + 1)
            return s, ("ambiguous", px, py, True, s["gen"])
        if not near:
            s["status"] = "occluded"
            return s, ("occluded", px, py, True, s["gen"])
        x, y = cand[near[0][1]]
        if dt > 0:
            w = ((x - s["at"][0]) / dt, (y - s["at"][1]) / dt)
            fast = math.hypot(*w)
            w = tuple(c * self.speed / fast for c in w) if fast > self.speed else w
            s["v"] = w if s["v"] is None else tuple((1 - self.smooth) * a + self.smooth * b for a, b in zip(s["v"], w))
        s.update(status="locked", at=(x, y), t=t)
        return s, ("locked", x, y, False, s["gen"])


class Acquisition:
    """Which of the identified candidates may be locked: seen in ``frames`` frames, of a person's height, and moved by
    ``move`` metres within ``window`` seconds as the medians of its first and last thirds tell (one stray centre is no
    motion). Inputs: t, ids, xs, ys, heights. Values: chosen id or null, reason."""

    def __init__(self, frames: int, low: float, high: float, move: float, window: float):
        self.frames, self.low, self.high, self.move, self.window = frames, low, high, move, window

    def __call__(self, state, t, ids, xs, ys, heights):
        seen = dict(state or {})
        now = {}
        for i, x, y, h in zip(ids if ids is not None else [], xs, ys, heights):
            past, n = seen.get(i, ([], 0))
            past = [p for p in past if t - p[0] <= self.window and p[0] < t]
            now[i] = ([*past, (t, float(x), float(y), None if h is None else float(h))], n + 1)
        # one that is missing now keeps its history while the window holds it
        for i, (past, n) in seen.items():
            if i not in now and past and t - past[-1][0] <= self.window:
                now[i] = (past, n)
        movers, why = [], {}
        for i, (past, n) in now.items():
            if past[-1][0] != t:
                continue
            k = max(1, len(past) // 3)
            (ax, ay), (bx, by) = ([float(np.median([p[c] for p in part])) for c in (1, 2)] for part in (past[:k], past[-k:]))
            heights_ = [p[3] for p in past if p[3] is not None]
            h = float(np.median(heights_)) if heights_ else None
            if n < self.frames:
                why[i] = "too_few_frames"
            elif h is None or not self.low <= h <= self.high:
                why[i] = "height_out_of_range"
            elif len(past) < 5 or math.hypot(bx - ax, by - ay) < self.move:
                why[i] = "no_motion"
            else:
                movers.append(i)
        if len(movers) == 1:
            return now, (movers[0], "height_and_motion")
        return now, (None, "competing_movers" if movers else min(why.values(), default="no_candidate"))


class StanceBaseline:
    """Height of a target that stands still: idle, pending, ready or failed. Inputs: t, track, height, posture. Values: status,
    baseline, reason. It fails when the target changes, the clock steps back, measurements lack for ``gap`` seconds, or
    the heights spread by more than ``spread``; after ``seconds`` of standing it is their median."""

    def __init__(self, seconds: float, gap: float, spread: float, least: int = 5):
        self.seconds, self.gap, self.spread, self.least = seconds, gap, spread, least

    def __call__(self, state, t, track, height, posture):
        s = dict(state) if state else {"status": "idle", "track": None, "rows": [], "base": None}
        if s["status"] == "ready" and track is not None and track != s["track"]:
            s = {"status": "idle", "track": None, "rows": [], "base": None}
        if s["status"] == "ready":
            return s, ("ready", s["base"], None)
        good = _finite(t, height) and track is not None and posture == "standing"
        if s["status"] in ("idle", "failed"):
            if not good:
                return s, (s["status"], None, None)
            s = {"status": "pending", "track": track, "rows": [(t, height)], "base": None}
            return s, ("pending", None, None)
        last = s["rows"][-1][0]
        reason = None
        if track is not None and track != s["track"]:
            reason = "target_changed"
        elif _finite(t) and t < last:
            reason = "clock_regressed"
        elif _finite(t) and t - last > self.gap:
            reason = "measurement_gap"
        elif posture is not None and posture not in ("standing", "unknown"):
            reason = "not_standing"
        if reason is None and good:
            s["rows"] = [*s["rows"], (t, height)]
            h = [r[1] for r in s["rows"]]
            if max(h) - min(h) > self.spread:
                reason = "height_unstable"
            elif t - s["rows"][0][0] >= self.seconds and len(h) >= self.least:
                s.update(status="ready", base=float(np.median(h)), rows=[])
                return s, ("ready", s["base"], None)
        if reason:
            s.update(status="failed", rows=[])
            return s, ("failed", None, reason)
        return s, ("pending", None, None)


class Episode:
    """Falls of one target: upright, descending, low_posture_unclassified, suspected, confirmed, recovering or unknown.

    Inputs: t, track, observable, height, posture, descent_rate, baseline. Values: state, reason, event (number of the event
    given out in this row, or null). A target that is missing for up to ``gap`` seconds keeps the evidence of its descent;
    a longer gap or another target clears it. A sustained low posture is suspected only after a descent, or when lying
    follows standing; it is confirmed, once, only with a baseline, a measured descent and ``confirm`` set.
    """

    def __init__(self, gap: float = 1.5, low: float = 0.45, rate: float = 0.5, suspect: float = 1.5, firm: float = 3.0, recover: float = 1.0, confirm: bool = False):
        self.gap, self.low, self.rate, self.suspect, self.firm, self.recover, self.confirm = gap, low, rate, suspect, firm, recover, confirm

    @staticmethod
    def _fresh(track, events):
        return {"track": track, "seen": None, "descent": False, "stood": False, "low": None, "up": None, "told": False, "events": events}

    def __call__(self, state, t, track, observable, height, posture, rate, baseline):
        s = dict(state) if state else self._fresh(track, 0)
        if not _finite(t):
            return s, ("unknown", "invalid_time", None)
        if s["seen"] is not None and t < s["seen"]:
            s = self._fresh(track, s["events"])
            return s, ("unknown", "clock_regressed", None)
        if track is not None and s["track"] is not None and track != s["track"]:
            s = self._fresh(track, s["events"])
            s["seen"] = t
            return s, ("unknown", "target_changed", None)
        if track is None or not observable or not _finite(height):
            if s["seen"] is not None and t - s["seen"] <= self.gap:
                return s, ("unknown", "target_held_gap", None)
            return self._fresh(None, s["events"]), ("unknown", "no_target", None)
        if s["seen"] is not None and t - s["seen"] > self.gap:
            s = self._fresh(track, s["events"])
        s.update(track=track, seen=t)
        if _finite(rate) and rate >= self.rate:
            s.update(descent=True, up=None)
            if height > self.low:
                s["low"] = None
                return s, ("descending", "measured_descent", None)
        lying, standing = posture == "lying", posture == "standing"
        if standing and height > self.low:
            was = s["descent"] or s["low"] is not None or s["told"]
            s["low"] = None
            if was:
                s["up"] = t if s["up"] is None else s["up"]
                if t - s["up"] < self.recover:
                    return s, ("recovering", "rising", None)
                s.update(descent=False, up=None, told=False, stood=True)
                return s, ("upright", "recovered", None)
            s["stood"] = True
            return s, ("upright", "standing_posture", None)
        s["up"] = None
        if height <= self.low or lying:
            s["low"] = t if s["low"] is None else s["low"]
            lasted = t - s["low"] + 1e-9
            if lying and lasted >= self.suspect and (s["descent"] or s["stood"]):
                if self.confirm and s["descent"] and _finite(baseline) and lasted >= self.firm:
                    if s["told"]:
                        return s, ("confirmed", "sustained", None)
                    s.update(told=True, events=s["events"] + 1)
                    return s, ("confirmed", "event", s["events"])
                return s, ("suspected", "descent" if s["descent"] else "posture_transition_supported", None)
            return s, ("low_posture_unclassified", "low", None)
        s["low"] = None
        if posture == "sitting":
            return s, ("low_posture_unclassified", "sitting", None)
        return s, ("unknown", "not_evaluable", None)


class RegionOfInterest:
    """Where to look next: SEARCH (everywhere), LOCKED (around the last measurement), LOST (a region that grows) and RECOVER
    (measured again, shrinking back). Inputs: t, status of the lock, x, y, extent. Values: state, x, y, radius. The radius
    grows and shrinks by at most ``rate`` metres a second between ``least`` and ``most``; beyond ``forget`` seconds without a
    measurement, or when time doesn't rise, the search starts over."""

    def __init__(self, least: float, most: float, rate: float, brief: float, forget: float):
        self.least, self.most, self.rate, self.brief, self.forget = least, most, rate, brief, forget

    def __call__(self, state, t, status, x, y, extent):
        none = (None, ("SEARCH", None, None, None))
        if not _finite(t) or (state and t <= state["now"]):
            return none
        measured = status == "locked" and _finite(x, y)
        if not state:
            if not measured:
                return none
            r = min(max(self.least, 0.5 * (extent or 0.0) + self.least), self.most)
            s = {"now": t, "t": t, "at": (x, y), "r": r, "lost": False}
            return s, ("LOCKED", x, y, r)
        s = dict(state)
        step = self.rate * (t - s["now"])
        s["now"] = t
        if measured:
            goal = min(max(self.least, 0.5 * (extent or 0.0) + self.least), self.most)
            s["r"] += min(max(goal - s["r"], -step), step)
            s.update(at=(x, y), t=t, lost=s["lost"] and s["r"] > goal + 1e-9)
            return s, ("RECOVER" if s["lost"] else "LOCKED", x, y, s["r"])
        if status in ("unselected", "ambiguous") or t - s["t"] > self.forget:
            return none
        if t - s["t"] > self.brief or status == "lost":
            s["lost"] = True
            s["r"] = min(self.most, s["r"] + step)
            return s, ("LOST", *s["at"], s["r"])
        return s, ("LOCKED", *s["at"], s["r"])


class Anchors:
    """Places where someone was seen, kept alive by new evidence only. Inputs: t, frame, xs, ys, fresh. Values: anchors held, ids
    confirmed in ``need`` frames in a row. A cluster refreshes the nearest anchor within ``radius``, else it makes one; an
    anchor goes after ``seconds`` or ``frames`` without a refresh, whichever comes first."""

    def __init__(self, radius: float, seconds: float, frames: int, need: int):
        self.radius, self.seconds, self.frames, self.need = radius, seconds, frames, need

    def __call__(self, state, t, frame, xs, ys, fresh):
        held, nxt = state or ({}, 1)
        held = {i: a for i, a in held.items() if t - a[2] <= self.seconds and frame - a[3] <= self.frames}
        for x, y, new in zip(xs if xs is not None else [], ys if ys is not None else [], fresh if fresh is not None else []):
            if not new:
                continue
            near = min(((math.hypot(a[0] - x, a[1] - y), i) for i, a in held.items()), default=(math.inf, None))
            if near[0] < self.radius:
                a = held[near[1]]
                held[near[1]] = (x, y, t, frame, a[4] + 1 if a[3] == frame - 1 else a[4] if a[3] == frame else 1)
            else:
                held[nxt] = (x, y, t, frame, 1)
                nxt += 1
        return (held, nxt), (len(held), sorted(i for i, a in held.items() if a[4] >= self.need))


class KalmanPoint:
    """Constant-velocity filter of a point in space (six numbers), gated, coasting over ``coast`` misses. Inputs: t, x, y, z (null
    where nothing was measured). Values: x, y, z, speed, status."""

    def __init__(self, noise: float = 0.05, accel: float = 0.5, gate: float = 0.8, coast: int = 8):
        self.noise, self.accel, self.gate, self.coast = noise, accel, gate, coast

    def __call__(self, state, t, x, y, z):
        seen = np.array([x, y, z], "float64") if _finite(x, y, z) else None
        if not _finite(t):
            return state, (None, None, None, None, "invalid")
        if state is None or state[3] > self.coast:
            if seen is None:
                return None, (None, None, None, None, "none")
            return (np.concatenate([seen, np.zeros(3)]), np.diag([self.noise**2] * 3 + [1.0] * 3), t, 0), (*map(float, seen), 0.0, "start")
        m, p, last, missed = state
        dt = max(t - last, 0.0)
        f = np.eye(6)
        f[:3, 3:] = np.eye(3) * dt
        q = self.accel**2 * np.block([[np.eye(3) * dt**4 / 4, np.eye(3) * dt**3 / 2], [np.eye(3) * dt**3 / 2, np.eye(3) * dt**2]])
        m, p = f @ m, f @ p @ f.T + q
        if seen is None or np.linalg.norm(seen - m[:3]) > self.gate + 1.5 * np.linalg.norm(m[3:]) * dt:
            return (m, p, t, missed + 1), (*map(float, m[:3]), float(np.linalg.norm(m[3:])), "coast" if missed < self.coast else "lost")
        s = p[:3, :3] + np.eye(3) * self.noise**2
        k = p[:, :3] @ np.linalg.inv(s)
        m, p = m + k @ (seen - m[:3]), p - k @ p[:3]
        return (m, p, t, 0), (*map(float, m[:3]), float(np.linalg.norm(m[3:])), "update")


class CommandGate:
    """Commands that may be sent twice: the answer to each, with checks in a fixed order. Inputs: request, payload, receive, action,
    session, schema, epoch, version. Values: answer. A known request is a replay or a conflict whatever else is wrong; answers
    are remembered for ``remember`` seconds."""

    def __init__(self, session: str, schema: int, actions: tuple[str, ...], remember: float):
        self.session, self.schema, self.actions, self.remember = session, schema, actions, remember

    def __call__(self, state, request, payload, receive, action, session, schema, epoch, version):
        s = dict(state) if state else {"known": {}, "last": None, "epoch": epoch, "version": 0}
        known = {r: v for r, v in s["known"].items() if receive is None or receive - v[1] <= self.remember}
        s["known"] = known
        if not request:
            return s, ("missing_field",)
        if request in known:
            return s, ("replay" if known[request][0] == payload else "request_id_conflict",)
        checks = [
            (not _finite(receive), "invalid_receive_time"), (action not in self.actions, "unknown_action"), (session != self.session, "session_mismatch"), (schema != self.schema, "unsupported_schema"),
            (epoch is None, "invalid_epoch"), (epoch != s["epoch"], "epoch_mismatch"), (s["last"] is not None and _finite(receive) and receive < s["last"], "nonmonotonic_receive_time"),
            (version is None or version > s["version"], "invalid_version"), (version is not None and version < s["version"], "stale_version"),
        ]
        for wrong, reason in checks:
            if wrong:
                return s, (reason,)
        s["last"], s["version"] = receive, s["version"] + 1
        known[request] = (payload, receive)
        return s, ("accepted",)
