"""Planes, boxes, registration and assignment for one key's points: NumPy inside grouped maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..core import group_starts, stream_groups


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """One call of fn per key on its ordered rows, many keys to a task; fn gives tuples that follow the keys."""
    keys = list(keys)
    kinds = dict(df.dtypes)
    names = [*keys, *[c.split()[0] for c in schema.split(", ")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts, rows = group_starts(pdf, keys), []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            head = tuple(pdf[k].iat[lo] for k in keys)
            rows += [head + tuple(r) for r in fn(pdf.iloc[lo:hi])]
        return pd.DataFrame(rows, columns=names)

    return stream_groups(df, keys, order, run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def plane_tls(p: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Unit normal (upward), offset and degeneracy ratio l_mid / l_max of the weighted least-squares plane."""
    w = np.ones(len(p)) if w is None else w
    c = (p * w[:, None]).sum(0) / w.sum()
    q = (p - c) * np.sqrt(w)[:, None]
    val, vec = np.linalg.eigh(q.T @ q)
    n = vec[:, 0] * (1 if vec[2, 0] >= 0 else -1)
    return n, float(-n @ c), float(val[1] / val[2]) if val[2] > 0 else 0.0


def plane_svd(p: np.ndarray) -> tuple[np.ndarray, float]:
    c = p.mean(0)
    n = np.linalg.svd(p - c, full_matrices=False)[2][2]
    n = n if n[2] >= 0 else -n
    return n, float(-n @ c)


def plane_ransac(p: np.ndarray, tol: float, rounds: int, seed: int) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Plane with most points within ``tol`` over seeded triples (ties: the smaller median residual), refined on its
    inliers; None below three points or without a plane."""
    if len(p) < 3:
        return None
    rng = np.random.RandomState(seed)
    best = None
    for _ in range(rounds):
        a, b, c = p[rng.randint(0, len(p), 3)]
        n = np.cross(b - a, c - a)
        size = np.linalg.norm(n)
        if size < 1e-9:
            continue
        n = n / size
        r = np.abs((p - a) @ n)
        score = (int((r <= tol).sum()), -float(np.median(r)))
        if best is None or score > best[0]:
            best = (score, r <= tol)
    if best is None or best[1].sum() < 3:
        return None
    n, d, _ = plane_tls(p[best[1]])
    return n, d, np.abs(p @ n + d) <= tol


def peel_planes(p: np.ndarray, tol: float, rounds: int, seed: int, most: int = 6, least: int = 10) -> list[tuple[np.ndarray, float, int]]:
    """Planes one after another, each from what the former left."""
    out = []
    while len(out) < most and len(p) >= least:
        got = plane_ransac(p, tol, rounds, seed + len(out))
        if got is None or got[2].sum() < least:
            break
        out.append((got[0], got[1], int(got[2].sum())))
        p = p[~got[2]]
    return out


def distinct_planes(planes: list[tuple[np.ndarray, float, int]], angle_deg: float, gap: float) -> list[tuple[np.ndarray, float, int]]:
    """Greedy by support: a plane near an accepted one in angle and offset is dropped."""
    kept: list[tuple[np.ndarray, float, int]] = []
    for n, d, s in sorted(planes, key=lambda x: (-x[2], x[1])):
        if all(abs(n @ m) < np.cos(np.radians(angle_deg)) or abs(d - e) > gap for m, e, _ in kept):
            kept.append((n, d, s))
    return kept


def oriented_box(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, axes (rows, largest spread first, sign fixed by their greatest part) and half sizes."""
    c = p.mean(0)
    _, vec = np.linalg.eigh(np.cov((p - c).T, bias=True)) if len(p) > 1 else (None, np.eye(3))
    axes = vec.T[::-1].copy()
    for k in range(3):
        axes[k] *= 1 if axes[k][np.abs(axes[k]).argmax()] >= 0 else -1
    q = (p - c) @ axes.T
    lo, hi = q.min(0), q.max(0)
    return c + ((lo + hi) / 2) @ axes, axes, (hi - lo) / 2


def rigid_fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t that take a onto b in least squares."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    s = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ s @ u.T
    return r, cb - r @ ca


def icp(a: np.ndarray, b: np.ndarray, rounds: int = 12, sample: int = 192, trim: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Point-to-point registration of an even sample of a onto b; the farthest 1 - trim of pairs is left out."""
    a = a[np.linspace(0, len(a) - 1, min(sample, len(a))).round().astype(int)]
    r, t, err = np.eye(3), np.zeros(3), float("inf")
    for _ in range(rounds):
        q = a @ r.T + t
        best, near = np.full(len(q), np.inf), np.zeros(len(q), int)
        for lo in range(0, len(b), 16384):  # a block of b at a time
            d = ((q[:, None] - b[None, lo : lo + 16384]) ** 2).sum(2)
            k = d.argmin(1)
            new_best = d[np.arange(len(q)), k]
            better = new_best < best
            best[better], near[better] = new_best[better], k[better] + lo
        keep = best <= np.quantile(best, trim)
        r, t = rigid_fit(a[keep], b[near[keep]])
        new = float(np.sqrt(best[keep].mean()))
        if abs(err - new) < 1e-9:
            break
        err = new
    return r, t, err


def largest_gap(p: np.ndarray) -> float:
    """Longest edge of the least spanning tree over a few fragments' centres."""
    n = len(p)
    if n < 2:
        return 0.0
    dist = np.full(n, np.inf)
    dist[0], used, longest = 0.0, np.zeros(n, bool), 0.0
    for _ in range(n):
        i = int(np.where(used, np.inf, dist).argmin())
        used[i] = True
        longest = max(longest, float(dist[i]))
        dist = np.minimum(dist, np.sqrt(((p - p[i]) ** 2).sum(1)))
    return longest


def merge_constrained(boxes: np.ndarray, sizes: Sequence[int], links: Sequence[tuple[float, int, int]], max_height: float, max_span: float, growth: float) -> np.ndarray:
    """Component merge in order of (distance, pair): accepted if the union keeps within height and span and isn't over
    ``growth`` times its larger part. boxes: rows (min xyz, max xyz)."""
    n = len(boxes)
    label, box, size = list(range(n)), [b.copy() for b in boxes], list(sizes)
    for _, i, j in sorted(links):
        a, b = label[i], label[j]
        if a == b:
            continue
        lo, hi = np.minimum(box[a][:3], box[b][:3]), np.maximum(box[a][3:], box[b][3:])
        if hi[2] - lo[2] <= max_height and max(hi[:2] - lo[:2]) <= max_span and size[a] + size[b] <= growth * max(size[a], size[b]):
            a, b = min(a, b), max(a, b)
            box[a], size[a] = np.concatenate([lo, hi]), size[a] + size[b]
            label = [a if x == b else x for x in label]
    return np.unique(label, return_inverse=True)[1]


def spread_subset(p: np.ndarray, k: int) -> list[int]:
    """k rows far from one another: all subsets while few, else greedy farthest points."""
    import itertools

    if len(p) <= k:
        return list(range(len(p)))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    if len(p) <= 24:
        return list(max(itertools.combinations(range(len(p)), k), key=lambda s: (min(d[i, j] for i in s for j in s if i < j), [-i for i in s])))
    got = [int(d.sum(1).argmax())]
    while len(got) < k:
        got.append(int(d[:, got].min(1).argmax()))
    return sorted(got)


def assign_optimal(cost: np.ndarray, miss: float) -> list[int]:
    """Column of each row (-1: none) at least total cost; a row left out costs ``miss``. Exact at any size: shortest
    augmenting paths with row and column prices, each row with a column of its own for staying out."""
    n, m = cost.shape
    if not n:
        return []
    far = float(np.abs(cost[np.isfinite(cost)]).sum() + abs(miss)) * (n + 1) + 1.0
    c = np.full((n, m + n), far)
    c[:, :m] = np.where(np.isfinite(cost), cost, far)
    c[np.arange(n), m + np.arange(n)] = miss
    row_price, col_price = np.zeros(n), np.zeros(m + n)
    owner = np.full(m + n, -1)
    for i in range(n):
        dist = c[i] - row_price[i] - col_price
        came, done = np.full(m + n, -1), np.zeros(m + n, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if owner[j] < 0:
                break
            k = owner[j]
            step = dist[j] + c[k] - row_price[k] - col_price
            better = ~done & (step < dist)
            dist[better], came[better] = step[better], j
        used = np.flatnonzero(done & (np.arange(m + n) != j))
        row_price[i] += dist[j]
        row_price[owner[used]] += dist[j] - dist[used]
        col_price[used] -= dist[j] - dist[used]
        while came[j] >= 0:
            owner[j] = owner[came[j]]
            j = came[j]
        owner[j] = i
    out = [-1] * n
    for j in range(m):
        if owner[j] >= 0 and np.isfinite(cost[owner[j], j]):
            out[owner[j]] = j
    return out


def assign_greedy(cost: np.ndarray) -> list[int]:
    """Cheapest pair first, each side once; ties by row, then column."""
    out, used = [-1] * len(cost), set()
    for _, i, j in sorted((float(cost[i, j]), i, j) for i in range(cost.shape[0]) for j in range(cost.shape[1]) if np.isfinite(cost[i, j])):
        if out[i] < 0 and j not in used:
            out[i] = j
            used.add(j)
    return out


def assign_most(cost: np.ndarray) -> list[int]:
    """As many pairs as can be, then the least total distance."""
    big = float(cost[np.isfinite(cost)].sum()) + 1 if np.isfinite(cost).any() else 1.0
    return assign_optimal(cost, big)


def match_alarms(events: Sequence[tuple[int, float, float]], alarms: Sequence[float]) -> list[tuple[float, int | None, str]]:
    """(alarm, event, outcome): each alarm in order takes the open event with the earliest deadline whose window holds it;
    'duplicate' if only taken ones hold it, else 'false'. events: (id, from, to)."""
    taken: set[int] = set()
    out = []
    for t in sorted(alarms):
        inside = sorted((b, i) for i, a, b in events if a <= t <= b)
        free = [(b, i) for b, i in inside if i not in taken]
        if free:
            taken.add(free[0][1])
            out.append((t, free[0][1], "hit"))
        else:
            out.append((t, inside[0][1] if inside else None, "duplicate" if inside else "false"))
    return out


def match_alarms_scored(events, alarms, negatives) -> list[tuple[float, int | None, str]]:
    """As match_alarms, but an alarm outside every event is 'false' only within a stretch known to be quiet (negatives: from,
    to, the end open); elsewhere it is 'unscored'."""
    return [(t, i, o if o != "false" or any(a <= t < b for a, b in negatives) else "unscored") for t, i, o in match_alarms(events, alarms)]


def spread_blocks(proposals: Sequence[tuple]) -> set:
    """Tracks that are blocked among (track, candidate) proposals: whoever shares a candidate, and everyone who is tied to
    those through candidates, to the fixpoint."""
    owners: dict = {}
    wants: dict = {}
    for t, c in proposals:
        owners.setdefault(c, set()).add(t)
        wants.setdefault(t, set()).add(c)
    todo = [t for c, who in owners.items() if len(who) > 1 for t in who]
    blocked: set = set()
    while todo:
        t = todo.pop()
        if t not in blocked:
            blocked.add(t)
            todo += [o for c in wants[t] for o in owners[c] if o not in blocked]
    return blocked


def spread_four(p: np.ndarray) -> tuple[list[int], float]:
    """Four points whose least distance from one another is greatest, and that distance: tried out up to 24 points, beyond
    that the farthest from the middle and then ever the one farthest from those chosen."""
    import itertools

    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) if len(p) <= 24 else None
    if d is not None:
        best = max(itertools.combinations(range(len(p)), 4), key=lambda c: (min(d[a, b] for a, b in itertools.combinations(c, 2)), tuple(-k for k in c)))
        return list(best), float(min(d[a, b] for a, b in itertools.combinations(best, 2)))
    chosen = [int(np.linalg.norm(p - p.mean(0), axis=1).argmax())]
    near = np.linalg.norm(p - p[chosen[0]], axis=1)
    while len(chosen) < 4:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(p - p[chosen[-1]], axis=1))
    return chosen, float(min(np.linalg.norm(p[a] - p[b]) for a, b in itertools.combinations(chosen, 2)))


def measured_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance between two point sets, a block of rows at a time."""
    best = np.inf
    for lo in range(0, len(a), 256):
        best = min(best, float(((a[lo : lo + 256, None] - b[None]) ** 2).sum(2).min()))
    return float(np.sqrt(best))


def gap_graph(fragments: Sequence[np.ndarray], most: float) -> tuple[float, list[int]]:
    """The largest edge of the least spanning tree over the measured gaps between fragments, and each fragment's component
    when gaps up to ``most`` hold together."""
    n = len(fragments)
    gap = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            gap[i, j] = gap[j, i] = measured_gap(fragments[i], fragments[j])
    label, edges, largest, joined = list(range(n)), sorted((gap[i, j], i, j) for i in range(n) for j in range(i + 1, n)), 0.0, list(range(n))
    for g, i, j in edges:
        if joined[i] != joined[j]:
            largest = max(largest, float(g))
            old, new = joined[j], joined[i]
            joined = [new if x == old else x for x in joined]
        if g <= most and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return largest, label


def merge_measured(points: np.ndarray, label: np.ndarray, links: Sequence[tuple[float, int, int]], plane: np.ndarray, growth: float = 3.0, max_height: float = 2.2, max_span: float = 1.0) -> np.ndarray:
    """Component of each label after merging along measured links (distance, label, label), nearest first. A merge stands
    only if the union has at most ``growth`` times its largest original member's points, no point above ``max_height`` of the
    plane (unit normal and offset) and a diagonal in the plane of at most ``max_span``."""
    n = plane[:3]
    seed = np.array([0.0, 0.0, 1.0]) if abs(n[2]) < 0.9 else np.array([0.0, 1.0, 0.0])
    u = np.cross(n, seed)
    u /= np.linalg.norm(u)
    flat = np.stack([points @ u, points @ np.cross(n, u)], 1)
    height = points @ n + plane[3]
    count = int(label.max()) + 1 if len(label) else 0
    owner = np.arange(count)
    size = np.bincount(label, minlength=count)
    for _, a, b in sorted(links):
        x, y = owner[a], owner[b]
        if x == y:
            continue
        inside = np.isin(owner[label], (x, y))
        most = size[np.isin(owner, (x, y))].max()
        if inside.sum() > growth * most or height[inside].max() > max_height or np.linalg.norm(np.ptp(flat[inside], axis=0)) > max_span:
            continue
        owner[np.isin(owner, (x, y))] = min(x, y)
    return owner


def surface_normals(p: np.ndarray, radius: float, least: int = 4) -> np.ndarray:
    """Unit normal of each point from its neighbours within the radius; NaN with fewer than ``least``."""
    from .clustering import radius_graph

    a, b = radius_graph(p, radius)
    i, j = np.concatenate([a, b, np.arange(len(p))]), np.concatenate([b, a, np.arange(len(p))])
    n = np.bincount(i, minlength=len(p)).astype("float64")
    mean = np.stack([np.bincount(i, p[j, k], len(p)) for k in range(3)], 1) / n[:, None]
    d = p[j] - mean[i]
    cov = np.stack([np.stack([np.bincount(i, d[:, r] * d[:, c], len(p)) for c in range(3)], 1) for r in range(3)], 1)
    out = np.linalg.eigh(cov)[1][:, :, 0]
    out[n < least] = np.nan
    return out


def icp_to_planes(a: np.ndarray, b: np.ndarray, radius: float, schedule: Sequence[tuple[float, float, int]] = ((0.3, 0.7, 20), (0.15, 0.6, 20), (0.08, 0.6, 20)), least: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """R, t that take a onto the surfaces of b, and the root mean square distance to them. schedule: (reach, part of the pairs
    with the smallest residual that is kept, rounds); each round solves the linearised rigid motion of its pairs. The
    nearest points come from cells, so no table of all pairs is formed."""
    normal = surface_normals(b, radius)
    r, t, rms = np.eye(3), np.zeros(3), float("nan")
    for reach, part, rounds in schedule:
        for _ in range(rounds):
            q = a @ r.T + t
            i, j = nearest_by_cells(q, b, reach)
            ok = ~np.isnan(normal[j, 0])
            i, j = i[ok], j[ok]
            if len(i) < least:
                break
            res = ((q[i] - b[j]) * normal[j]).sum(1)
            keep = np.argsort(np.abs(res), kind="stable")[: max(least, int(len(res) * part))]
            i, j, res = i[keep], j[keep], res[keep]
            rms = float(np.sqrt((res**2).mean()))
            rows = np.concatenate([np.cross(q[i], normal[j]), normal[j]], 1)
            x = np.linalg.lstsq(rows, -res, rcond=None)[0]
            angle = np.linalg.norm(x[:3])
            k = x[:3] / angle if angle > 0 else x[:3]
            m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
            turn = np.eye(3) + np.sin(angle) * m + (1 - np.cos(angle)) * m @ m
            r, t = turn @ r, turn @ t + x[3:]
            if angle < 1e-6 and np.linalg.norm(x[3:]) < 1e-6:
                break
    return r, t, rms


def nearest_by_cells(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, nearest row of b) for the points of a with one within ``reach``; memory grows with neighbours, not a x b."""
    import itertools

    low = np.minimum(a.min(0), b.min(0)) if len(a) and len(b) else np.zeros(3)
    ca, cb = (np.floor((p - low) / reach).astype("int64") + 1 for p in (a, b))
    span = np.maximum(ca.max(0, initial=0), cb.max(0, initial=0)) + 2
    code = lambda c: (c[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2]
    key = code(cb)
    order = np.argsort(key, kind="stable")
    key = key[order]
    best, who = np.full(len(a), np.inf), np.full(len(a), -1)
    for o in itertools.product((-1, 0, 1), repeat=3):
        want = code(ca + o)
        lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        for k in range(int((hi - lo).max(initial=0))):
            live = np.flatnonzero(lo + k < hi)
            j = order[lo[live] + k]
            d = ((a[live] - b[j]) ** 2).sum(1)
            better = d < best[live]
            best[live[better]], who[live[better]] = d[better], j[better]
    ok = np.flatnonzero(best <= reach * reach)
    return ok, who[ok]


def declared_plane_search(p: np.ndarray, tol: float = 0.05, rounds: int = 1500, seed: int = 7, most: int = 5, above: float = 0.3) -> tuple[tuple[np.ndarray, float] | None, dict[str, int]]:
    """The ground among the planes of a cloud, and what became of every draw: separation, area, support, duplicate, kept.

    Seeded triples are screened in this order; the best planes by support that aren't near one another are refined five times
    on the points beside them, and the one with the largest part of the points above it is the ground."""
    count = dict.fromkeys(("separation", "area", "support", "duplicate", "kept"), 0)
    rng = np.random.RandomState(seed)
    found = []
    for _ in range(rounds if len(p) >= 3 else 0):
        a, b, c = p[rng.choice(len(p), 3, replace=False)]
        cross = np.cross(b - a, c - a)
        size = np.linalg.norm(cross)
        if min(np.linalg.norm(b - a), np.linalg.norm(c - a), np.linalg.norm(c - b)) < tol:
            count["separation"] += 1
        elif size < 2 * tol * tol:
            count["area"] += 1
        else:
            n = cross / size
            d = -float(n @ a)
            support = int((np.abs(p @ n + d) < tol).sum())
            if support < max(10, len(p) // 100):
                count["support"] += 1
            else:
                found.append((support, n * (1 if d >= 0 else -1), abs(d)))
    kept: list[tuple[int, np.ndarray, float]] = []
    for s, n, d in sorted(found, key=lambda x: (-x[0], x[2])):
        if len(kept) >= most or any(abs(n @ m) > 0.99 and abs(d - e) < tol for _, m, e in kept):
            count["duplicate"] += 1
        else:
            kept.append((s, n, d))
            count["kept"] += 1
    best = None
    for _, n, d in kept:
        for _ in range(5):
            near = p[np.abs(p @ n + d) < 1.6 * tol]
            if len(near) < 10:
                break
            m, e = plane_svd(near)
            m, e = (m, e) if m @ n >= 0 else (-m, -e)
            n, d = m, e
        n, d = (n, d) if d >= 0 else (-n, -d)
        share = float((p @ n + d > above).mean())
        if best is None or share > best[0]:
            best = (share, n, d)
    return ((best[1], best[2]) if best else None), count
