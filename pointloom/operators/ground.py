"""Ground of a site: exchangeable estimators, strict settings, and a fit that tells why it fails."""

from __future__ import annotations

import dataclasses
import enum
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import fitting

#: Estimators by name: points -> (unit normal, offset) or None. ``register_estimator`` adds one.
ESTIMATORS: dict[str, Callable[[np.ndarray], tuple[np.ndarray, float] | None]] = {}


def register_estimator(name: str, fit: Callable[[np.ndarray], tuple[np.ndarray, float] | None]) -> None:
    """A name stands for one estimator for good."""
    if name in ESTIMATORS:
        raise ValueError(f"estimator {name} is there already")
    ESTIMATORS[name] = fit


def _ransac(p: np.ndarray) -> tuple[np.ndarray, float] | None:
    got = fitting.plane_ransac(p, 0.05, 300, 11)
    return (got[0], got[1]) if got else None


register_estimator("tls", lambda p: fitting.plane_tls(p)[:2])
register_estimator("svd", fitting.plane_svd)
register_estimator("ransac", _ransac)


class Mode(enum.Enum):
    """What a site fit gives where the estimators disagree: nothing, or the robust one's plane."""

    STRICT = "strict"
    ROBUST = "robust"


@dataclasses.dataclass(frozen=True)
class SiteSettings:
    fit_frames: int = 25
    check_frames: int = 3
    least_points: int = 60
    band_m: float = 0.08
    rms_m: float = 0.08
    check_p95_m: float = 0.2
    agree_deg: float = 2.0
    agree_m: float = 0.05
    tilt_deg: float = 25.0
    spread_deg: float = 3.0
    mode: Mode = Mode.STRICT

    @classmethod
    def resolve(cls, **given) -> SiteSettings:
        """Defaults with what is given; an unknown name, another type or a number that isn't finite is an error."""
        known = {f.name: getattr(cls(), f.name) for f in dataclasses.fields(cls)}
        for name, v in given.items():
            if name not in known:
                raise ValueError(f"unknown setting {name}")
            if isinstance(v, bool) or not isinstance(v, (int, float) if isinstance(known[name], float) else type(known[name])) or (isinstance(v, float) and not np.isfinite(v)):
                raise ValueError(f"{name} can't be {v!r}")
        return cls(**given)


@dataclasses.dataclass(frozen=True)
class SiteFit:
    status: str
    reason: str | None
    normal: tuple[float, float, float] | None = None
    offset: float | None = None
    rms: float | None = None
    check_p95: float | None = None
    spread_deg: float | None = None


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip(abs(a @ b), 0, 1))))


def fit_site(frame: np.ndarray, p: np.ndarray, settings: SiteSettings | None = None, estimators: Sequence[str] = ("tls", "svd", "ransac"), validator: Callable[[np.ndarray, float], bool] | None = None) -> SiteFit:
    """The ground of a site from the first ``fit_frames`` frames in a row, checked on the next ``check_frames``.

    A seeded search on every eighth point gives the floor's band; the estimators fit the band and must agree (in the robust
    mode the last one wins otherwise); planes of single frames must stay near the whole one's; held-out frames are never
    fitted, only measured. Reasons of failure, in the order of the checks: no_contiguous_frames, no_seed, few_points,
    estimators_disagree, tilted, rough, unstable, held_out, rejected (by ``validator``).
    """
    s = settings or SiteSettings()
    need = s.fit_frames + s.check_frames
    frames = np.unique(frame)
    run = frames - np.arange(len(frames))
    starts = [k for k in range(len(frames) - need + 1) if run[k] == run[k + need - 1]]
    if not starts:
        return SiteFit("failed", "no_contiguous_frames")
    chosen = frames[starts[0] : starts[0] + need]
    fit_at, check_at = np.isin(frame, chosen[: s.fit_frames]), np.isin(frame, chosen[s.fit_frames :])
    fit, held, of = p[fit_at], p[check_at], frame[fit_at]
    seed, _ = fitting.declared_plane_search(fit[::8], tol=s.band_m, rounds=400)
    if seed is None:
        return SiteFit("failed", "no_seed")
    near = np.abs(fit @ seed[0] + seed[1]) <= 2 * s.band_m
    if near.sum() < s.least_points:
        return SiteFit("failed", "few_points")
    floor, of = fit[near], of[near]
    planes = {}
    for name in estimators:
        got = ESTIMATORS[name](floor)
        if got is not None:
            n, d = got
            planes[name] = (n, d) if n[2] >= 0 else (-n, -d)
    pairs = [(planes[a], planes[b]) for k, a in enumerate(planes) for b in list(planes)[k + 1 :]]
    agree = len(planes) == len(estimators) and all(_angle(a[0], b[0]) <= s.agree_deg and abs(a[1] - b[1]) <= s.agree_m for a, b in pairs)
    if not planes or (not agree and s.mode is Mode.STRICT):
        return SiteFit("failed", "estimators_disagree")
    n, d = next(iter(planes.values())) if agree else list(planes.values())[-1]
    if _angle(n, np.array([0.0, 0.0, 1.0])) > s.tilt_deg:
        return SiteFit("failed", "tilted")
    rms = float(np.sqrt(((floor @ n + d) ** 2).mean()))
    if rms > s.rms_m:
        return SiteFit("failed", "rough", rms=rms)
    single = [fitting.plane_svd(floor[of == f])[0] for f in np.unique(of) if (of == f).sum() >= 10]
    spread = max((_angle(n, m) for m in single), default=0.0)
    if spread > s.spread_deg:
        return SiteFit("failed", "unstable", rms=rms, spread_deg=spread)
    off = np.abs(held @ n + d)
    off = off[off <= 4 * s.band_m]
    p95 = float(np.quantile(off, 0.95)) if len(off) else float("inf")
    if p95 > s.check_p95_m:
        return SiteFit("failed", "held_out", rms=rms, check_p95=p95, spread_deg=spread)
    if validator is not None and not validator(n, d):
        return SiteFit("failed", "rejected", rms=rms, check_p95=p95, spread_deg=spread)
    return SiteFit("fitted", None, tuple(map(float, n)), float(d), rms, p95, spread)


def site_fits(points: DataFrame, keys: Sequence[str], given: Mapping | None = None, estimators: Sequence[str] = ("tls", "svd", "ransac"), validator: Callable | None = None) -> DataFrame:
    """(keys, status, reason, nx, ny, nz, d, rms, check_p95, spread_deg) of each key's points (frame_index, x, y, z). Only the
    band of the first frames is fitted, but a key's rows are held together: keys are sites or sessions, not the corpus."""
    settings = SiteSettings.resolve(**(given or {}))
    known = {n: ESTIMATORS[n] for n in estimators}

    def run(pdf: pd.DataFrame) -> list[tuple]:
        ESTIMATORS.update({n: f for n, f in known.items() if n not in ESTIMATORS})  # those registered by the driver only
        f = fit_site(pdf["frame_index"].to_numpy(), pdf[["x", "y", "z"]].to_numpy("float64"), settings, estimators, validator)
        return [(f.status, f.reason, *(f.normal or (None,) * 3), f.offset, f.rms, f.check_p95, f.spread_deg)]

    schema = "status string, reason string, nx double, ny double, nz double, d double, rms double, check_p95 double, spread_deg double"
    return fitting.per_group(points.select(*keys, "frame_index", "x", "y", "z"), keys, ["frame_index", "x", "y", "z"], run, schema)
