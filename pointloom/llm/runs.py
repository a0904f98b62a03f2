"""Runs of identical or near-identical consecutive events, collapsed to one event each.

Optimal segmentation: choose boundaries and one state per run so that the dissimilarity of the records to their run's
state, plus a penalty per boundary, costs least. A record of another state costs one record and more, the less its
state's word is like the run's (APART). The dynamic programme is pruned functionally: per state only the best open run
survives, since all older openings of that state stay behind by a constant. A record without state or a broken clock is
a boundary that costs nothing and can't be crossed.

Boundaries lie only where the state changes, so like neighbours are packed before. A pack of more than 2 * penalty records
is an anchor: every optimal segmentation is in its state there, whatever comes before or after. Tracks are therefore cut
into frame blocks; a block solves the stretch between its first and last anchor for good, and only what lies outside goes
on to the pass over the track. The result is that of one uncut pass, and no task holds a whole track, unless a track has
no anchor at all for block after block.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import BLANKS, group_starts, stream_groups

#: The forms of a posture state.
STATES = ["upright", "descending", "low_posture", "lying", "sitting", "unknown"]
_LETTERS = [s.replace("_", "") for s in STATES]
#: Frames of a track that one task solves.
BLOCK_FRAMES = 8192
#: With a penalty under half a record every change of state is a boundary; larger ones let flickers join their run.
EXACT, STEADY = 0.25, 2.0


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


#: Cost, in hundredths of a record, of a record of one state in a run of another: the edits between their words count.
APART = [[100 * (a != b) + 10 * _edits(a, b) for b in _LETTERS] for a in _LETTERS]


def state_code(state: Column) -> Column:
    """Index in STATES of a written state, -1 for null or blank.

    Width, case, blanks and marks fall away; what then is no form as it stands goes to the nearest by edit distance
    (ties: the earlier in STATES). A text of marks alone stands for nothing.
    """
    wide = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
    thin = "".join(chr(c - 0xFEE0) for c in map(ord, wide))
    letters = F.regexp_replace(F.lower(F.translate(state, wide, thin)), f"{BLANKS}|[^\\p{{L}}]", "")
    exact = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in _LETTERS]), letters), F.lit(0)).cast("int") - 1
    apart = F.array(*[F.struct(F.levenshtein(letters, F.lit(x)).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(_LETTERS)])
    return F.when(letters.isNull() | (letters == ""), -1).when(exact >= 0, exact).otherwise(F.array_min(apart)["i"])


def held_records(frames: DataFrame) -> DataFrame:
    """One record per session, track and frame: the one with the latest recv_ts (null earliest, ties by the larger
    record_id). Rows without track or frame are left out."""
    # One number orders the deliveries, so the aggregate hashes on fixed-width buffers before and after the shuffle.
    when = F.coalesce(F.unix_micros(F.col("recv_ts").cast("timestamp")), F.lit(-(2**62)))
    order = when.cast("decimal(38,0)") * F.lit(Decimal(10**19)) + F.coalesce("record_id", F.lit(0)).cast("decimal(19,0)")
    rows = frames.filter("track_id is not null and frame_index is not null").select(
        "session_id", "track_id", "frame_index", state_code(F.col("state")).cast("byte").alias("state"), "stamp_sec", order.cast("decimal(38,0)").alias("o")
    )
    return rows.groupBy("session_id", "track_id", "frame_index").agg(F.max_by("state", "o").alias("state"), F.max_by("stamp_sec", "o").alias("stamp_sec"))


def segment(weights, states, penalty: float, first: int | None = None, last: int | None = None) -> list[int]:
    """Least-cost segmentation of the packs of one steady stretch: the state of the run each pack falls in.

    weights/states: records and state of each pack; penalty in records; ``first`` and ``last`` fix the states of the two
    ends. Ties: a run rather goes on than ends, else the smaller code.
    """
    codes, price = range(len(APART)), round(100 * penalty)
    cost = [0 if first is None or k == first else math.inf for k in codes]
    back: list[list[int]] = []
    for w, s in zip(weights, states):
        if back:
            least = min(cost)
            low, jump = cost.index(least), least + price
            came = [k if cost[k] <= jump else low for k in codes]
        else:
            jump, came = math.inf, list(codes)
        back.append(came)
        cost = [min(c, jump) + w * a for c, a in zip(cost, APART[s])]
    at = last if last is not None else cost.index(min(cost))
    chosen = []
    for came in reversed(back):
        chosen.append(at)
        at = came[at]
    return chosen[::-1]


#: kind 0: packed run not yet settled; 1: settled run that may still grow; 2: settled and closed.
_PACKED = "session_id string, track_id string, seg bigint, start_frame int, end_frame int, first_stamp double, last_stamp double, n bigint, like bigint, state int, fresh boolean, kind int"
_COLS = [c.split()[0] for c in _PACKED.split(", ")]
_KINDS = ["int32", "int32", "float64", "float64", "int64", "int64", "int32", "bool", "int32"]
#: seg of the runs that the pass over the track joins; settled ones have their block's number.
_SEAM = -(2**62)
#: Weight of a settled run in the pass over the track: its state stands.
_FIXED = 10**15


def _pack(pdf: pd.DataFrame, keys: list[str], max_gap: float):
    """Packed runs of equal state and steady clock: row bounds, and whether a forced boundary stands before each."""
    stamp = pdf["stamp_sec"].to_numpy("float64")
    state = pdf["state"].to_numpy("int64")
    head = np.zeros(len(pdf), bool)
    head[group_starts(pdf, keys)[:-1]] = True
    with np.errstate(invalid="ignore"):
        step = np.diff(stamp, prepend=np.nan)
        steady = (step > 0) & (step <= max_gap)
    forced = head | ~steady
    blank = state < 0
    forced[1:] |= blank[:-1]
    forced |= blank
    new = forced.copy()
    new[1:] |= state[1:] != state[:-1]
    return np.append(np.flatnonzero(new), len(pdf)), forced, head


def _solve(runs: list[list], penalty: float, edge: bool) -> list[list]:
    """Settle a stretch of packed runs of one track. runs: rows in the order of _COLS without the keys. With ``edge``
    the stretch may go on beyond both ends, so only what lies between anchors is settled."""
    out: list[list] = []
    i = 0
    while i < len(runs):
        j = i + 1
        while j < len(runs) and not runs[j][7]:
            j += 1
        out += _solve_steady(runs[i:j], penalty, edge and i == 0, edge and j == len(runs))
        i = j
    return out


def _solve_steady(runs: list[list], penalty: float, open_left: bool, open_right: bool) -> list[list]:
    if runs[0][6] < 0:
        return runs
    strong = [k for k, r in enumerate(runs) if r[8] == 1 or r[5] > 2 * penalty]
    if (open_left or open_right) and not strong:
        return runs
    a = strong[0] if open_left else 0
    b = strong[-1] if open_right else len(runs) - 1
    mid = runs[a : b + 1]
    chosen = segment([_FIXED if r[8] else r[5] for r in mid], [r[6] for r in mid], penalty, mid[0][6] if open_left else None, mid[-1][6] if open_right else None)
    done: list[list] = []
    for r, k in zip(mid, chosen):
        if done and done[-1][6] == k and not r[7]:
            d = done[-1]
            d[1], d[3] = r[1], r[3]
            d[4] += r[4]
            d[5] += r[5] if r[6] == k else r[4] - r[5]
        else:
            done.append([r[0], r[1], r[2], r[3], r[4], r[5] if r[6] == k else r[4] - r[5], k, r[7], 2])
    if open_left:
        done[0][8] = 1
    if open_right:
        done[-1][8] = 1
        done[-1][7] |= len(done) > 1  # the boundary before it stands
    return [*runs[:a], *done, *runs[b + 1 :]]


def collapse_runs(records: DataFrame, penalty: float = EXACT, max_gap: float = 0.5, block: int = BLOCK_FRAMES) -> DataFrame:
    """One row per run of like consecutive records of a track by least-cost segmentation: (session_id, track_id, state, start_frame, end_frame,
    frames, same_frames, duration_sec).

    ``records``: one row per session, track and frame with a state code (-1: none) and stamp_sec. Records are next to
    each other by frame_index; a run ends at a record without state and where stamp_sec doesn't rise by more than 0 and
    at most ``max_gap`` seconds. frames counts the run's records, same_frames those in its own state (fewer only where
    the penalty let others join). Records without state form no run; an empty table gives no row.
    """
    rows = records.withColumn("__block", F.floor(F.col("frame_index") / block))

    def solve_block(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["session_id", "track_id", "__block"]
        cuts, forced, head = _pack(pdf, keys, max_gap)
        frame, stamp, state = pdf["frame_index"].to_numpy(), pdf["stamp_sec"].to_numpy("float64"), pdf["state"].to_numpy()
        a, b = cuts[:-1], cuts[1:] - 1
        n = (cuts[1:] - cuts[:-1]).tolist()
        packed = list(map(list, zip(frame[a].tolist(), frame[b].tolist(), stamp[a].tolist(), stamp[b].tolist(), n, n, state[a].tolist(), forced[a].tolist(), [0] * len(n))))
        starts = np.append(np.flatnonzero(head[a]), len(a))
        out, at = [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            part = packed[lo:hi]
            part[0][7] = False  # whether the track goes on across the block's edge is seen in the next pass
            solved = _solve(part, penalty, True)
            # what is settled stays with its block; records without state matter further only at the block's ends
            solved = [r for k, r in enumerate(solved) if r[6] >= 0 or k in (0, len(solved) - 1)]
            out += solved
            at += [a[lo]] * len(solved)
        res = pdf[["session_id", "track_id"]].iloc[at].reset_index(drop=True)
        kind = np.array([r[8] for r in out], "int64")
        res["seg"] = np.where(kind == 2, pdf["__block"].to_numpy("int64")[at], _SEAM)
        for c, k, values in zip(_COLS[3:], _KINDS, zip(*out)):
            res[c] = np.array(values, k)
        return res

    parts = stream_groups(rows, ["session_id", "track_id", "__block"], ["frame_index"], solve_block, _PACKED)

    def solve_track(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = group_starts(pdf, ["session_id", "track_id", "seg"])
        cols, seg = [pdf[c].tolist() for c in _COLS[3:]], pdf["seg"].to_numpy()
        every = list(map(list, zip(*cols)))
        out, at = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            runs = every[lo:hi]
            if seg[lo] != _SEAM:
                out += runs
                at += [lo] * len(runs)
                continue
            runs[0][7] = True
            for p, r in zip(runs, runs[1:]):
                step = r[2] - p[3]
                if not (0 < step <= max_gap) or p[6] < 0 or r[6] < 0:
                    r[7] = True
            solved = [r for r in _solve(runs, penalty, False) if r[6] >= 0]
            out += solved
            at += [lo] * len(solved)
        res = pdf[["session_id", "track_id"]].iloc[at].reset_index(drop=True)
        done = pd.DataFrame(out, columns=_COLS[3:])
        res["state"] = [STATES[k] for k in done["state"]]
        for c, k in (("start_frame", "int32"), ("end_frame", "int32"), ("n", "int64"), ("like", "int64")):
            res[c] = done[c].to_numpy(k)
        res["duration_sec"] = (done["last_stamp"] - done["first_stamp"]).to_numpy("float64")
        return res

    done = stream_groups(
        parts, ["session_id", "track_id", "seg"], ["start_frame"], solve_track,
        "session_id string, track_id string, state string, start_frame int, end_frame int, n bigint, like bigint, duration_sec double",
    )
    return done.withColumnsRenamed({"n": "frames", "like": "same_frames"})


def posture_runs(frames: DataFrame, penalty: float = STEADY) -> DataFrame:
    """Runs of posture_frames, each with its state, first and last frame, number of frames and duration. At STEADY records
    a boundary, flickers of up to about three records join the run around them; at EXACT nothing does."""
    return collapse_runs(held_records(frames), penalty)
