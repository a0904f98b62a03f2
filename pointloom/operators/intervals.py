"""Overlapping and gapped intervals per entity: an ordered map of disjoint intervals kept by binary search."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import group_starts, latest_per_key, same_value, stream_groups, trim_blanks


class IntervalMap:
    """Disjoint closed integer intervals in order, with the gaps between neighbours.

    ``insert`` finds the overlapped stretch by two binary searches, merges it and rewrites the gaps beside it.
    Intervals that touch (end 10, start 11) are one.
    """

    __slots__ = ("ends", "gaps", "starts")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()):
        self.starts, self.ends = list(starts), list(ends)
        self.gaps = [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]

    def insert(self, lo: int, hi: int) -> None:
        starts, ends = self.starts, self.ends
        i, j = bisect_left(ends, lo - 1), bisect_right(starts, hi + 1)
        if i < j:
            lo, hi = min(lo, starts[i]), max(hi, ends[j - 1])
        starts[i:j], ends[i:j] = [lo], [hi]
        beside = [(ends[i - 1] + 1, lo - 1)] if i else []
        if i + 1 < len(starts):
            beside.append((hi + 1, starts[i + 1] - 1))
        self.gaps[max(i - 1, 0) : j] = beside

    def pieces(self) -> list[tuple[str, int, int]]:
        return [("period", a, b) for a, b in zip(self.starts, self.ends)] + [("gap", a, b) for a, b in self.gaps]


def usable_intervals(df: DataFrame) -> DataFrame:
    """The row with the latest saved_ts of each interval_id (a null one is earliest; ties by the greatest values),
    then only rows with track, label and sane bounds; the label in lower case without outer blanks."""
    cols = ["session_id", "track_id", "label", "start_frame", "end_frame"]
    held = latest_per_key(df.select("interval_id", "saved_ts", *cols), ["interval_id"], ["saved_ts"], cols)
    return held.withColumn("label", F.lower(trim_blanks("label"))).filter(
        "track_id is not null and label <> '' and start_frame >= 0 and start_frame <= end_frame"
    ).select(*cols)


def merge_intervals(
    df: DataFrame, entity: Sequence[str] = ("session_id", "track_id", "label"), start: str = "start_frame", end: str = "end_frame"
) -> DataFrame:
    """Continuous periods and the gaps between them for each entity.

    ``df``: entity columns and integer bounds, both inclusive; rows with a null bound or start > end must be gone.
    Result: entity, piece ('period' or 'gap'), start, end. Null entity values form their own entity; no rows, no
    result; repeated rows change nothing; other columns are left out.

    Each task first merges what it holds of an entity, without a shuffle: a hot entity then sends at most its
    disjoint periods per task, and the merge after the shuffle is exact whatever the split was. That merge gets the periods
    in order and hands out what no later one can change, so from batch to batch only an entity's last period is kept.
    """
    entity = list(entity)
    rows = df.select(*entity, F.col(start).cast("bigint").alias("__lo"), F.col(end).cast("bigint").alias("__hi"))
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in entity)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = group_starts(pdf, entity)
        lo, hi = pdf["__lo"].tolist(), pdf["__hi"].tolist()
        at, a, b = [], [], []
        for g in range(len(cuts) - 1):
            kept = IntervalMap()
            for r in range(cuts[g], cuts[g + 1]):
                kept.insert(lo[r], hi[r])
            at += [cuts[g]] * len(kept.starts)
            a += kept.starts
            b += kept.ends
        res = pdf[entity].iloc[at].reset_index(drop=True)
        return res.assign(__lo=pd.array(a, "int64"), __hi=pd.array(b, "int64"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, None  # the entity that goes on in the next batch, as a frame of one row, and its last period
        for pdf in batches:
            if not len(pdf):
                continue
            cuts = group_starts(pdf, entity)
            lo, hi = pdf["__lo"].tolist(), pdf["__hi"].tolist()
            at, piece, a, b = [], [], [], []
            before = None
            if open_:
                first = pdf[entity].iloc[0]
                if not all(same_value(key.iloc[0][c], first[c]) for c in entity):
                    before = key.assign(piece="period", __lo=open_[0], __hi=open_[1])
                    open_ = None
            for g in range(len(cuts) - 1):
                kept = IntervalMap(*([[v] for v in open_] if open_ else []))
                open_ = None
                for r in range(cuts[g], cuts[g + 1]):
                    kept.insert(lo[r], hi[r])
                out = kept.pieces()
                if g == len(cuts) - 2:
                    open_ = (kept.starts[-1], kept.ends[-1])
                    out.remove(("period", *open_))
                at += [cuts[g]] * len(out)
                for p, x, y in out:
                    piece.append(p)
                    a.append(x)
                    b.append(y)
            key = pdf[entity].iloc[[len(pdf) - 1]].reset_index(drop=True)
            res = pdf[entity].iloc[at].reset_index(drop=True).assign(piece=piece, __lo=pd.array(a, "int64"), __hi=pd.array(b, "int64"))
            yield res if before is None else pd.concat([before, res], ignore_index=True)
        if open_:
            yield key.assign(piece="period", __lo=open_[0], __hi=open_[1])

    part = stream_groups(rows, entity, ["__lo", "__hi"], fold, f"{head}, __lo bigint, __hi bigint", shuffle=False)
    done = part.repartition(*entity).sortWithinPartitions(*entity, "__lo", "__hi").mapInPandas(finish, f"{head}, piece string, __lo bigint, __hi bigint")
    kind = df.schema[start].dataType
    return done.select(*entity, "piece", F.col("__lo").cast(kind).alias(start), F.col("__hi").cast(kind).alias(end))


def label_periods(df: DataFrame) -> DataFrame:
    """Periods and gaps of labelled frame ranges per session, track and label (raw label_intervals rows in)."""
    return merge_intervals(usable_intervals(df)).select("session_id", "track_id", "label", "piece", "start_frame", "end_frame")
