"""Shared plumbing: table access, checkpoint folder, grouped maps that stream over sorted partitions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks, with those that Java's \\s leaves out: no-break, ideographic and zero-width ones, byte order mark.
BLANKS = r"[\s\u00a0\u1680\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a session without one gets its own if it runs on this machine alone
    (tests), else an error, since executors couldn't read a folder of the driver."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pointloom-cp-")
    sc.setCheckpointDir(folder)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the Python workers once a session, wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_pointloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # not when the package itself came as a zip
        path = os.path.join(tempfile.mkdtemp(prefix="pointloom-src-"), "pointloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("pointloom", os.path.relpath(full, root)))
        sc.addPyFile(path)
    sc._pointloom_shipped = True


def trim_blanks(c: Column | str) -> Column:
    """Strip every kind of blank from both ends."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key: the one greatest by ``order``, ties by the values of ``cols``; null orders lowest.

    A partial aggregate runs before the shuffle, so a key that holds a third of all rows costs one row per task.
    """
    rank = F.struct(*[F.col(c) for c in (*order, *[c for c in cols if c not in order])])
    held = df.groupBy(*keys).agg(F.max(rank).alias("__held"))
    return held.select(*keys, *[F.col(f"__held.{c}").alias(c) for c in cols])


def stream_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]],
    schema: str,
    shuffle: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Run ``fn`` over frames that hold whole key groups in order, several groups to a call.

    Rows are shuffled by ``keys`` (unless ``shuffle`` is false), sorted in the partition and streamed through
    mapInPandas; the group at the end of one Arrow batch is carried into the next. One call serves thousands of
    groups, unlike applyInPandas with its cost per group. ``fn`` gives one frame or yields several.
    """
    keys, order = list(keys), list(order)
    if shuffle:
        df = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    df = df.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = pd.Series(True, index=pdf.index)
            last = pdf.iloc[-1]
            for k in keys:
                same &= pdf[k].isna() if pd.isna(last[k]) else pdf[k].eq(last[k])
            cut = len(pdf) - int(same.to_numpy()[::-1].cumprod().sum())
            if cut == 0 and held and all(same_value(held[-1][k].iloc[-1], last[k]) for k in keys):
                held.append(pdf)
                continue
            whole = [*held, pdf.iloc[:cut]]
            whole = [x for x in whole if len(x)]
            held = [pdf.iloc[cut:]]
            if whole:
                yield from _frames(fn(pd.concat(whole, ignore_index=True) if len(whole) > 1 else whole[0].reset_index(drop=True)))
        if held:
            yield from _frames(fn(pd.concat(held, ignore_index=True)))

    return df.mapInPandas(run, schema)


def _frames(made: pd.DataFrame | Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if isinstance(made, pd.DataFrame):
        yield made
    else:
        yield from made


def same_value(a, b) -> bool:
    """Equal, or both missing."""
    return (pd.isna(a) and pd.isna(b)) or a == b


def group_starts(pdf: pd.DataFrame, keys: Sequence[str]):
    """Row numbers where a new key group begins, with the end appended."""
    import numpy as np

    new = np.zeros(len(pdf), bool)
    if len(pdf):
        new[0] = True
    for k in keys:
        codes = pd.factorize(pdf[k], use_na_sentinel=True)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), len(pdf))
