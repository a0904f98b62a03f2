"""Readers and sinks: packed point files, wire clouds, archives, JSON documents, calibration tables, sealed results."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The 28-byte little-endian point record.
POINT_RECORD = np.dtype({"names": ["x", "y", "z", "intensity", "ring", "ts"], "formats": ["<f4", "<f4", "<f4", "<f4", "<u2", "<f4"], "offsets": [0, 4, 8, 12, 16, 20], "itemsize": 28})
POINT_SCHEMA = "session_id string, frame_index int, source_row bigint, x float, y float, z float, intensity float, ring int, ts float"
#: Field types of a wire cloud by their numbers.
WIRE_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def decode_points(raw: bytes) -> pd.DataFrame:
    """Rows of packed records; a torn last record is an error."""
    if len(raw) % POINT_RECORD.itemsize:
        raise ValueError(f"{len(raw)} bytes are no whole number of records")
    a = np.frombuffer(raw, POINT_RECORD)
    return pd.DataFrame({n: a[n].astype(a[n].dtype.newbyteorder("=")) for n in POINT_RECORD.names})


def decode_wire(data: bytes, fields: list[tuple[str, int, int]], step: int, big_endian: bool = False) -> pd.DataFrame:
    """Rows of a cloud by its own field list (name, offset, type number). Rows that aren't finite stay, so row numbers
    hold; overlapping or overlong fields are errors."""
    end = ">" if big_endian else "<"
    spans = sorted((o, o + np.dtype(WIRE_TYPES[k]).itemsize, n) for n, o, k in fields)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])) or (spans and spans[-1][1] > step):
        raise ValueError("fields overlap or leave the row")
    if step <= 0 or len(data) % step:
        raise ValueError("data isn't a whole number of rows")
    t = np.dtype({"names": [f[0] for f in fields], "formats": [end + WIRE_TYPES[f[2]] for f in fields], "offsets": [f[1] for f in fields], "itemsize": step})
    a = np.frombuffer(data, t)
    return pd.DataFrame({n: a[n].astype(a[n].dtype.newbyteorder("=")) for n in t.names})


def read_sessions(spark: SparkSession, root: str, frames: int = 512) -> DataFrame:
    """Point rows of every session folder (meta.json + points.bin) under root.

    The meta files are read and cut into slices of ``frames`` frames by tasks; each slice then reads its own bytes of
    points.bin through pyarrow's file systems, so a session of any length is split and nothing is opened by the driver.
    """
    metas = spark.read.option("wholetext", True).text(f"{root}/*/meta.json").select(F.input_file_name().alias("path"), "value")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"]):
                meta = json.loads(text)
                for k in range(0, len(meta["frames"]), frames):
                    some = meta["frames"][k : k + frames]
                    rows.append((path.rsplit("/", 1)[0], meta["session_id"], k, [f["offset_points"] for f in some], [f["count_points"] for f in some]))
            yield pd.DataFrame(rows, columns=["folder", "session_id", "first", "offsets", "counts"])

    slices = metas.mapInPandas(cut, "folder string, session_id string, first int, offsets array<bigint>, counts array<bigint>")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        size = POINT_RECORD.itemsize
        for pdf in batches:
            for folder, sid, first, offsets, counts in zip(*[pdf[c] for c in ("folder", "session_id", "first", "offsets", "counts")]):
                system, name = fs.FileSystem.from_uri(folder + "/points.bin")
                with system.open_input_file(name) as f:
                    for k, (at, n) in enumerate(zip(offsets, counts)):
                        p = decode_points(f.read_at(int(n) * size, int(at) * size))
                        if len(p) != n:
                            raise ValueError(f"frame {first + k} of {sid} ends early")
                        yield p.assign(session_id=sid, frame_index=first + k, source_row=np.arange(at, at + n))[[c.split()[0] for c in POINT_SCHEMA.split(", ")]]

    return slices.repartition(F.xxhash64("folder", "first")).mapInPandas(read, POINT_SCHEMA)


def write_session(folder: str, session_id: str, frames: list[pd.DataFrame]) -> None:
    """A session folder from frames of point rows; rows that aren't finite are left out and counted."""
    os.makedirs(folder, exist_ok=False)
    meta, at = {"session_id": session_id, "frames": [], "total_dropped_points": 0}, 0
    with open(os.path.join(folder, "points.bin"), "wb") as f:
        for k, pdf in enumerate(frames):
            ok = np.isfinite(pdf[["x", "y", "z"]].to_numpy("float64")).all(1)
            a = np.zeros(int(ok.sum()), POINT_RECORD)
            for n in POINT_RECORD.names:
                a[n] = pdf[n].to_numpy()[ok]
            f.write(a.tobytes())
            meta["frames"].append({"seq": k, "offset_points": at, "count_points": len(a), "dropped_points": int((~ok).sum())})
            meta["total_dropped_points"] += int((~ok).sum())
            at += len(a)
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump(meta, f, sort_keys=True)


def read_scan_grid(spark: SparkSession, azimuth_csv: str, elevation_csv: str) -> DataFrame:
    """(ring, col, az_deg, el_deg) from two matrices of equal shape, one CSV row a ring."""

    def long(path: str, name: str) -> DataFrame:
        t = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"), F.split("value", ",").alias("v"))
        t = t.withColumn("ring", (F.row_number().over(W.orderBy("s", "i")) - 1).cast("int"))  # a calibration file has a few hundred lines
        return t.select("ring", F.posexplode("v").alias("col", name)).withColumn(name, F.trim(name).cast("double"))

    return long(azimuth_csv, "az_deg").join(long(elevation_csv, "el_deg"), ["ring", "col"], "full_outer")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, row, t, x, y, z, intensity) of .npz clips: points (N, 4), frame_offsets (F + 1), timestamps (F);
    offsets must not fall and times must rise, else the clip is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(raw), allow_pickle=False)
                pts, off, ts = z["points"].astype("float64"), z["frame_offsets"].astype("int64"), z["timestamps"].astype("float64")
                if off[0] != 0 or off[-1] != len(pts) or (np.diff(off) < 0).any() or len(off) != len(ts) + 1 or (np.diff(ts) <= 0).any():
                    raise ValueError(f"{p}: frames don't fit its points")
                f = np.repeat(np.arange(len(ts)), np.diff(off))
                yield pd.DataFrame({"path": p, "frame": f.astype("int32"), "row": np.arange(len(pts)), "t": ts[f], "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2], "intensity": pts[:, 3]})

    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return b.mapInPandas(run, "path string, frame int, row bigint, t double, x double, y double, z double, intensity double")


def read_zipped_bins(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, frame, row, x, y, z) of zips of float64 XYZ files named by number; the CRC is checked, a missing
    number is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = sorted((int(os.path.splitext(os.path.basename(n))[0]), n) for n in z.namelist() if n.endswith(".bin"))
                    if [k for k, _ in names] != list(range(names[0][0], names[0][0] + len(names))) if names else False:
                        raise ValueError(f"{p}: a frame is missing")
                    for k, n in names:
                        a = np.frombuffer(z.read(n), "<f8").reshape(-1, 3)
                        yield pd.DataFrame({"path": p, "member": n, "frame": k, "row": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]})

    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return b.mapInPandas(run, "path string, member string, frame int, row bigint, x double, y double, z double")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema: only its fields are parsed; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def verified_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, digest_ok, content) of files against a manifest (name, sha256); a file that isn't listed is not ok."""
    b = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"), F.decode("content", "UTF-8").alias("content"))
    j = b.join(manifest, "name", "left")
    return j.select("name", F.coalesce(F.lower("sha256") == F.col("found"), F.lit(False)).alias("digest_ok"), "content")


def seal(df: DataFrame, path: str) -> None:
    """Writes once (an existing path is an error), each row with the digest of its content."""
    df.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).write.mode("errorifexists").parquet(path)


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """Reads sealed rows; a row whose content and digest differ fails the query."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c != "digest"]
    ok = F.col("digest") == F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
    return df.filter(F.assert_true(ok, F.lit("sealed row was changed")).isNull()).select(*cols)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after the changes: per key the row with the greatest order (ties: the changes)."""
    u = current.withColumn("__c", F.lit(0)).unionByName(changes.withColumn("__c", F.lit(1)))
    rest = [c for c in current.columns if c != key]
    g = u.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "__c")).alias("s"))
    return g.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def retention(df: DataFrame, keys: list[str], priority: str, created: str, keep: int, tie: str) -> DataFrame:
    """Adds evict: all but the ``keep`` rows of a key that are highest in priority and, within it, newest."""
    w = W.partitionBy(*keys).orderBy(F.desc(priority), F.desc(created), F.desc(tie))
    return df.withColumn("evict", F.row_number().over(w) > keep)


def append_records(batch: DataFrame, path: str, records_per_file: int = 100_000, keep_files: int | None = None) -> None:
    """A foreachBatch sink: JSON lines in files of bounded size. With ``keep_files`` the oldest files beyond that many go, as
    a log that rotates; without, nothing is ever removed."""
    batch.write.mode("append").option("maxRecordsPerFile", records_per_file).json(path)
    if keep_files is not None:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files = [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name.startswith("part-")]
        for f in sorted(files, key=lambda f: (f.mtime, f.base_name), reverse=True)[keep_files:]:
            system.delete_file(f.path)


def save_pair(folder: str, report: dict, plane: dict) -> None:
    """A fit's report and its plane, sealed by the report's digest: both files are made anew or neither stays."""
    text = json.dumps(report, sort_keys=True, allow_nan=False)
    sealed = json.dumps({"plane": plane, "report_sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True, allow_nan=False)
    os.makedirs(folder, exist_ok=True)
    first = os.path.join(folder, "report.json")
    with open(first, "x") as f:
        f.write(text)
    try:
        with open(os.path.join(folder, "plane.json"), "x") as f:
            f.write(sealed)
    except OSError:
        os.remove(first)
        raise


def verified_planes(spark: SparkSession, root: str, bindings: DataFrame) -> DataFrame:
    """(name, outcome, plane) of every saved pair under root against its declared binding (name, report_sha256): the plane
    counts only if the report's bytes, the seal and the declaration all have one digest; else outcome names what differs."""
    read = lambda leaf: spark.read.format("binaryFile").load(f"{root}/*/{leaf}").select(F.element_at(F.split("path", "/"), -2).alias("name"), F.sha2("content", 256).alias(f"{leaf[:-5]}_sha"), F.decode("content", "UTF-8").alias(leaf[:-5]))
    j = read("report.json").join(read("plane.json"), "name", "full_outer").join(bindings.select("name", F.col("report_sha256").alias("declared")), "name", "left")
    seal = F.get_json_object("plane", "$.report_sha256")
    o = F.when(F.col("report").isNull() | F.col("plane").isNull(), "incomplete").when(F.col("declared").isNull(), "not_declared").when(F.col("report_sha") != F.col("declared"), "report_changed").when(~F.coalesce(seal == F.col("declared"), F.lit(False)), "seal_differs").otherwise("verified")
    return j.select("name", o.alias("outcome"), F.when(o == "verified", F.get_json_object("plane", "$.plane")).alias("plane"))


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
