"""Schemas that drift between JSON files: one consistent table, and a report of each file's differences.

Each file becomes a map of its paths with the type and value as written. Statistics of paths, types and contents come
from these maps over all files; a file's differences, and the typed columns of the consistent table, are read from its
map alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import latest_per_key

#: A value or shape is typical of a field if at least this part of the files that have the field shows it.
TYPICAL_VALUE, TYPICAL_SHAPE = 0.01, 0.02
#: Contents per field that are known as typical, the most frequent first (what is sent to the driver is bounded by it).
MARKS = 4096
#: What stands between the names of a path inside the maps; in reports it is a dot.
STEP = "\x1f"
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class _Number(float):
    """A number that knows how it is written."""

    text: str


def _number(text: str) -> _Number:
    x = _Number(text)
    x.text = text
    return x


def _integer(text: str) -> int | Decimal:
    return int(text) if len(text) <= 4000 else Decimal(text)


def _reject(_: str):
    raise ValueError("not JSON")


def read_document(raw: str | None):
    """(ok, value) of a text that must be exactly one JSON document by RFC 8259 (no NaN, no byte order mark). Documents
    nested deeper than the interpreter's stack count as unreadable."""
    if raw is None:
        return False, None
    try:
        return True, json.loads(raw, parse_constant=_reject, parse_float=_number, parse_int=_integer)
    except (ValueError, RecursionError):
        return False, None


def json_type(v) -> str:
    """28 is an integer, 28.0 and 1e3 are numbers: the type as written."""
    return _TYPES[type(v)]


_TYPES = {type(None): "null", bool: "boolean", int: "integer", Decimal: "integer", _Number: "number", float: "number", str: "string", list: "array", dict: "object"}


def _written(v) -> str | None:
    """A scalar as it is written (strings without quotes), an array as JSON; nothing for null and objects."""
    if isinstance(v, str):
        return str(v)
    if v is None or isinstance(v, dict):
        return None
    if isinstance(v, list):
        return json.dumps(v, ensure_ascii=False, default=str)
    if isinstance(v, bool):
        return "true" if v else "false"
    return v.text if isinstance(v, _Number) else str(v)


def flatten(doc) -> tuple[list[str], list[str], list[str | None]]:
    """Paths, types and values of a document; the document itself has the empty path. Arrays are values."""
    paths, types, values = [], [], []
    todo = [("", doc)]
    while todo:
        path, v = todo.pop()
        paths.append(path)
        types.append(json_type(v))
        values.append(_written(v))
        if isinstance(v, dict):
            todo += [(f"{path}{STEP}{name}" if path else STEP + name, x) for name, x in reversed(v.items())]
    return paths, types, values


class PathMap:
    """One file's paths: type and value of each, and the names that stand in each object."""

    def __init__(self, paths, types, values):
        self.types, self.values = dict(zip(paths, types)), dict(zip(paths, values))
        self.inner: dict[str, dict[str, str]] = {}
        for p in self.types:
            if p:
                above, _, name = p.rpartition(STEP)
                self.inner.setdefault(above, {})[name] = p

    def value(self, path: str):
        """The content under a path, put together again."""
        t, v = self.types[path], self.values[path]
        if t == "string":
            return v
        if t == "object":
            return {name: self.value(p) for name, p in self.inner.get(path, {}).items()}
        if t == "array":
            return json.loads(v, parse_float=_number, parse_int=_integer)
        return {"null": lambda _: None, "boolean": lambda x: x == "true", "integer": _integer, "number": _number}[t](v)


def leaves(v) -> list[str]:
    """The scalar content of a value as texts; joined lists ("x,y,z") come apart, wrappers fall away."""
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += reversed(v.values())
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, bool):
            out.append(str(v).lower())
        elif isinstance(v, float) and v.is_integer():
            out.append(str(int(v)))
        elif v is not None:
            out += [p.strip() for p in str(v).split(",") if p.strip()]
    return out


def _short(text: str) -> str:
    """Long contents by their digest."""
    return text if len(text) <= 80 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def shape(leaf: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "9", leaf))


def content_marks(v, field_type: str) -> list[str]:
    """What a field's content looks like: inner names for objects, values and shapes for the rest."""
    if isinstance(v, dict) and field_type == "object":
        return [f"k:{k}" for k in v]
    if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        return [f"e:{k}" for k in sorted({k for x in v for k in x})]
    if isinstance(v, dict) and v and all(isinstance(x, dict) for x in v.values()):
        return [f"e:{k}" for k in sorted({k for x in v.values() for k in x})]
    return [m for x in dict.fromkeys(leaves(v)) for m in (f"v:{_short(x)}", f"s:{_short(shape(x))}")]


@functools.lru_cache(20_000)
def known_marks(got: str, text: str | None, want: str) -> tuple[str, ...]:
    """The marks of a scalar or array as it is written: most contents stand in many files."""
    return tuple(dict.fromkeys(content_marks(PathMap([""], [got], [text]).value(""), want)))


def words(name: str) -> list[str]:
    return [w.lower() for w in _SPLIT.findall(name)]


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return bool(a) and all(c in it for c in a)


def name_likeness(a: str, b: str) -> float:
    """0 to 1: equal words, one word list within the other, initials ("fi"), abbreviations ("fmt")."""
    x, y = words(a), words(b)
    fx, fy = "".join(x), "".join(y)
    if fx == fy:
        return 1.0
    if not fx or not fy:
        return 0.0
    if fx == "".join(w[0] for w in y) or fy == "".join(w[0] for w in x):
        return 0.8
    if len(x) == 1 and len(fx) <= 4 and (_subsequence(fx, fy) and fx[0] == fy[0] or fx[0] == fy[0] and fx[1:] == "".join(w[0] for w in y)[1:]):
        return 0.7
    if fx == (y[0][0] + "".join(w[0] for w in y[1:])):
        return 0.7
    if fy.startswith(fx) or fx.startswith(fy):
        return 0.75
    common = sum(1 for w in x if any(w == v or (min(len(w), len(v)) >= 3 and (w.startswith(v) or v.startswith(w))) for v in y))
    return 0.7 * common / max(1, min(len(x), len(y))) * (0.6 + 0.4 * common / max(len(x), len(y)))


class Standard:
    """The standard fields of one file kind, with the content each has in the corpus."""

    def __init__(self, fields: dict[str, str], typical: dict[str, dict[str, float]]):
        self.types, self.typical = fields, typical
        self.children: dict[str, list[str]] = defaultdict(list)
        for path in fields:
            self.children[path.rpartition(".")[0]].append(path)

    def content_likeness(self, v, path: str) -> float:
        marks, usual = content_marks(v, self.types[path]), self.typical.get(path, {})
        if not marks:
            return 0.0
        if marks[0][0] == "k":
            inner = [p.rpartition(".")[2] for p in self.children.get(path, ())]
            return sum(m in usual or any(name_likeness(m[2:], c) >= 0.7 for c in inner) for m in marks) / len(marks)
        if marks[0][0] == "e":
            return sum(m in usual for m in marks) / len(marks)
        exact = [m for m in marks if m[0] == "v"]
        shapes = [m for m in marks if m[0] == "s"]
        same = sum(m in usual for m in exact) / len(exact)
        return max(same, 0.6 * sum(usual.get(m, 0) >= TYPICAL_SHAPE for m in shapes) / len(shapes))

    def pair(self, unknown: dict, missing: list[str]) -> dict[str, str]:
        """Missing path -> unknown name that now holds its content; best pairs first, each used once.

        A pair needs a like name, a somewhat like name with like content, or content that names the field by itself. Which
        of several fields it is, names decide before contents that many fields could have (numbers, flags).
        """
        found = []
        for name, v in unknown.items():
            for path in missing:
                n, c = name_likeness(name, path.rpartition(".")[2]), self.content_likeness(v, path)
                inner = isinstance(v, dict) and self.types[path] == "object" and c >= 0.5
                sure = self.distinctive(v, path)
                if inner or n >= 0.55 or (n >= 0.25 and c >= 0.5) or (c >= 0.99 and (n > 0 or sure)):
                    found.append((n + (c if sure else 0.02 * c), path, name))
        taken: dict[str, str] = {}
        for _, path, name in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if path not in taken and name not in taken.values():
                taken[path] = name
        return taken

    def distinctive(self, v, path: str) -> bool:
        """Content that by itself names the field: usual words or inner names, not bare small numbers or flags."""
        marks = content_marks(v, self.types[path])
        if marks and marks[0][0] in "ke":
            return True
        exact = [m[2:] for m in marks if m[0] == "v"]
        return any(len(x) >= 2 and not re.fullmatch(r"\d|true|false|[\d.]*\.[\d.]*", x) for x in exact)

    def compare(self, file: PathMap) -> tuple[list[tuple[str, str]], dict[str, str]]:
        """The differences of a file, and for each standard field that stands somewhere the path in the file."""
        out: list[tuple[str, str]] = []
        where: dict[str, str] = {}
        todo = [("", "")]
        while todo:
            path, at = todo.pop()
            names = file.inner.get(at, {}) if file.types[at] == "object" else {}
            known = {p.rpartition(".")[2]: p for p in self.children.get(path, ())}
            missing = [p for n, p in known.items() if n not in names]
            unknown = [n for n in names if n not in known]
            moved = self.pair({n: file.value(names[n]) for n in unknown}, missing) if missing and unknown else {}
            for name, p in known.items():
                if p in moved:
                    out.append((p, "renamed"))
                elif name not in names:
                    out.append((p, "removed"))
                    continue
                where[p] = names[moved.get(p, name)]
                got, want = file.types[where[p]], self.types[p]
                if got not in (want, "null") and not (want == "number" and got == "integer"):
                    out.append((p, "retyped"))
                elif want == "object" and got == "object":
                    todo.append((p, where[p]))
            for name in unknown:
                if name not in moved.values() and file.types[names[name]] != "null":
                    out.append((names[name][1:].replace(STEP, "."), "added"))
        return list(dict.fromkeys(out)), where


def _files(files: DataFrame) -> DataFrame:
    cols = ["session_id", "file_kind", "raw_json"]
    return latest_per_key(files.select("file_id", "saved_ts", *cols), ["file_id"], ["saved_ts"], [*cols, "saved_ts"])


_LISTS = "paths array<string>, types array<string>, `values` array<string>"


def _flat(files: DataFrame) -> DataFrame:
    """(file_id, file_kind, saved_ts, readable, paths, types, values) of held files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["raw_json"]:
                ok, doc = read_document(raw)
                rows.append((ok, *(flatten(doc) if ok else ([], [], []))))
            part = pd.DataFrame(rows, columns=["readable", "paths", "types", "values"], index=pdf.index)
            yield pd.concat([pdf[["file_id", "file_kind", "saved_ts"]], part], axis=1)

    held = files.select("file_id", "file_kind", F.col("saved_ts").cast("timestamp_ntz"), "raw_json")
    return held.mapInPandas(run, f"file_id bigint, file_kind string, saved_ts timestamp_ntz, readable boolean, {_LISTS}")


def _from_maps(held: DataFrame, made, schema: str) -> DataFrame:
    """``made(file_id, file_kind, map)`` rows of each held file in one pass; the map is None for an unreadable text."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fid, kind, raw in zip(pdf["file_id"], pdf["file_kind"], pdf["raw_json"]):
                ok, doc = read_document(raw)
                rows += made(fid, kind, PathMap(*flatten(doc)) if ok else None)
            yield pd.DataFrame(rows, columns=names)

    return held.select("file_id", "file_kind", "raw_json").mapInPandas(run, schema)


def path_maps(files: DataFrame) -> DataFrame:
    """(file_id, file_kind, saved_ts, readable, entries): of each file a map from path (names joined by dots) to the type
    and value as written. Of a repeated file_id the row with the latest saved_ts holds; unreadable texts have no entries.
    Of two paths that read alike with dots the first stands."""
    flat = _flat(_files(files))
    dots = F.transform("paths", lambda p: F.translate(F.substring(p, 2, 1 << 30), STEP, "."))
    pairs = F.arrays_zip(dots.alias("p"), F.col("types").alias("type"), F.col("values").alias("value"))
    first = F.filter(pairs, lambda x, i: F.array_position(dots, x["p"]) == i + 1)
    entries = F.map_from_arrays(F.transform(first, lambda x: x["p"]), F.transform(first, lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))))
    return flat.select("file_id", "file_kind", "saved_ts", "readable", entries.alias("entries"))


def path_statistics(files: DataFrame) -> DataFrame:
    """(file_kind, field_path, json_type, files, first_saved, last_saved): how many files have a path with a type, and when
    they were saved. The document itself is '$'."""
    rows = path_maps(files).filter("readable").select("file_kind", "saved_ts", F.explode("entries").alias("field_path", "entry"))
    path = F.when(F.col("field_path") == "", "$").otherwise(F.col("field_path"))
    return rows.groupBy("file_kind", path.alias("field_path"), F.col("entry.type").alias("json_type")).agg(
        F.count("*").alias("files"), F.min("saved_ts").alias("first_saved"), F.max("saved_ts").alias("last_saved")
    )


def _standard(fields: DataFrame) -> dict[str, dict[str, str]]:
    kinds: dict[str, dict[str, str]] = defaultdict(dict)
    for r in fields.select("file_kind", "field_path", "json_type").collect():
        kinds[r[0]][r[1]] = r[2]
    return dict(kinds)


def field_contents(held: DataFrame, fields: DataFrame) -> DataFrame:
    """(file_kind, field_path, mark, n, share): what the content of each standard field looks like where it stands in its
    own place with its type, and the part of those files that show it; only marks that are typical. ``fields`` is the
    bounded standard (tens of rows)."""
    from pyspark.sql import Window as W

    kinds = _standard(fields)

    def marks_of(fid, kind, file: PathMap | None) -> list[tuple]:
        rows = []
        for path, want in kinds.get(kind, {}).items() if file else ():
            at = STEP + path.replace(".", STEP)
            got = file.types.get(at)
            if got == want or (want == "number" and got == "integer"):
                marks = content_marks(file.value(at), want) if got == "object" or len(file.values[at]) > 256 else known_marks(got, file.values[at], want)
                rows += [(kind, path, m) for m in ("files", *dict.fromkeys(marks))]
        return rows

    marks = _from_maps(held, marks_of, "file_kind string, field_path string, mark string")
    n = marks.groupBy("file_kind", "field_path", "mark").agg(F.count("*").alias("n"))
    of = W.partitionBy("file_kind", "field_path")
    most = n.withColumn("share", F.col("n") / F.max(F.when(F.col("mark") == "files", F.col("n"))).over(of)).filter(f"mark <> 'files' and share >= {TYPICAL_VALUE}")
    return most.withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "mark"))).filter(F.col("rank") <= MARKS).drop("rank")


def _models(held: DataFrame, fields: DataFrame) -> dict[str, Standard]:
    kinds = _standard(fields)
    typical: dict[str, dict[str, dict[str, float]]] = {k: defaultdict(dict) for k in kinds}
    for r in field_contents(held, fields).collect():
        typical[r["file_kind"]][r["field_path"]][r["mark"]] = r["share"]
    return {k: Standard(f, typical[k]) for k, f in kinds.items()}


def schema_drift(files: DataFrame, fields: DataFrame) -> DataFrame:
    """Each file's differences from the standard of its kind: (file_id, field_path, drift_kind).

    Of a repeated file_id the row with the latest saved_ts holds. A null, empty or broken text gives
    (file_id, '$', 'unreadable'). A file whose kind the standard doesn't name gives no row. A document that is not an
    object lacks every top field. An unknown field that is null has no content and is not 'added'.
    """
    held = _files(files)
    models = _models(held, fields)

    def differences(fid, kind, file: PathMap | None) -> list[tuple]:
        if file is None:
            return [(fid, "$", "unreadable")]
        return [(fid, *d) for d in models[kind].compare(file)[0]] if kind in models else []

    return _from_maps(held, differences, "file_id bigint, field_path string, drift_kind string")


def _column(path: str) -> str:
    return re.sub(r"\W+", "_", path)


def cast_text(t: str, v, want: str) -> str | None:
    """What a cast to the standard type reads: scalars as written, wrappers of one scalar unwrapped, lists in any form as a
    JSON array; content that has no such form as it is, so that its cast fails."""
    if v is None:
        return None
    if want in ("array", "object"):
        if want == "array" and t != "array" and leaves(v):
            v = list(v.values()) if isinstance(v, dict) else leaves(v)
        return json.dumps(v, ensure_ascii=False, default=str)
    if t not in ("object", "array"):
        return _written(v)
    flat = leaves(v)
    return flat[0] if len(flat) == 1 else json.dumps(v, ensure_ascii=False, default=str)


#: JSON type of the standard -> Spark type of the consistent table.
SPARK_TYPE = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "array": "string", "object": "string"}
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_WHOLE = r"^-?(0|[1-9][0-9]*)(\.0+)?$"


def typed(text: Column, got: Column, want: str) -> Column:
    """A text as the standard type, by the grammar of JSON; null where it isn't one."""
    if want == "integer":
        return F.when(text.rlike(_WHOLE), F.regexp_replace(text, r"\.0+$", "")).try_cast("bigint")
    if want == "number":
        x = F.when(text.rlike(_JSON_NUMBER), text).try_cast("double")
        return F.when(F.abs(x) < float("inf"), x)
    if want == "boolean":
        return F.when(text.isin("true", "false"), text == "true")
    if want == "array":
        return F.when(text.startswith("["), text)
    return F.when(~got.isin("object", "array") | ~text.rlike(r"^[\[{]"), text)


def consistent_table(files: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a readable file: file_id, file_kind and a typed column for every standard field that isn't an object
    (dots become underscores, arrays stay JSON text), read under its new name where renamed; failed_casts lists the
    fields that have a value which the type can't hold. Columns of other kinds are null; of two kinds with one field
    the type of the first by name holds."""
    held = _files(files)
    models = _models(held, fields)
    wanted: dict[str, str] = {}
    for _, m in sorted(models.items()):
        for p, t in m.types.items():
            if t != "object":
                wanted.setdefault(p, t)

    def placed_values(fid, kind, file: PathMap | None) -> list[tuple]:
        if file is None or kind not in models:
            return []
        where = {f: at for f, at in models[kind].compare(file)[1].items() if models[kind].types[f] != "object"}
        got = [file.types[at] for at in where.values()]
        return [(fid, kind, list(where), got, [cast_text(x, file.value(at), wanted[f]) for (f, at), x in zip(where.items(), got)])]

    placed = _from_maps(held, placed_values, f"file_id bigint, file_kind string, {_LISTS}")
    rows = placed.select("file_id", "file_kind", F.map_from_arrays("paths", F.arrays_zip("types", "values")).alias("e"))
    parts = [(p, t, F.try_element_at("e", F.lit(p))) for p, t in sorted(wanted.items())]
    done = [(p, typed(e["values"], e["types"], t), e["values"]) for p, t, e in parts]
    failed = F.filter(F.array(*[F.when(raw.isNotNull() & value.isNull(), F.lit(p)) for p, value, raw in done]), lambda x: x.isNotNull()) if done else F.array().cast("array<string>")
    return rows.select("file_id", "file_kind", *[value.cast(SPARK_TYPE[wanted[p]]).alias(_column(p)) for p, value, _ in done], failed.alias("failed_casts"))


def drift_summary(files: DataFrame, fields: DataFrame) -> DataFrame:
    """How many files have each difference."""
    return schema_drift(files, fields).groupBy("field_path", "drift_kind").agg(F.count("*").alias("files"))
