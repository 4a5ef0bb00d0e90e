"""Schemas that drift between files: one consistent table, and every change as a row.

Stages, each a narrow map or an equi-join:

1. every file's text is parsed where it lies (``parse_records``), giving its records as flat path -> value maps;
2. the header schema of a file is the fold of its records' types through the promotion lattice ``PROMOTION``;
3. a file is paired with the file before it in its stream by a window over the light columns (stream, time, id) alone -
   the contents join afterwards by the unique file id, so a stream that holds a third of all rows moves no text into
   one task;
4. ``compare_files`` lists the differences of such a pair in order;
5. ``union_table`` folds all header schemas into one and casts every record to it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The promotion lattice: null is below everything, string holds every plain value, json holds all.
#: A pair that isn't listed joins to the first type that is above both.
PROMOTION = {
    "null": ("boolean", "number", "string", "list", "object", "json"),
    "boolean": ("string", "json"),
    "number": ("string", "json"),
    "string": ("json",),
    "list": ("json",),
    "object": ("json",),
    "json": (),
}
#: Types of the union table's columns.
COLUMN_TYPE = {"null": "string", "boolean": "boolean", "number": "double", "string": "string", "list": "string", "object": "string", "json": "string"}

CHANGES = T.StructType(
    [
        T.StructField("stream_name", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("change_no", T.IntegerType()),
        T.StructField("change", T.StringType()),
        T.StructField("field_path", T.StringType()),
        T.StructField("new_path", T.StringType()),
        T.StructField("old_type", T.StringType()),
        T.StructField("new_type", T.StringType()),
    ]
)


def promote(a: str, b: str) -> str:
    """The least type of the lattice that holds both."""
    if a == b or b in PROMOTION[a]:
        return b
    if a in PROMOTION[b]:
        return a
    return next(t for t in PROMOTION[a] if t in PROMOTION[b])


def value_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "list", dict: "object"}[type(value)]


def parse_records(content: str | None, key: str = "name", wrapper: str = "corpora") -> list[dict] | None:
    """The records of a file in any of its layouts; None where it holds none.

    Layouts: one record, a list of records, an object whose ``wrapper`` member is the list, or one record a line.
    Null, blank and broken contents give None, lines or members that aren't objects are passed over.
    """
    if content is None or not content.strip():
        return None
    try:
        whole = json.loads(content)
        if isinstance(whole, dict) and isinstance(whole.get(wrapper), list):
            whole = whole[wrapper]
        found = whole if isinstance(whole, list) else [whole]
    except ValueError:
        found = []
        for line in content.splitlines():
            try:
                found.append(json.loads(line))
            except ValueError:
                continue
    found = [r for r in found if isinstance(r, dict)]
    return found or None


def flatten(record: dict, prefix: str = "") -> tuple[dict[str, object], set[str]]:
    """(path -> plain value or list, paths of the objects passed through)."""
    leaves: dict[str, object] = {}
    objects: set[str] = set()
    for name, value in record.items():
        path = f"{prefix}{name}"
        if isinstance(value, dict):
            objects.add(path)
            inner, deeper = flatten(value, f"{path}.")
            leaves |= inner
            objects |= deeper
        else:
            leaves[path] = value
    return leaves, objects


def header(records: list[dict], key: str) -> tuple[dict[str, str], set[str], dict[object, dict[str, object]]]:
    """A file's (path -> type, object paths, record key -> leaves)."""
    types: dict[str, str] = {}
    objects: set[str] = set()
    rows: dict[object, dict[str, object]] = {}
    for i, record in enumerate(records):
        leaves, inner = flatten(record)
        objects |= inner
        for path, value in leaves.items():
            types[path] = promote(types.get(path, "null"), value_type(value))
        name = record.get(key)
        rows[name if isinstance(name, (str, int, float)) else ("no key", i)] = leaves
    return types, objects, rows


def _canon(value: object) -> str:
    return json.dumps(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value, sort_keys=True)


def _kept(old: str, new: str, pairs: list[tuple[dict, dict]]) -> bool:
    """Whether every record common to both files has under ``new`` what it had under ``old``."""
    seen = False
    for a, b in pairs:
        if (old in a) != (new in b):
            return False
        if old in a:
            if _canon(a[old]) != _canon(b[new]):
                return False
            seen = True
    return seen


def compare_files(before: list[dict], after: list[dict], key: str = "name") -> list[tuple[str, str, str, str, str]]:
    """The ordered (change, field_path, new_path, old type, new type) between two files of a stream."""
    old, old_objects, old_rows = header(before, key)
    new, new_objects, new_rows = header(after, key)
    changes: list[tuple[str, str, str, str, str]] = []

    def below(path: str, tops: set[str]) -> bool:
        parts = path.split(".")
        return any(".".join(parts[:i]) in tops for i in range(1, len(parts)))

    to_object = {p for p in old if p not in new and p in new_objects}
    from_object = {p for p in new if p not in old and p in old_objects}
    changes += [("type_changed", p, "", old[p], "object") for p in to_object]
    changes += [("type_changed", p, "", "object", new[p]) for p in from_object]
    for p in old:
        if p in new and old[p] != new[p] and "null" not in (old[p], new[p]):
            changes.append(("type_changed", p, "", old[p], new[p]))

    removed = [p for p in old if p not in new and p not in to_object and not below(p, from_object)]
    added = [p for p in new if p not in old and p not in from_object and not below(p, to_object)]
    common = [(old_rows[k], new_rows[k]) for k in old_rows if k in new_rows]
    alike = sorted(
        (-SequenceMatcher(None, p, q).ratio() - (p.rpartition(".")[2] == q.rpartition(".")[2]), p, q)
        for p in removed
        for q in added
        if _kept(p, q, common)
    )
    gone, come = set(removed), set(added)
    for _, p, q in alike:
        if p in gone and q in come:
            gone.discard(p)
            come.discard(q)
            changes.append(("renamed", p, q, old[p], new[q]))
    changes += [("removed", p, "", old[p], "") for p in gone]
    changes += [("added", p, "", "", new[p]) for p in come]
    return sorted(changes, key=lambda c: (c[1], c[0], c[2]))


def latest_delivery(files: DataFrame) -> DataFrame:
    """One row per file id: the first delivery that isn't null or blank.

    A null id or time can't be placed in a stream and is left out.
    """
    told = F.length(F.trim(F.coalesce("content", F.lit("")))) > 0
    return (
        files.filter("file_id IS NOT NULL AND recorded_at IS NOT NULL")
        .select("stream_name", "file_id", "recorded_at", F.struct((~told).alias("blank"), "arrived_at", "content").alias("d"))
        .groupBy("file_id")
        .agg(F.min(F.struct("d.blank", "d.arrived_at", "stream_name", "recorded_at", "d.content")).alias("f"))
        .select("file_id", "f.stream_name", "f.recorded_at", "f.content")
    )


def schema_changes(files: DataFrame, key: str = "name", wrapper: str = "corpora") -> DataFrame:
    """Every change of a field between a file and the file before it in its stream (schema ``CHANGES``).

    ``files`` needs stream_name, file_id, recorded_at, arrived_at and content; other columns are ignored. Defined
    results: re-delivered copies count once; files whose content is null, blank or broken have no schema and are passed
    over, so that the files around them are compared; equal times are ordered by file_id; a null stream name is a stream
    of its own; an empty table gives no rows.
    """
    once = latest_delivery(files)
    light = once.filter(_readable(key, wrapper)("content")).select("stream_name", "file_id", "recorded_at")
    order = Window.partitionBy("stream_name").orderBy("recorded_at", "file_id")
    pairs = light.withColumn("before_id", F.lag("file_id").over(order)).filter("before_id IS NOT NULL").select("stream_name", "file_id", "before_id")
    text = once.select("file_id", "content")
    joined = pairs.join(text.withColumnRenamed("content", "after"), "file_id").join(
        text.select(F.col("file_id").alias("before_id"), F.col("content").alias("before")), "before_id"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, file_id, before, after in zip(batch["stream_name"], batch["file_id"], batch["before"], batch["after"], strict=True):
                found = compare_files(parse_records(before, key, wrapper), parse_records(after, key, wrapper), key)
                out += [(stream, file_id, i, *c) for i, c in enumerate(found)]
            yield pd.DataFrame(out, columns=CHANGES.names)

    return joined.select("stream_name", "file_id", "before", "after").mapInPandas(run, CHANGES)


def _readable(key: str, wrapper: str):
    @F.pandas_udf("boolean")
    def readable(content: pd.Series) -> pd.Series:
        return content.map(lambda c: parse_records(c, key, wrapper) is not None).astype(bool)

    return readable


def flat_records(files: DataFrame, key: str = "name", wrapper: str = "corpora") -> DataFrame:
    """One row per record: stream_name, file_id, recorded_at, rec_no, rec_key, fields (path -> JSON of the value), types."""
    schema = T.StructType(
        [
            T.StructField("stream_name", T.StringType()),
            T.StructField("file_id", T.LongType()),
            T.StructField("recorded_at", T.TimestampNTZType()),
            T.StructField("rec_no", T.IntegerType()),
            T.StructField("rec_key", T.StringType()),
            T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
            T.StructField("types", T.MapType(T.StringType(), T.StringType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, file_id, at, content in zip(batch["stream_name"], batch["file_id"], batch["recorded_at"], batch["content"], strict=True):
                for i, record in enumerate(parse_records(content, key, wrapper) or []):
                    leaves, _ = flatten(record)
                    text = {p: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for p, v in leaves.items()}
                    name = record.get(key)
                    out.append((stream, file_id, at, i, None if name is None else str(name), text, {p: value_type(v) for p, v in leaves.items()}))
            yield pd.DataFrame(out, columns=schema.names)

    source = latest_delivery(files).select("stream_name", "file_id", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "content")
    return source.mapInPandas(run, schema)


def union_schema(records: DataFrame) -> DataFrame:
    """field_path, field_type, n_files: all header schemas folded through the lattice."""
    seen = records.select("file_id", F.explode("types").alias("field_path", "t")).groupBy("field_path", "t").agg(F.countDistinct("file_id").alias("n"))
    kinds = seen.groupBy("field_path").agg(F.collect_set("t").alias("ts"), F.max("n").alias("n_files"))  # at most one entry a lattice type
    return kinds.select("field_path", _fold_type(F.col("ts")).alias("field_type"), "n_files")


def _fold_type(kinds: Column) -> Column:
    """The lattice fold of an array of type names, as a built-in expression."""
    real = F.array_except(kinds, F.array(F.lit("null")))
    plain = F.size(F.array_except(real, F.array(*map(F.lit, ("boolean", "number", "string"))))) == 0
    return F.when(F.size(real) == 0, "null").when(F.size(real) == 1, real[0]).when(plain, "string").otherwise("json")


def rename_map(changes: DataFrame, max_fields: int = 10_000) -> dict[str, str]:
    """Old path -> the path that stands for it in the union table.

    The distinct renames are at most the square of the distinct fields, whose number ``max_fields`` bounds by an error.
    """
    edges = changes.filter("change = 'renamed'").groupBy("field_path", "new_path").count().limit(max_fields + 1).collect()
    if len(edges) > max_fields:
        raise ValueError(f"more than {max_fields} distinct renames")
    root: dict[str, str] = {}

    def find(p: str) -> str:
        while root.get(p, p) != p:
            p = root[p]
        return p

    weight: dict[str, int] = {}
    for e in edges:
        weight[e["new_path"]] = weight.get(e["new_path"], 0) + e["count"]
    for e in sorted(edges, key=lambda e: (-e["count"], e["field_path"], e["new_path"])):
        a, b = find(e["field_path"]), find(e["new_path"])
        if a != b:
            keep, drop = sorted((a, b), key=lambda p: (-weight.get(p, 0), p))
            root[drop] = keep
    return {p: find(p) for p in {x for e in edges for x in (e["field_path"], e["new_path"])} if find(p) != p}


def union_table(files: DataFrame, key: str = "name", wrapper: str = "corpora", max_fields: int = 10_000) -> DataFrame:
    """Every record of every file under the one union schema; renamed fields share a column, columns are named by path.

    Values that don't fit their column's type become null; the number of fields is bounded by ``max_fields`` (an error).
    """
    records = flat_records(files, key, wrapper)
    names = rename_map(schema_changes(files, key, wrapper), max_fields)
    fields = union_schema(records).limit(max_fields + 1).collect()
    if len(fields) > max_fields:
        raise ValueError(f"more than {max_fields} fields")
    types: dict[str, str] = {}
    sources: dict[str, list[str]] = {}
    for f in sorted(fields, key=lambda f: f["field_path"]):
        to = names.get(f["field_path"], f["field_path"])
        types[to] = promote(types.get(to, "null"), f["field_type"])
        sources.setdefault(to, []).append(f["field_path"])
    columns = []
    for to in sorted(types):
        value = F.coalesce(*[F.col("fields")[p] for p in sorted(sources[to], key=lambda p: (p != to, p))])
        columns.append(value.try_cast(COLUMN_TYPE[types[to]]).alias(to.replace(".", "__")))
    return records.select("stream_name", "file_id", "recorded_at", "rec_no", "rec_key", *columns)
