"""Arrow plumbing: columns in, columns out, one worker-wide object built once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_built: dict = {}
#: Characters, bytes and list members that a batch of results holds at most, beyond its last row.
MAX_SIZE = 16_000_000


def once(key: object, build: Callable[[], object]) -> object:
    """``build()`` of this worker process, made at its first use."""
    if key not in _built:
        _built[key] = build()
    return _built[key]


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: T.StructType, max_rows: int = 20_000) -> DataFrame:
    """``df`` -> rows of ``schema``; ``make()`` gives the function of a batch's columns (as lists) that yields tuples."""
    kinds = [f.type for f in to_arrow_schema(schema)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for row in work(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                for x in row:
                    if type(x) in (str, bytes, list):
                        size += len(x)
                if len(rows) >= max_rows or size >= MAX_SIZE:
                    yield _batch(rows, kinds, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds, names)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)
