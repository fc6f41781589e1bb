"""Rules that depend on what was taken before, group by group: many small groups to a Python call, rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 20_000


def walk(df: DataFrame, by: list[str], order: list[str], rule: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """rule(rows) for each group of `by`, its rows as dicts in the given order; what it yields are rows of schema.

    Groups lie side by side in sorted partitions, so a call takes as many as its batch holds, and
    only one group that spans batches is held over.
    """
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    key = itemgetter(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            groups = [list(g) for _, g in groupby(batch.to_pylist(), key)]
            if held and groups and key(held[0]) == key(groups[0][0]):
                groups[0] = held + groups[0]
            elif held:
                groups.insert(0, held)
            held = groups.pop() if groups else held
            for g in groups:
                out += rule(g)
                if len(out) > ROWS:
                    yield made()
                    out.clear()
        if held:
            out += rule(held)
        if out:
            yield made()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def changes(rows: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where a group of rows side by side begins."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in by:
        codes = pc.fill_null(rows.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a group ends, for rules over columns; one group that spans batches is held over."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def key(batch: pa.RecordBatch, i: int) -> list:
        return [batch.column(c)[i].as_py() for c in by]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(changes(batch, by))[-1])
        if held and not last and key(held[-1], 0) == key(batch, 0):
            held.append(batch)
            continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield joined()
        held = [batch.slice(last)]
    if held:
        yield joined()
