"""Groups as runs of sorted rows that pass a task in Arrow batches: a group is a slice of a batch, not a frame and a call of its own."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _edges(table, keys) -> np.ndarray:
    """Rows at which another group begins, the first row aside. Null is a key like any other."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table.column(k)
        none = np.asarray(column.is_null())
        value = np.asarray(column.drop_null()) if none.any() else np.asarray(column)
        if none.any():
            filled = np.empty(len(none), value.dtype)
            filled[~none], filled[none] = value, value[0] if len(value) else 0
            value = filled
        new |= (value[1:] != value[:-1]) | (none[1:] != none[:-1])
    return np.flatnonzero(new) + 1


def whole_groups(batches, keys):
    """Batches of rows sorted by `keys` -> (table of whole groups, where each of them begins, and the end)."""
    held: list[pa.RecordBatch] = []

    def told():
        table = pa.Table.from_batches(held).combine_chunks()
        return table, [0, *_edges(table, keys).tolist(), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch, keys)
        apart = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cut = int(edges[-1]) if len(edges) else 0
        if not apart and not cut:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        yield told()
        held = [batch.slice(cut)]
    if held:
        yield told()


def by_runs(rows: DataFrame, keys: tuple, order: tuple, work, schema) -> DataFrame:
    """work takes (table, starts) of whole groups, rows of a group in `order`, and gives record batches of `schema`."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(lambda batches: (out for table, starts in whole_groups(batches, keys) for out in work(table, starts)), schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return np.asarray(pc.fill_null(pc.cast(table.column(name), pa.float64()), float("nan")))


def arrays(table: pa.Table, name: str):
    """A column of arrays -> function of a row: its array as doubles, None where it is null."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    none = np.asarray(column.is_null())
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))])
    values = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), float("nan")))
    return lambda i: None if none[i] else values[ends[i] : ends[i + 1]]
