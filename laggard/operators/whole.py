"""Keys that fit a task, handled whole in one sorted scan, beside the few that do not.

Most streams are short.  What a long one needs (blocks, histograms, offsets, joins back) costs each row several shuffles; a short one is
sent once and handled as arrays, many keys at a time.  ``by_length`` parts them by a count, so that no task ever holds more than
``WHOLE`` rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key up to which a task handles it whole.
WHOLE = 1 << 18
#: Rows that are handled together, if keys are shorter.
TOGETHER = 1 << 15


def by_length(df: DataFrame, keys: Sequence[str], limit: int = WHOLE) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of keys with up to ``limit`` rows, those of longer keys, those with a null in their key (None: there are none).  The longer
    keys are one for ``limit`` rows at most, so their names go to every task."""
    keys = list(keys)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    other = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > limit) | null).select(*keys).checkpoint()
    long = other.where(~null)
    rest = df.where(null) if not other.where(null).isEmpty() else None
    df = df.where(~null)
    if long.isEmpty():
        return df, None, rest
    return df.join(F.broadcast(long), keys, "left_anti"), df.join(F.broadcast(long), keys, "left_semi"), rest


def starts_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row of the sorted table is the first of its key."""
    first = np.ones(table.num_rows, dtype=bool)
    if table.num_rows:
        first[1:] = False
        for k in keys:
            c = table.column(k).combine_chunks()
            first[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return first


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = TOGETHER) -> Iterator[pa.Table]:
    """The sorted rows again, in tables of whole keys."""
    held, n, goal = [], 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= goal:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(starts_of(table, keys))[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n -= cut
            goal = max(least, 2 * n)  # a long key is not put together at each batch
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def dense(column: pa.ChunkedArray) -> np.ndarray:
    """Dense ranks from 0 in Spark's order: nulls first, NaN last, 0.0 and -0.0 one value."""
    valid = column.is_valid().to_numpy()
    out = np.zeros(len(column), np.int64)
    out[valid] = np.unique(column.drop_null().to_numpy(), return_inverse=True)[1] + (0 if valid.all() else 1)
    return out


def added(table: pa.Table, keep: Sequence[str], **columns) -> Iterator[pa.RecordBatch]:
    """Batches of ``keep`` and further columns."""
    yield from pa.table([*[table.column(c) for c in keep], *[pa.array(a) if isinstance(a, np.ndarray) else a for a in columns.values()]], [*keep, *columns]).to_batches()


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of arrays of one width as a matrix; null cells are NaN, so are the cells of null arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(column), width), np.nan)
    out[~column.is_null().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def column_of(values: np.ndarray, gap: np.ndarray | None = None) -> pa.ListArray:
    """The matrix as a column of arrays, null where ``gap``."""
    n, p = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * p, p), pa.int32()), pa.array(values.ravel(), mask=None if gap is None else gap.ravel()))
