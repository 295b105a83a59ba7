"""Small Arrow helpers shared by the operators that work on text in Python tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Texts are handed to the per-batch code in slices of about this many characters.
SLICE_CHARS = 2_000_000


def give_back() -> None:
    """Return what a task has freed to the system: workers live on between tasks, and would keep the most that they ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The batch as lists of strings (null: empty), each of about ``limit`` characters at most.

    A text longer than the limit makes a slice of its own and stays whole.
    """
    part: list[str] = []
    size = 0
    for value in texts:
        text = value.as_py() or ""
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def map_slices(df: DataFrame, cols: str | tuple[str, ...], fields: T.StructType, make: Callable[[], Callable[..., list[pa.Array]]], drop: tuple[str, ...] = (), limit: int = SLICE_CHARS) -> DataFrame:
    """``df`` with ``fields`` added, computed by Arrow slices of columns, of which the first holds texts or lists.

    Unlike with a scalar function the results leave the worker slice by slice, so
    its memory follows ``limit`` (bytes of text or list items) and the largest
    value, not a whole batch.  ``make`` runs once in each task and makes a function
    from one array for each of ``cols`` to one for each of ``fields``.  Input columns that
    are named like a new one, or in ``drop``, are left out.
    """
    taken = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken]
    cols = (cols,) if isinstance(cols, str) else cols
    n = len(cols)
    source = df.select(*keep, *(F.col(c).alias(f"__value_{i}") for i, c in enumerate(cols)))
    schema = T.StructType([*source.schema.fields[:-n], *fields.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            values = batch.column(batch.num_columns - n)
            size = pc.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length
            ends = np.cumsum(pc.fill_null(size(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-n], *work(*part.columns[-n:])], names)
                start = stop
        del work
        give_back()

    return source.mapInArrow(run, schema)


def int_lists(flat: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.Array:
    """A list array whose rows take ``lengths`` values each from ``flat``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def with_struct(df: DataFrame, value: Column, fields: T.StructType, rename: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the fields of a struct column added as columns.

    An input column of the same name (in Spark's case-insensitive sense) is
    replaced, as ``withColumn`` does, so clashing extra columns are no error.
    """
    names = {f.name: (rename or {}).get(f.name, f.name) for f in fields}
    taken = {n.lower() for n in names.values()}
    keep = [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken]
    hidden = "__struct_of_" + "_".join(names)
    return df.select(*keep, value.alias(hidden)).select(*keep, *(F.col(hidden)[k].alias(v) for k, v in names.items()))


def cut_out(text: str, spans: list[tuple[int, int]], by: str) -> str:
    """``text`` with every stretch of sorted ``spans`` replaced, overlapping ones as one; pieces are cut once from left to right."""
    at, pieces = 0, []
    for a, b in spans:
        if a >= at:
            pieces += [text[at:a], by]
        at = max(at, b)
    return "".join([*pieces, text[at:]]) if pieces else text


def replaced(text: Column, spans: Column, by: str) -> Column:
    """``text`` with every stretch that ``spans`` (structs whose last two fields are places in code points) cover replaced by ``by``."""

    @F.arrow_udf(T.StringType())
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, rows in batches:
            yield pa.array([None if not t.is_valid else cut_out(t.as_py(), sorted(tuple(s.values())[-2:] for s in r.as_py() or []), by) for t, r in zip(texts, rows)], pa.string())
        give_back()

    return cut(text, spans)
