"""Shuffles packed arrays: mappers emit (part, body) rows of whole columns, reducers get all bodies of a part.

A row of a shuffle then holds thousands of values, without the cost of a JVM row for each. A value's part is
the range of its 64-bit hash, so parts are even whatever the keys are; callers pre-aggregate hot keys in the mapper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.textarrays import release

BLOB = "part int, body binary"
_BLOB = pa.schema([("part", pa.int32()), ("body", pa.binary())])


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of the hash's top 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def pack(columns: Sequence[np.ndarray]) -> bytes:
    n = np.array([len(columns[0])], np.int64)
    return b"".join([n.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(body, dtypes: Sequence) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        out.append(np.frombuffer(body, d, n, at))
        at += n * d.itemsize
    return out


def blobs(part: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each part that has values."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    columns = [c[order] for c in columns]
    at = [0, *cuts.tolist(), len(part)]
    yield pa.RecordBatch.from_arrays([pa.array(part[np.array(at[:-1])], pa.int32()), pa.array([pack([c[a:b] for c in columns]) for a, b in zip(at, at[1:])], pa.binary())], schema=_BLOB)


def deal(df: DataFrame, parts: int) -> DataFrame:
    """Part k in partition k: the part number itself deals the rows, it is not hashed again, so no two parts share a task."""
    return df.repartitionById(parts, F.col("part"))


def reduce(df: DataFrame, parts: int, dtypes: Sequence, fn: Callable[[int, list[np.ndarray]], pa.Table], schema) -> DataFrame:
    """fn(part, columns) of each part; fn returns a table of ``schema``."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            part = batches[0].column("part")[0].as_py()
            got = [unpack(memoryview(x.as_buffer()), dtypes) for b in batches for x in b.column("body")]
            yield from fn(part, [np.concatenate(c) for c in zip(*got)]).to_batches(max_chunksize=10_000)
        release()

    return deal(df, parts).mapInArrow(run, schema)
