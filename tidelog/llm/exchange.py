"""Rows of packed arrays that meet by slice of a table or by bucket of a key.

A row has a slice, a bucket and four binary fields whose meaning its operator gives. A few large rows stand for many small ones, so that shuffles
handle bytes, not rows, and arrays are worked on as arrays. A negative bucket marks a slice's own row, which sorts before what is said about it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "slice long, bucket long, a binary, b binary, c binary, d binary"
NAMES = ["slice", "bucket", "a", "b", "c", "d"]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


SMALL = 512


def planes(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well where the leading bytes agree. Longer ones are compressed; the first byte says so."""
    data = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return b"\0" + data if len(data) < SMALL else b"\1" + len(data).to_bytes(8, "little") + packed(data)


def unplanes(x: bytes) -> np.ndarray:
    data = np.frombuffer(x, np.uint8)[1:] if x[0] == 0 else unpacked(x[9:], int.from_bytes(x[1:9], "little"))
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<i8").ravel()


def packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)


def rows_out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def grouped(batches, key: str):
    """Lists of rows with an equal key, which lie together."""
    group, here = [], None
    for batch in batches:
        columns = [batch.column(n) for n in NAMES]
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(NAMES, columns, strict=True)}
            if row[key] != here and group:
                yield group
                group = []
            here = row[key]
            group.append(row)
        pa.default_memory_pool().release_unused()
    if group:
        yield group


def meet(rows: DataFrame, key: str, then: str, work, schema: str = ROWS) -> DataFrame:
    """Bring rows of one key together and hand them over group by group: a slice with what is said about it, or a bucket."""

    def run(batches):
        for group in grouped(batches, key):
            yield from work(group)

    return rows.repartition(key).sortWithinPartitions(key, then).mapInArrow(run, schema)
