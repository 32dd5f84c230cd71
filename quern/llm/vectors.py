"""Vectors of items: validity, unit length, binary form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (modality, column, dimensions) of item_features.
MODALITIES = (("image", "image_feat", 96), ("text", "text_feat", 64))


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row indices, unit vectors as float32) of the valid lists of ``column``.

    Valid: not null, of ``dim`` finite non-null numbers, not all zero.
    """
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x)])


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind).reshape(n, -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes; equal rows have equal keys."""
    words = np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64)
    factors = np.random.default_rng(11).integers(1, 1 << 63, words.shape[1], dtype=np.int64).view(np.uint64) | np.uint64(1)
    return mixed((mixed(words + np.uint64(1)) * factors).sum(1, dtype=np.uint64)).view(np.int64)


def unit_vectors(df: DataFrame, item: str, modalities: tuple = MODALITIES) -> DataFrame:
    """(m, item_id, x): the valid vectors of each modality as binary float32 rows of unit length; m is the modality's index. Rows with a null item are left out."""
    columns = [c for _, c, _ in modalities]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, (_, _, dim) in enumerate(modalities):
                rows, x = unit_rows(b.column(m + 1), dim)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), m, np.int32)), b.column(0).take(pa.array(rows)), packed(x)], names=["m", "item_id", "x"])

    source = df.filter(f"`{item}` is not null").selectExpr(f"cast(`{item}` as bigint) item_id", *[f"`{c}`" for c in columns])
    return source.mapInArrow(run, "m int, item_id bigint, x binary")
