"""Vectors in columns: reading, checking, rotating."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(data: list[bytes], kind: type = np.float64) -> np.ndarray:
    """Rows of doubles from the bytes of ``kind``; all have one length."""
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64, copy=False) if data else np.zeros((0, 1))


def read(df: DataFrame, id_col: str, vector_col: str, *others: str, whole: bool = False) -> DataFrame:
    """(id long, others..., dim int, data binary of doubles) of the vectors that take part.

    A row with a null id, or a vector that is null, empty, zero or holds a null or
    non-finite component, is left out; with ``whole`` it stays, with null dim and data.
    """
    fields = [T.StructField("id", T.LongType()), *(df.schema[c] for c in others), T.StructField("dim", T.IntegerType()), T.StructField("data", T.BinaryType())]
    names = [f.name for f in fields]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, data = [], []
            for v in batch.column(1):
                x = np.array(v.as_py() if v.is_valid else [], np.float64)  # a null component becomes NaN
                good = len(x) and np.isfinite(x).all() and x.any()
                dims.append(len(x) if good else None)
                data.append(x.tobytes() if good else None)
            kept = [batch.column(0), *(batch.column(k) for k in range(2, len(batch.columns))), pa.array(dims, pa.int32()), pa.array(data, pa.binary())]
            out = pa.RecordBatch.from_arrays(kept, names=names)
            yield out if whole else out.filter(out.column("data").is_valid())

    source = df.select(F.col(id_col).cast("long").alias("id"), vector_col, *others)
    return (source if whole else source.where("id IS NOT NULL")).mapInArrow(checked, T.StructType(fields))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to between 1/2 and 1: lengths can be taken of any finite vector."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    x = x.copy()
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        a, b = pairs[:, :, 0, :] + pairs[:, :, 1, :], pairs[:, :, 0, :] - pairs[:, :, 1, :]
        pairs[:, :, 0, :], pairs[:, :, 1, :] = a, b
        half *= 2
    return x / np.sqrt(width)


def padded(x: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng(seed).integers(0, 2, (3, x.shape[1])) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s)
    return x
