"""Codecs and hashes that Spark has no function for, as Arrow-batched UDFs. Errors are data: struct(bytes, error)."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFLATE, ZSTD = 0, 1
# Types as objects: DDL strings would need a session when this module is imported.
_RESULT = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])
_STATISTICS = T.StructType([T.StructField("zeros", T.LongType()), T.StructField("distinct_bytes", T.IntegerType()), T.StructField("longest_run", T.LongType())])


def compress(data: bytes, kind: int = DEFLATE, level: int | None = None) -> bytes:
    """Raw deflate (window of 4 KiB, as the format asks) or a zstd frame."""
    if kind == DEFLATE:
        c = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, -12)
        return c.compress(data) + c.flush()
    import zstandard

    return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)


def decompress(data: bytes, size: int, kind: int = DEFLATE) -> bytes:
    """Exactly `size` bytes from the start of data; what follows the stream is padding."""
    if kind == DEFLATE:
        out = zlib.decompressobj(-15).decompress(data, size)
    else:
        import zstandard

        out = zstandard.ZstdDecompressor().decompressobj().decompress(data)[:size]
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return out


@F.pandas_udf(_RESULT)
def _inflate(data: pd.Series, size: pd.Series, kind: pd.Series) -> pd.DataFrame:
    out, errors = [], []
    for d, n, k in zip(data, size, kind, strict=True):
        try:
            out.append(None if d is None else decompress(bytes(d), int(n), int(k)))
            errors.append(None)
        except Exception as e:  # noqa: BLE001  any damage of the stream is a result
            out.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pd.DataFrame({"bytes": out, "error": errors})


def inflate(data: Column, size: Column | int, kind: Column | int = DEFLATE) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return _inflate(data, as_col(size).cast("long"), as_col(kind).cast("int"))


@F.pandas_udf(T.BinaryType())
def _pack(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else compress(bytes(d), int(k)) for d, k in zip(data, kind, strict=True)])


def packed(data: Column, kind: int = DEFLATE) -> Column:
    """Compressed bytes."""
    return _pack(data, F.lit(kind))


def is_zero(data: Column) -> Column:
    """Whether all bytes are zero (also of no bytes), without leaving the JVM."""
    return F.rtrim(F.hex(data), F.lit("0")) == ""


@F.pandas_udf(_STATISTICS)
def byte_statistics(data: pd.Series) -> pd.DataFrame:
    """Zero bytes, distinct bytes and the longest run of one byte."""
    import numpy as np

    rows = []
    for d in data:
        x = np.frombuffer(bytes(d) if d is not None else b"", np.uint8)
        edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, int)
        rows.append((int((x == 0).sum()), len(np.unique(x)), int(np.diff(edge).max(initial=0))))
    return pd.DataFrame(rows, columns=["zeros", "distinct_bytes", "longest_run"])


@F.pandas_udf(T.BinaryType())
def _blake3(data: pd.Series, size: pd.Series) -> pd.Series:
    from .blake3 import blake3

    return pd.Series([None if d is None else blake3(bytes(d), int(n)) for d, n in zip(data, size, strict=True)])


def blake3_hash(data: Column, size: int = 32) -> Column:
    return _blake3(data, F.lit(size))
