"""Plumbing that the operators share: sizes, checkpoints, what workers keep, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401  for the operators

#: Words are runs of anything but these bytes: space, and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Seconds after which a worker hands free memory back again.
TRIM = 2.0
#: Bytes from which on a freed array is handed back to the system.
MAPPED = 1 << 20
#: Bytes of input that one partition of the grouped stages should hold.
PART_BYTES = 16 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the input by Catalyst's statistics: file sizes, so no scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions for grouped stages: the session's number, or more if the input asks for it."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(own, size // part_bytes) if size < 1 << 50 else own  # beyond, it is a product that Catalyst guesses for joins


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, as in tests, a folder of our own, if driver
    and executors are one process; an error on a cluster, whose machines would not see each other's files."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="cowlens-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """cut(), with about `rows` rows a partition if there were more partitions than that, and the number of rows: fewer tasks
    and files for what follows."""
    done = cut(df)
    n = done.count()
    return done.coalesce(max(1, -(-n // rows))), n


def cut_rows(df: DataFrame, rows: int = 100_000) -> DataFrame:
    return cut_counted(df, rows)[0]


def cut_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder.

    A checkpoint keeps the constraints of the plan it came from, which grow with each round of an iterative plan until
    the optimiser needs longer than the job; a table read again has none.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(name: str = "doc_id") -> "F.Column":
    return F.crc32(F.col(name).cast("string").cast("binary"))


def least_hashes(ids: DataFrame, sample: int, seed: int) -> list:
    """The `sample` ids (first column) of least hash.

    The rows are counted first and hashes above four times the share that is wanted are left out, so that tasks hand
    the driver about 4 * sample ids together, not `sample` each.
    """
    name = ids.columns[0]
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(name)), 1)
    share = 4 * sample / max(1, ids.count())
    near = ids if share >= 0.5 else ids.where(h < int(share * (1 << 63)))
    return [r[0] for r in near.orderBy(h, name).limit(sample).collect()]


def _return_large() -> None:
    """From now on what is freed of MAPPED bytes or more goes back to the system at once. Else glibc raises that bound to the
    largest array freed so far (32 MB at most), and one small array that lives on keeps all that was freed below it."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 * MAPPED)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_return_large()


def worker_store(name: str, make):
    """State that a Python worker keeps from task to task (caches of pure functions), of one operator at a time.

    What another operator, model or vocabulary has left there is dropped first, so that a pipeline's stages don't add up.
    """
    store = sys.__dict__.setdefault("_cowlens_store", {})
    if name not in store:
        release()
        store[name] = make()
    return store[name]


def release() -> None:
    """Drop what the worker keeps, and hand free memory back, once in TRIM seconds if nothing is kept; operators that keep
    nothing call this as they begin."""
    store, now = sys.__dict__.get("_cowlens_store"), time.monotonic()
    if not store and now < sys.__dict__.get("_cowlens_trimmed", 0.0) + TRIM:
        return
    if store:
        store.clear()
        gc.collect()
    sys.__dict__["_cowlens_trimmed"] = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_pieces(column, most: int = 1 << 20):
    """Cut an Arrow string column into runs of rows of about `most` bytes.

    Yields (first row, last row + 1, bytes as uint8 array, offsets into it). Null counts as empty.
    A single longer text makes a run of its own.
    """
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
