"""Helpers shared by the corpus operators: stashed tables, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; its temporaries are about 80 times as large.
STEP_BYTES = 1 << 20
#: The same where a worker shares an executor's memory with shuffles and sorts.
SMALL_STEP = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where that is unset a temporary one, but only if everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="promptlens-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows restarts from the files when an
    executor is lost, and Python stages before it run once only.  The shuffle
    files behind it go at once: Spark deletes them when the driver's garbage is
    collected, which a driver with little to do hardly does by itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more: what was made of it is stashed itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give what this Python has freed back to the system, as far as the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text"):
    """128 bits of SHA-256 of the text; equal texts and no others share it."""
    return F.unhex(F.substring(F.sha2(text_of(column).cast("binary"), 256), 1, 32))


def bytes_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes in ``column``; a longer row stands alone.

    At the end freed memory goes back to the system: a worker that waits for its next task would keep it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch
    release_memory()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``least`` rows or more that cut no run of equal ``keys``, and where the runs start; the rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) < least:
                continue
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            value = table.column(k).to_numpy()
            change[1:] |= value[1:] != value[:-1]
        starts = np.flatnonzero(change)
        if batch is None:
            yield table, starts
        elif len(starts) > 1:  # the last run may go on
            yield table.slice(0, starts[-1]), starts[:-1]
            held = table.slice(starts[-1]).to_batches()
        else:
            held = table.to_batches()
    release_memory()


def binaries(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows ``data[start : start + length]`` as a binary array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every place of the spans, one span after the other."""
    until = np.cumsum(lengths)
    return np.repeat(starts - (until - lengths), lengths) + np.arange(until[-1] if len(until) else 0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i up to n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        n = max(1 << n.bit_length(), SMALL_STEP)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = have = (both[0], both[1])
    return have


class Rolling:
    """Polynomial hashes of any run of an array of whole numbers, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        self.power, self.inverse = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of each k bytes that stand together."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class HashIndex:
    """Sorted 64-bit hashes; ``starts`` leads from a hash's first bits to the few that begin with them."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max(2 * len(hashes), 2).bit_length(), 22)
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are here, rising; their places)."""
        first = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[first], self.starts[first + 1]
        found, left = np.full(len(hashes), -1, np.int32), np.flatnonzero(at < end)
        at, end, hashes = at[left], end[left], hashes[left]
        while len(left):
            hit = self.hashes[at] == hashes
            found[left[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            left, at, end, hashes = left[more], at[more] + 1, end[more], hashes[more]
        some = np.flatnonzero(found >= 0)
        return some, found[some]
