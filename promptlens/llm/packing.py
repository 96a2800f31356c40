"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Lengths are whole numbers up to the sequence length, so pieces of one length
are interchangeable, and so are open bins of one remaining capacity.  The
packing is therefore done exactly, for any number of documents, on counts:
a segment tree over the remaining capacities finds the tightest open bin in
logarithmic time, and one step places a whole run of equal pieces the way
best-fit decreasing would place them one by one.  The driver holds one count
per length and the runs; each bin at least halves its remaining capacity
whenever it is filled further, so there are at most about 40 runs for each
unit of the sequence length, whatever the number of documents.

Tokenization, numbering and placing are distributed: pieces of one length get
their numbers from per-part counts and a running sum, never from a sort of
all rows.  Defined cases: null text is empty (its sequence is the end id
alone); rows that repeat are packed as often as they stand there; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import stash, steps, text_of

SEQUENCE = 1024
END_ID = 2

_ENCODERS: dict[tuple[str, str, bool], object] = {}
#: Letters and spaces whose classes no version of Unicode has changed; for others only the tokenizer file's own library decides.
_PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa0-ɏ]*")
#: The faster library's patterns overflow its stack on white space of about a million characters; a run of this many goes to the other, which gives the same ids.
_LONG_SPACE = re.compile(r"\s{1000}")


class Encoder:
    """Ids of the byte-level BPE, as little-endian unsigned 32-bit bytes.

    Both files hold one vocabulary.  Texts of plain characters go through the
    faster library, all others through the one that the JSON file is made for.
    With ``added`` the file's added tokens are found in texts, as its library
    does by default; without, they are read as plain text.
    """

    def __init__(self, json_path: str, ranks_path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = not added
        self.marks = [t.content for t in self.slow.get_added_tokens_decoder().values()] if added else []
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not _LONG_SPACE.search(text) and not any(m in text for m in self.marks):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(json_path: str, ranks_path: str, added: bool = False) -> Encoder:
    key = (json_path, ranks_path, added)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class TightestBin:
    """A segment tree over capacities 1..size; leaf c counts the open bins with exactly c left."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size).bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open bin has."""
        at = self.leaves + need
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Runs (length, first, pieces, bin, per_bin, offset): pieces ``first ..`` of a length go ``per_bin`` to each of successive bins from ``bin``, the first at ``offset``."""
    tree, open_bins = TightestBin(size), {}  # capacity -> [(first bin, bins)]
    runs, next_bin = [], 0

    def leave(capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            open_bins.setdefault(capacity, []).append((first, bins))
            tree.add(capacity, bins)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length) or size
            if capacity == size:
                first, bins = next_bin, -(-left // (size // length))
                next_bin += bins
            else:
                first, bins = open_bins[capacity].pop()
                tree.add(capacity, -bins)
            each = capacity // length
            full, rest = min(bins, left // each), 0
            if full < bins and left > full * each:
                rest = left - full * each
            for at, n, per in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if n:
                    runs.append((length, done, n * per, at, per, size - capacity))
                    leave(capacity - per * length, at, n)
                    done, left = done + n * per, left - n * per
            used = full + (1 if rest else 0)
            if capacity != size:
                leave(capacity, first + used, bins - used)
    return pd.DataFrame(runs, columns=["length", "first", "pieces", "bin", "per_bin", "offset"], dtype="int64")


def pieces(docs: DataFrame, json_path: str, ranks_path: str, size: int = SEQUENCE, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: every piece, numbered among the pieces of its length in its part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(json_path, ranks_path, added), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4")
        for batch in steps(batches, "text"):
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text), tail])
                at = 0
                for k in range(-(-len(ids) // size)):
                    n = (len(ids) - 1) % size + 1 if k == 0 else size
                    doc.append(doc_id), piece.append(k), start.append(at), length.append(n), nth.append(int(seen[n]))
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    seen[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(doc), pa.int32()), (nth, pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, json_path: str, ranks_path: str, size: int = SEQUENCE, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    table = stash(pieces(docs, json_path, ranks_path, size, end_id, added), "pieces")
    per_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    runs = best_fit_decreasing(counts, size)
    if len(runs) > 64 * size:
        raise AssertionError("more runs than the halving of capacities allows")
    by_length = {int(k): g[["first", "bin", "per_bin", "offset"]].to_numpy() for k, g in runs.groupby("length")}
    held = docs.sparkSession.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                run, at = held.value[int(n)], np.flatnonzero(length == n)
                r = run[np.searchsorted(run[:, 0], number[at], "right") - 1]
                k = number[at] - r[:, 0]
                sequence[at], offset[at] = r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = table.join(before.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
