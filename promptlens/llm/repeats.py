"""Removal of long byte strings that occur more than once in the collection.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else goes; strings are compared byte by byte.

How it is done.  A column-wise suffix ordering of whole documents needs as
many sequential passes over the collection as its longest document has bytes
(123,000 in the test tables), so the documents are first cut into short,
aligned pieces that can only match each other:

1. In each window of ``length`` bytes the least hash of its ``GRAM``-byte
   grams (the leftmost one) is the window's anchor.  Equal windows have equal
   anchors at equal offsets, so windows that could match meet at one anchor.
2. Anchors that occur once are dropped (a grouped count, over all documents).
3. For the others the bytes of their windows are sent to the anchor's group,
   and there the column-wise construction runs: all pieces of all groups of a
   task advance together, one symbol each per round; every round re-sorts the
   pieces stably by that symbol (the collection's positional Burrows-Wheeler
   order) and updates the common lengths between neighbours.  A window is
   repeated when its piece and a neighbour agree on ``length`` symbols.
4. Anchors that occur more than ``hot`` times skip that step: their windows
   are counted by two independent 64-bit hashes with partial aggregation, so
   no task ever gathers a hot group.

Identical texts are folded before step 3 and only travel once.  Defined cases:
null text is empty; an empty or short text keeps everything; rows that repeat
are copies of each other, so all of their bytes go if the text has at least
``length`` bytes; ids may be null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import SMALL_STEP, Rolling, binaries, bytes_view, release_memory, stash, steps, text_key, text_of

LENGTH = 200
GRAM = 32
HOT = 20_000
#: Pieces that one run of the column-wise construction takes, beyond what the last group needs.
TOGETHER = 4_000
_PLACE = np.uint64((1 << 26) - 1)
_FAR = 1 << 25


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that stand together (block-wise running minima)."""
    n = len(values)
    m = -(-n // w) * w
    blocks = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, windows, anchor, hash) of each run of windows with one anchor; places count from the row's start."""
    parts, most = [], _FAR
    for base in range(0, max(len(data), 1), most):  # only a single text of over 32 MB takes more than one turn
        part = data[base : base + most + length - 1]
        if len(part) < length:
            break
        h = Rolling(part).grams(gram)
        least = sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        size = np.diff(at)
        # Windows stay inside their row.
        first, last = np.maximum(at[:-1], base), np.minimum(at[1:] - length, base + min(most, len(least)) - 1)
        rows = np.flatnonzero((size >= length) & (last >= first))
        if not len(rows):
            continue
        n = last[rows] - first[rows] + 1
        start = np.concatenate([[0], np.cumsum(n)])
        window = np.arange(start[-1]) + np.repeat(first[rows] - start[:-1], n)
        anchor = (least[window - base] & _PLACE).astype(np.int64)
        cut = np.ones(len(window), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        runs = np.flatnonzero(cut)
        row = rows[np.searchsorted(start, runs, "right") - 1]
        a = anchor[runs]
        parts.append((row, window[runs] - at[row], np.diff(np.append(runs, len(window))), a + base - at[row], h[a].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def repeated_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each piece occur in another piece of its group at the same place from the anchor.

    Pieces are ``data[start : start + size]`` with their anchor at ``anchor``,
    ordered by group.  Row i, column s of the result: the window at s of piece i.
    """
    n, low = len(start), int(anchor.max())
    columns = low + int((size - anchor).max())
    symbol = np.full((columns, n), 256, np.int16)
    ends = np.cumsum(size)
    piece = np.repeat(np.arange(n), size)
    inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
    symbol[inner - anchor[piece] + low, piece] = data[start[piece] + inner]
    found = np.zeros((n, int(size.max()) - length + 1), bool)
    block = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) * 512
    order, since = np.arange(n), np.zeros(n + 1, np.int64)  # since[j]: where the match of order[j] with order[j - 1] begins
    for c in range(columns):
        key = block + symbol[c][order]
        moved = bool((key[1:] < key[:-1]).any())
        by = np.argsort(key, kind="stable") if moved else None
        if moved:
            key, order = key[by], order[by]
        same = (key[1:] == key[:-1]) & (key[1:] & 511 != 256)
        now = np.full(n + 1, c + 1, np.int64)
        at = np.flatnonzero(same) + 1
        if moved:
            before, here = by[at - 1], by[at]
            now[at] = since[here]
            far = here > before + 1
            if far.any():
                span = np.stack([before[far] + 1, here[far] + 1], axis=1).ravel()
                now[at[far]] = np.maximum.reduceat(since, span)[::2]
        else:
            now[at] = since[at]
        since = now
        hit = at[c + 1 - now[at] >= length]
        if len(hit):
            for who in (order[hit], order[hit - 1]):
                found[who, c - length + 1 - low + anchor[who]] = True
    return found


def _spread(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of each run of true values in the rows."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    turn = np.diff(padded, axis=1)
    row, first = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    return row, first, end


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by anchor; whole groups are compared together."""
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            group = rows.column("h").to_numpy()
            many = np.ones(len(group), bool)
            many[0] = False
            many[1:] = group[1:] == group[:-1]
            keep = many.copy()
            keep[:-1] |= many[1:]
            rows = rows.filter(pa.array(keep))
            names = ["key", "lo", "hi"]
            if not rows.num_rows:
                return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int64())], names)
            data, at = bytes_view(rows.column("body"))
            found = repeated_windows(data, at[:-1], np.diff(at), rows.column("off").to_numpy().astype(np.int64), rows.column("h").to_numpy(), length)
            found[rows.column("whole").to_numpy(zero_copy_only=False)] = False
            row, first, end = _spread(found)
            first_window = rows.column("p0").to_numpy()[row]
            key = rows.column("key").combine_chunks().take(pa.array(row)).cast(pa.binary())
            return pa.RecordBatch.from_arrays([key, pa.array(first_window + first), pa.array(first_window + end - 1 + length)], names)

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= TOGETHER:
                rows = pa.Table.from_batches(held)
                group = rows.column("h").to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    for a, b in _blocks(group[:cut]):
                        yield flush(rows.slice(a, b - a))
                    rows = rows.slice(cut)
                held, waiting = rows.to_batches(), rows.num_rows
        if waiting:
            rows = pa.Table.from_batches(held)
            for a, b in _blocks(rows.column("h").to_numpy()):
                yield flush(rows.slice(a, b - a))
        held, rows = [], None
        release_memory()

    return compare


def _blocks(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut ordered groups into blocks of about TOGETHER rows without cutting a group."""
    at = 0
    while at < len(group):
        end = min(at + TOGETHER, len(group))
        end = len(group) if end == len(group) else int(np.searchsorted(group, group[end - 1], "right"))
        yield at, end
        at = end


def _runs_of(batch: pa.RecordBatch):
    data, at = bytes_view(batch.column("text"))
    runs = batch.column("runs")
    n = runs.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    flat = runs.flatten()
    p0, cnt, pos, h = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("p0", "cnt", "pos", "h"))
    return data, at[row] + p0, row, p0, cnt, pos, h


def _anchored(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", SMALL_STEP):
            row, p0, cnt, pos, h = anchors(*bytes_view(batch.column("text")), length)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("key").take(pa.array(row)).cast(pa.binary()), pa.array(p0), pa.array(cnt.astype(np.int32)), pa.array(pos)], ["h", "key", "p0", "cnt", "pos"])

    return find


def _pieces(length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", SMALL_STEP):
            data, start, row, p0, cnt, pos, h = _runs_of(batch)
            for a in range(0, len(row), 10_000):
                s = slice(a, a + 10_000)
                take = pa.array(row[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[s]), batch.column("key").take(take).cast(pa.binary()), batch.column("whole").take(take), pa.array(p0[s]), pa.array((pos - p0)[s].astype(np.int32)), binaries(data, start[s], cnt[s] + length - 1)],
                    ["h", "key", "whole", "p0", "off", "body"],
                )

    return pieces


def _windows(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", SMALL_STEP):
            data, start, row, p0, cnt, _, _ = _runs_of(batch)
            two = [Rolling(data), Rolling(data, 0xC2B2AE3D27D4EB4F)]
            for a in range(0, len(row), 1_000):
                s = slice(a, a + 1_000)
                n = cnt[s]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(start[s], n) + step
                take = pa.array(np.repeat(row[s], n))
                w1, w2 = (r.between(at, at + length).view(np.int64) for r in two)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), batch.column("key").take(take).cast(pa.binary()), batch.column("whole").take(take), pa.array(np.repeat(p0[s], n) + step)], ["w1", "w2", "key", "whole", "p"])

    return windows


def _merged(marks: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted disjoint [lo, hi) of each row's list of marks."""
    out = []
    for i in range(len(marks)):
        m = marks[i].values
        lo, hi = m.field("lo").to_numpy(zero_copy_only=False), m.field("hi").to_numpy(zero_copy_only=False)
        by = np.argsort(lo, kind="stable")
        lo, hi = lo[by], np.maximum.accumulate(hi[by])
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] > hi[:-1]
        last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
        out.append((lo[new], hi[last]))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, text, spans of each text that keeps a part of itself; spans are the sorted disjoint removed byte ranges."""
    base = docs.select(text_key().alias("key"), text_of().alias("text"))

    table = stash(base.mapInArrow(_anchored(length), "h long, key binary, p0 long, cnt int, pos long"), "anchors")
    count = table.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # Joined on a derived value, so that adaptive execution can split a hot anchor.
    found = table.select(F.bitwise_not("h").alias("j"), "key", "p0", "cnt", "pos")
    both = found.join(count.select(F.bitwise_not("h").alias("j"), "m"), "j").withColumn("h", F.bitwise_not("j")).drop("j")
    texts = base.groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("whole"))

    def lists(rows: DataFrame) -> DataFrame:
        run = F.struct("p0", "cnt", "pos", "h")
        return texts.join(rows.groupBy("key").agg(F.collect_set(run).alias("runs")), "key").select("key", "text", "whole", "runs")

    cold = lists(both.where(F.col("m") <= hot)).mapInArrow(_pieces(length), "h long, key binary, whole boolean, p0 long, off int, body binary")
    marks = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), "key binary, lo long, hi long")
    windows = lists(both.where(F.col("m") > hot)).mapInArrow(_windows(length), "w1 long, w2 long, key binary, whole boolean, p long")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.bitwise_not("w1").alias("v1"), F.bitwise_not("w2").alias("v2"))
    marks_hot = windows.where("not whole").withColumns({"v1": F.bitwise_not("w1"), "v2": F.bitwise_not("w2")}).join(again, ["v1", "v2"]).select("key", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
    spans = marks.union(marks_hot).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    rest = texts.join(spans, "key").where("not whole").select("key", "text", "marks")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", SMALL_STEP):
            pairs = [[{"lo": int(a), "hi": int(b)} for a, b in zip(*x, strict=True)] for x in _merged(batch.column("marks"))]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.binary()), batch.column("text"), pa.array(pairs, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["key", "text", "spans"])

    return rest.mapInArrow(merge, "key binary, text string, spans array<struct<lo:long,hi:long>>")


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """Keys of texts of at least ``length`` bytes that stand more than once."""
    return docs.select(text_key().alias("key"), F.octet_length(text_of()).alias("n")).where(F.col("n") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw, at, h, gone = text.as_buffer(), 0, hashlib.sha256(), 0
                for r in ranges:
                    h.update(raw[at : r["lo"]])
                    at, gone = r["hi"], gone + r["hi"] - r["lo"]
                h.update(raw[at:])
                removed.append(gone), spans.append(len(ranges)), kept.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["key", "removed", "spans", "kept"])

    part = repeats(docs, length, hot).mapInArrow(digest, "key binary, removed long, spans long, kept string")
    whole = _copies(docs, length).select("key", F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept"))
    text = text_of()
    rows = docs.select("doc_id", text_key().alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    return rows.join(part.union(whole), "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "own").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``; a character goes when all its bytes go.  Column ``n_chars``, where it stands, is counted anew."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw, at, keep = text.as_buffer(), 0, []
                view = memoryview(raw)
                for r in ranges:
                    lo, hi = r["lo"], r["hi"]
                    while lo < len(view) and view[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi < len(view) and view[hi] & 0xC0 == 0x80:
                        hi -= 1
                    keep.append({"at": at + 1, "n": lo - at})
                    at = max(lo, hi)
                out.append([*keep, {"at": at + 1, "n": len(view) - at}])
            kept = pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.binary()), kept], ["_key", "_kept"])

    # What is kept goes to the rows as ranges of bytes: texts travel with their rows only.
    part = repeats(docs, length, hot).mapInArrow(cut, "_key binary, _kept array<struct<at:int,n:int>>")
    whole = _copies(docs, length).select(F.col("key").alias("_key"), F.expr("array(named_struct('at', 1, 'n', 0))").alias("_kept"))
    kept = F.expr("array_join(transform(_kept, r -> cast(substring(cast(text as binary), r.at, r.n) as string)), '')")
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(kept)
    joined = docs.withColumn("_key", text_key()).join(part.union(whole), "_key", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
