"""Near-duplicate join on five-word shingles with Bayesian pruning of candidates.

1. Every text becomes the set of its word shingles (``words``); texts with
   one set are one node.  A node has 128 MinHash values: 32 bands of four
   give its buckets, the low byte of each its signature.
2. Nodes of a bucket are compared by signature, a few values at a time; a pair
   is dropped when the posterior probability that its similarity reaches the
   threshold falls below ``tolerance`` (uniform prior, one-byte collisions
   accounted for).  A pair of similarity 0.8 shares no band with a
   probability of 5e-8.
3. Of the pairs that are left only as many go on as unite what they link
   (``forest``): their components, the groups, hold every such pair, and no
   list of pairs grows with the square of a bucket.
4. In each group every pair is verified exactly on the whole shingle sets, in
   blocks that give a spanning forest of the verified links and, for n_links,
   each node's count of them.  A link counts the distinct texts of the other
   node; the other texts of the own node are links as well.
5. Classes are the connected components of the verified links.

Buckets and groups of more than ``WHOLE`` members are cut into parts of
``BLOCK``: each part is compared with the bucket's leaders, then every member
that no leader of the largest part links to with all members elsewhere
(``outsiders``).  So a bucket of texts that are alike costs in proportion to its
size, and no pair of unlike parts is left out.

Defined cases: texts without any word (also null and empty ones) have no set
and stand alone; a text of fewer than five words has one shingle, all its
words; copies are in one class whatever their length; a null doc_id is kept,
and its class is the least id in the class; rows that repeat share a class; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import SMALL_STEP, bytes_view, grouped, mix, stash, steps, text_key, text_of
from promptlens.llm.components import connected_components
from promptlens.llm.words import shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Up to this many nodes every pair of a bucket is compared at once, up to SMALL in one array with those of other buckets.
SMALL, WHOLE = 16, 512
LEADERS = 4
#: Nodes in a part of a larger bucket or group.
BLOCK = 1024
#: Nodes of a group, and their shingles, that one side of a counted block has at most (on average).
COUNTED, COUNTED_SHINGLES = 512, 1 << 21
TOLERANCE = 1e-9
STEP = 16

_MULTIPLY = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return least


def fewest_matches(threshold: float, tolerance: float, step: int = STEP, size: int = BANDS * ROWS) -> list[int]:
    """For step, 2 * step, ... compared values: the fewest matches at which P(similarity >= threshold) is still ``tolerance``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    agree = s + (1 - s) / 256
    high, out = s >= threshold, []
    for n in range(step, size + 1, step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(agree) + (n - m) * np.log1p(-agree)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, high].sum(axis=1) / like.sum(axis=1) >= tolerance)))
    return out


def may_reach(a: np.ndarray, b: np.ndarray, fewest: list[int], step: int = STEP) -> np.ndarray:
    """Which pairs of signature rows survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest):
        s = slice(k * step, (k + 1) * step)
        matches[alive] += (a[alive, s] == b[alive, s]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key (of the shingle set; null without words), n, bands, signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.repeat(np.arange(BANDS, dtype=np.uint64), 1)
        for batch in steps(batches, "text", SMALL_STEP):
            keys, sizes, bands, signatures = [], [], [], []
            for shingles in shingle_sets(*bytes_view(batch.column("text"))):
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(None), bands.append(None), signatures.append(None)
                    continue
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                least = minhash(shingles)
                band = number
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
                bands.append(band.view(np.int64))
                signatures.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key").cast(pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "text_key", "key", "n", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_of().alias("text")).mapInArrow(sketch, "doc_id long, text_key binary, key binary, n int, bands array<long>, signature binary")


class Signatures:
    """Compares nodes by signature: which pairs may reach the threshold."""

    columns = ["n", "signature"]

    def __init__(self, table: pa.Table, threshold: float, fewest: list[int]):
        self.n = table.column("n").to_numpy()
        self.rows = bytes_view(table.column("signature"))[0].reshape(-1, BANDS * ROWS)
        self.threshold, self.fewest = threshold, fewest

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self.n[left], self.n[right]
        out = np.minimum(a, b) >= self.threshold * np.maximum(a, b)
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            out[some] = may_reach(self.rows[left[some]], self.rows[right[some]], self.fewest)
        return out

    def matrix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(left), len(right)), bool)
        for k, i in enumerate(left):
            out[k] = self.pairs(np.full(len(right), i), right)
        return out


class Sets:
    """Compares nodes by their whole shingle sets."""

    columns = ["text"]

    def __init__(self, table: pa.Table, threshold: float):
        self.sets = sets_of(table)
        self.threshold = threshold

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        common = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
        size = np.array([len(s) for s in self.sets], np.int64)
        return common >= self.threshold * (size[left] + size[right] - common)

    def matrix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        own, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        return similar([self.sets[i] for i in own], at[: len(left)], at[len(left) :], self.threshold)


def sets_of(table: pa.Table) -> list[np.ndarray]:
    return [s for b in steps(table.select(["text"]).combine_chunks().to_batches(), "text", SMALL_STEP) for s in shingle_sets(*bytes_view(b.column("text")))]


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links that unite all that the links of the matrix unite, fewer than rows and columns together."""
    across = np.ascontiguousarray(hit.T)
    free_row, free_column = hit.any(axis=1), across.any(axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for first in range(len(hit)):
        if not free_row[first]:
            continue
        free_row[first] = False
        rows = [first]
        while rows:
            i = rows.pop()
            columns = np.flatnonzero(hit[i] & free_column)
            free_column[columns] = False
            found.append((np.full(len(columns), i), columns))
            for j in columns:
                more = np.flatnonzero(across[j] & free_row)
                free_row[more] = False
                found.append((more, np.full(len(more), j)))
                rows.extend(more)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]).astype(np.int64) for k in (0, 1))


def _placed(members: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """``members`` with the columns of ``sizes``, joined on a derived value so that adaptive execution can split a hot one."""
    own = sizes.withColumn("j", F.bitwise_not(name)).drop(name)
    return members.withColumn("j", F.bitwise_not(name)).join(own, "j").drop("j")


def _parts(size, most) -> F.Column:
    return F.ceil(F.col(size) / most).cast("int")


def _part_of(parts, seed: int):
    return F.pmod(F.xxhash64("key", F.lit(seed)), parts).cast("int")


def united(members: DataFrame, compare) -> DataFrame:
    """(a, b) that unite all linked members of each bucket; members has bucket, key, size and the columns of ``compare``."""
    held = ["bucket", "key", *compare.columns]
    parts = F.when(F.col("size") > WHOLE, _parts("size", BLOCK)).otherwise(0)
    seeds = [F.xxhash64("key", F.lit(i)) for i in range(LEADERS)]
    large = members.where(F.col("size") > WHOLE)
    leaders = large.groupBy("bucket").agg(*[F.min(h).alias(f"lead{i}") for i, h in enumerate(seeds)])
    leads = _placed(large, leaders, "bucket").where(reduce(or_, [h == F.col(f"lead{i}") for i, h in enumerate(seeds)]))
    own = members.select(*held, F.lit(False).alias("leads"), F.when(parts > 0, 1 + _part_of(parts, 101)).otherwise(0).alias("part"))
    every = leads.select(*held, F.lit(True).alias("leads"), F.explode(F.sequence(F.lit(1), parts)).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, ["bucket", "part"]):
            look = compare.load(table)
            key, bucket, part = (table.column(c).to_numpy() for c in ("key", "bucket", "part"))
            leads = table.column("leads").to_numpy()
            ends = np.append(starts[1:], len(key))
            size = ends - starts
            left, right = _small_pairs(starts, np.where((part[starts] == 0) & (size <= SMALL), size, 0))
            good = look.pairs(left, right)
            found, labels = [(left[good], right[good])], []
            for lo, hi in zip(starts, ends, strict=True):
                at = np.arange(lo, hi)
                if part[lo]:
                    rows, others = at[leads[lo:hi]], at[~leads[lo:hi]]
                    hit = look.matrix(rows, others) | (key[rows][:, None] == key[others][None, :])
                    some = hit.any(axis=0)
                    labels.append((others, np.where(some, key[rows[hit.argmax(axis=0)]], 0), some))
                elif hi - lo > SMALL:
                    i, j = forest(look.matrix(at, at))
                    found.append((at[i], at[j]))
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            none, no = np.zeros(0, np.int64), np.zeros(0, bool)
            of, lead, some = (np.concatenate([x, *(y[k] for y in labels)]) for k, x in enumerate((none, none, no)))
            of = of.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket[a], bucket[of]])), pa.array(np.concatenate([key[a], key[of]])), pa.array(np.concatenate([key[b], lead]), mask=np.concatenate([np.zeros(len(a), bool), ~some])), pa.array(np.arange(len(a) + len(of)) >= len(a))], ["bucket", "a", "b", "part"])

    rows = own.union(every).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    first = stash(rows.mapInArrow(run, "bucket long, a long, b long, part boolean"), "united")
    edges = first.where("b is not null and a <> b").select("a", "b")
    labels = first.where("part").select("bucket", F.col("a").alias("key"), F.col("b").alias("label"))
    if labels.isEmpty():
        return edges
    return edges.union(outsiders(members, labels, compare))


def _small_pairs(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of places in each of the runs."""
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(lo, lo + n) for lo, n in zip(starts[size > 1], size[size > 1], strict=True))]).astype(np.int64)
    end = np.repeat((starts + size)[size > 1], size[size > 1])
    left, right = [at[:0]], [at[:0]]
    for step in range(1, int(size.max(initial=1))):
        some = at + step < end
        left.append(at[some]), right.append(at[some] + step)
    return np.concatenate(left), np.concatenate(right)


def outsiders(members: DataFrame, labels: DataFrame, compare) -> DataFrame:
    """(a, b) that unite the members outside a bucket's largest part (by label: the first leader that links to them, or none) with all that they link to."""
    sizes = labels.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"), F.max(F.when(F.col("label").isNotNull(), F.struct("size", "label"))).alias("most"))
    main = F.coalesce(F.col("most.size"), F.lit(0))
    mixed = sizes.where(main < F.col("size")).select("bucket", F.col("most.label").alias("main"), _parts("size", BLOCK).alias("across"), F.ceil((F.col("size") - main) / BLOCK).cast("int").alias("down"))
    rows = _placed(labels, mixed, "bucket").withColumn("outside", ~F.col("label").eqNullSafe(F.col("main")))
    rows = rows.join(members.select("bucket", "key", *compare.columns), ["bucket", "key"])
    held = ["bucket", "key", "label", "outside", *compare.columns]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = rows.select(*held, F.lit(False).alias("asks"), _part_of(F.col("across"), 101).alias("x"), every("down").alias("y"))
    asking = rows.where("outside").select(*held, F.lit(True).alias("asks"), every("across").alias("x"), _part_of(F.col("down"), 102).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, ["bucket", "x", "y"]):
            look = compare.load(table)
            key, asks = table.column("key").to_numpy(), table.column("asks").to_numpy()
            found = [(starts[:0], starts[:0])]
            for lo, hi in zip(starts, np.append(starts[1:], len(key)), strict=True):
                at = np.arange(lo, hi)
                left, right = at[asks[lo:hi]], at[~asks[lo:hi]]
                i, j = forest(look.matrix(left, right))
                found.append((left[i], right[j]))
            a, b = (key[np.concatenate([f[k] for f in found]).astype(np.int64)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return others.union(asking).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a long, b long")


class Comparison:
    """A class that compares nodes, with the arguments it takes beside its table."""

    def __init__(self, kind, *args):
        self.kind, self.args, self.columns = kind, args, kind.columns

    def load(self, table: pa.Table):
        return self.kind(table, *self.args)


def groups_of(table: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """All nodes (key: a number, set, text_key, n, bands, signature), and (key, bucket, text_key, n) of those in a group (bucket) with others."""
    nodes = table.where("key is not null").groupBy(F.col("key").alias("set")).agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = stash(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")
    posted = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(_placed(posted, sizes, "bucket"), "members")
    held = members.join(nodes.select("key", "n", "signature"), "key")
    edges = united(held, Comparison(Signatures, threshold, fewest_matches(threshold, tolerance)))
    roots = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return nodes, roots.select(F.col("u").alias("key"), F.col("root").alias("bucket")).join(nodes.select("key", "text_key", "n"), "key")


def _texts(docs: DataFrame) -> DataFrame:
    """text_key and text of every text once; copies fold before the shuffle."""
    return docs.select(text_key().alias("text_key"), text_of().alias("text")).groupBy("text_key").agg(F.first("text").alias("text"))


def _classes(edges: DataFrame) -> DataFrame:
    """key and root of every node of ``edges``."""
    return connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("key"), "root")


def _with_classes(table: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links, text_key for every row of ``table``; ``found`` has key, root and n_links."""
    own = nodes.select("key", "set").join(found, "key").select(F.col("set").alias("key"), F.col("root").cast("string").alias("root"), "n_links")
    rows = table.select("doc_id", "text_key", "key").join(own, "key", "left").select("doc_id", "text_key", "n_links", F.coalesce("root", F.hex("key")).alias("class"))
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Joined on a derived value, so that adaptive execution can split a hot class.
    least = least.select(F.xxhash64("class").alias("j"), F.col("class").alias("c"), "least")
    rows = rows.withColumn("j", F.xxhash64("class"))
    return rows.join(least, (rows["j"] == least["j"]) & (rows["class"] == least["c"]), "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_key")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id and class_id of ``near_duplicates`` for every row of ``docs``, without its count of links."""
    table = stash(sketches(docs), "sketches")
    nodes, grouped_nodes = groups_of(table, threshold, tolerance)
    members = stash(grouped_nodes, "grouped")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    held = _placed(members, sizes, "bucket").join(_texts(docs), "text_key").select("bucket", "key", "size", "text")
    roots = _classes(united(held, Comparison(Sets, threshold)))
    return _with_classes(table, nodes, roots.withColumn("n_links", F.lit(0))).select("doc_id", "class_id")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``sets[left]`` (rows) reach the threshold with which of ``sets[right]`` (columns)."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    at, owner = (np.cumsum(n > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(left), len(right)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        common += has[left] @ has[right].T  # whole numbers up to 4096: exact
    return common >= threshold * (size[left][:, None] + size[right] - common)


def counted(docs: DataFrame, table: DataFrame, nodes: DataFrame, members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that unite all verified links of each group, and key and n_links: the distinct texts that each text of a node is linked to, for nodes that have any."""
    many = table.where("key is not null").select(F.col("key").alias("set"), "text_key").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    many = stash(many, "texts")
    many = nodes.select("key", "set").join(many, "set").select("key", "texts")
    members = stash(members.join(many, "key", "left").withColumn("texts", F.coalesce("texts", F.lit(1))), "grouped")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    sizes = sizes.select("bucket", F.ceil(F.greatest(F.col("size") / COUNTED, F.col("shingles") / COUNTED_SHINGLES)).cast("int").alias("blocks"))
    placed = _placed(members, sizes, "bucket").withColumn("own", _part_of(F.col("blocks"), 103))
    sent = placed.join(_texts(docs), "text_key").select("key", "bucket", "texts", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("key", "bucket", "texts", "text", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in grouped(batches, ["bucket", "x", "y"]):
            sets = sets_of(held)
            key, own, x, y, texts = (held.column(c).to_numpy() for c in ("key", "own", "x", "y", "texts"))
            degree = np.zeros(len(sets), np.int64)
            found = [(starts[:0], starts[:0])]
            for lo, hi in zip(starts, np.append(starts[1:], len(key)), strict=True):
                left, right = lo + np.flatnonzero(own[lo:hi] == x[lo]), lo + np.flatnonzero(own[lo:hi] == y[lo])
                hit = similar(sets[lo:hi], left - lo, right - lo, threshold)
                if x[lo] == y[lo]:
                    np.fill_diagonal(hit, False)
                    degree[left] = hit @ texts[right]
                else:
                    degree[left], degree[right] = hit @ texts[right], texts[left] @ hit
                i, j = forest(hit)
                found.append((left[i], right[j]))
            a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(key[np.concatenate([a, some])]), pa.array(np.concatenate([key[b], key[some]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), degree[some]]))], ["a", "b", "n"])

    rows = sent.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = stash(rows.mapInArrow(run, "a long, b long, n long"), "counted")
    within = many.select("key", (F.col("texts") - 1).alias("n"))
    return found.where("a <> b").select("a", "b"), found.where("a = b").select(F.col("a").alias("key"), "n").union(within).groupBy("key").agg(F.sum("n").alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links (distinct other texts that its text has a verified link to), text_key, for every row of ``docs``."""
    table = stash(sketches(docs), "sketches")
    nodes, members = groups_of(table, threshold, tolerance)
    edges, counts = counted(docs, table, nodes, members, threshold)
    return _with_classes(table, nodes, counts.join(_classes(edges), "key", "left"))
