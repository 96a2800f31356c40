"""Connected components of an edge table by alternating large and small stars.

Before the first round and at the end of each, every task contracts its own part
of the edges to stars, so that few rounds are left; a round is two grouped minima
and two joins.  The table is written after every round, so nothing is collected
and a lost executor costs one round at most.  It ends when all edges are stars:
each vertex has one root, and no root has another.
Tasks follow the number of edges, not that of shuffle partitions: what the
driver keeps of every task and file would else outweigh small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import stash

#: Edges that a task gets before there are more tasks than cores.
TASK_EDGES = 1 << 18


def _to_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and all its v; the minima are joined on a derived value so that a hot u can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("_j"), F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    rows = edges.withColumn("_j", F.xxhash64("u"))
    return rows.join(least, (rows["_j"] == least["_j"]) & (rows["u"] == least["_u"])).select("u", "v", "m")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of the vertices of edges (u, v) that are not the least."""
    vertex, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(vertex))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    low = np.flatnonzero(root != np.arange(len(vertex)))
    return vertex[low], vertex[root[low]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the components of ``edges`` (u, v), in which each run of ``TASK_EDGES`` rows of a task is stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TASK_EDGES:
                yield turned(held)
                held, n = [], 0
        if n:
            yield turned(held)

    def turned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv"))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(contract, "u long, v long")


def _all_stars(edges: DataFrame) -> bool:
    ends = edges.select("u", "v", F.lit(False).alias("root")).union(edges.select("v", F.lit(None).cast("long"), F.lit(True)))
    return ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max("root").alias("root")).where("a <> b or (a is not null and root)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root) of every vertex of ``edges`` (u, v); root is the least vertex of its component."""
    now = stash(_contracted(edges.where("u <> v")), "edges")
    tasks = max(now.sparkSession.sparkContext.defaultParallelism, -(-2 * now.count() // TASK_EDGES))
    for _ in range(most_rounds):
        if _all_stars(now):
            return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root"))).distinct()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).coalesce(tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _to_least(down).coalesce(tasks)
        small = starred.select("u", F.col("m").alias("v")).union(starred.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = stash(_contracted(small.coalesce(tasks)), "edges")
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
