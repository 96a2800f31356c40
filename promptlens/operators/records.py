"""Operators on records: chunks, context, retrieval, dedup, evaluation, validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

SEPARATORS = (". ", "! ", "? ", "\n\n", "\n")


def chunks_of(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Overlapping windows, cut after the first kind of separator found in the last ``overlap`` characters."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    text, out, at = text or "", [], 0
    if len(text) <= size:
        return [text]
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            places = ((text.rfind(s, max(at, end - 50), end), len(s)) for s in SEPARATORS)
            cut = next((p + n for p, n in places if p >= 0), None)
            end = end if cut is None else cut
        if text[at:end].strip():
            out.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk(df: DataFrame, key: str, column: str, size: int = 500, overlap: int = 50) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunks_of(t, size, overlap))

    return df.select(key, F.posexplode(cut(F.col(column))).alias("chunk_id", "content"))


def history(df: DataFrame, most: int = 5) -> DataFrame:
    """Each turn with the lines of up to ``most`` turns before it."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, -1)
    return df.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(q, vec_id, rank, sim): the k nearest of ``base`` by cosine, blocks of vectors against blocks of queries.

    Each pair of blocks gives k rows per query; these meet in a ranked window
    that keeps k per task before its shuffle.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").alias("e"))
        groups = F.greatest(F.lit(1), F.ceil(F.lit(own.count() / block))).cast("int")
        return own.groupBy(F.pmod(F.xxhash64("i"), groups).alias("b")).agg(F.collect_list(F.struct("i", "e")).alias(name)).drop("b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                side = []
                for name in ("left", "right"):
                    rows = batch.column(name)[r].values
                    ids = rows.field("i").to_numpy()
                    v = rows.field("e").flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                    side.append((ids, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)))
                (qi, q), (bi, b) = side
                sim = np.round(q @ b.T, 4)
                sim[qi[:, None] == bi[None, :]] = -2
                n = min(k, len(bi))
                top = np.lexsort((np.broadcast_to(bi, sim.shape), -sim), axis=1)[:, :n]
                flat = np.take_along_axis(sim, top, 1).ravel()
                keep = flat > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)[keep]), pa.array(bi[top].ravel()[keep]), pa.array(flat[keep])], ["q", "vec_id", "sim"])

    pairs = blocks(queries, "left").crossJoin(blocks(base, "right"))
    found = pairs.mapInArrow(compare, "q long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def first_wins(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per dedup key: the first in ``order`` (a grouped minimum, so hot keys fold before the shuffle)."""
    rest = [c for c in df.columns if c not in order]
    own = df.where(T.strip(F.col(text)) != "").groupBy(T.dedup_key(F.col(text)).alias("key")).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return own.select("key", "r.*")


def first_error(*checks: tuple[Column, Column | str]) -> Column:
    return F.coalesce(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in checks])


def validate_request(prompt: Column, most: int = 50_000) -> Column:
    return first_error((F.coalesce(T.strip(prompt), F.lit("")) == "", "empty prompt"), (F.length(prompt) > most, "prompt too long"), (F.contains(prompt, F.lit("\x00")), "null byte"))


def build_prompt(prompt: Column, external: Column) -> Column:
    lines = F.transform(external, lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"\[/?EXTERNAL\]", "")))
    return F.when(F.size(external) > 0, F.concat_ws("\n", prompt, F.lit("Context:"), F.array_join(lines, "\n"))).otherwise(prompt)


def complexity(tokens: Column, chunks: Column, ratio: Column, files: Column) -> Column:
    parts = F.least(tokens / 100, F.lit(3.0)) + F.least(chunks / 5, F.lit(3.0)) + F.abs(ratio - 0.5) * 4 + F.least(files / 5, F.lit(2.0))
    return F.round(F.least(parts, F.lit(10.0)), 2)
