"""Exact deduplication: 128-bit content hash, byte comparison inside each hash group.

Texts are equal when they are identical after the characters
``[\\x20\\x09-\\x0D]`` are deleted.  Everything runs in the JVM.

Shuffles: one of each distinct text (partial aggregation folds copies before
it, so a hot text travels once per task) and one of small fixed rows.
Defined cases: null text counts as empty, empty texts are equal to each other;
rows that repeat a doc_id together with its text share its decision; a null
doc_id sorts after all others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import text_of

_SPACE = " \t\n\x0b\x0c\r"
_LAST = 9223372036854775807


def _rank():
    """Code points first, then the smallest doc_id, as one number that hash aggregation can hold."""
    chars = F.length(text_of()).cast("decimal(10,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    last = F.lit(str(_LAST)).cast("decimal(19,0)")
    return (chars * two64 + (last - F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("decimal(19,0)"))).cast("decimal(38,0)")


def _doc_of(rank):
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    back = (F.lit(str(_LAST)).cast("decimal(19,0)") - F.pmod(rank, two64)).cast("long")
    return F.when(back != _LAST, back)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per group of equal texts: content_hash, text_sha256, rank of the row that stays, group_size.

    Grouping on the text beside its hash compares the bytes; two texts of
    one hash and one SHA-256 that differ would stop the query.
    """
    base = docs.select(F.translate(text_of(), _SPACE, "").alias("norm"), _rank().alias("rank")).withColumn("content_hash", F.unhex(F.md5("norm")))
    by_bytes = base.groupBy("content_hash", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
    one = by_bytes.select("content_hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "n", "rank")
    groups = one.groupBy("content_hash", "text_sha256").agg(F.sum("n").alias("group_size"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("texts"))
    return groups.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")))).drop("texts")


def _matched(docs: DataFrame, *others: str) -> DataFrame:
    """Every row of ``docs`` (doc_id, ``others``, chars) with text_sha256, its group's key k and, in groups of two rows or more, keep and group_size."""
    norm = F.translate(text_of(), _SPACE, "")
    rows = docs.select("doc_id", *others, F.length(text_of()).alias("chars"), norm.alias("norm")).select(
        "doc_id", *others, "chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.concat(F.unhex(F.md5("norm")), F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).alias("k")
    )
    # Only groups of two rows or more need a partner; the joined key is derived so that both sides have an exchange of their own, which adaptive execution may split when one text is hot.
    many = exact_groups(docs).where("group_size > 1").select(F.concat("content_hash", F.unhex("text_sha256")).alias("k"), _doc_of(F.col("rank")).alias("keep"), "group_size")
    return rows.join(many, "k", "left")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    found = F.col("group_size").isNotNull()
    return _matched(docs).select(
        "doc_id",
        F.when(found, F.col("keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("keep"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def kept_rows(docs: DataFrame, row: str) -> DataFrame:
    """``row``, a unique id, of exactly one row of each group: of the rows that ``exact_dedup`` keeps, which share a doc_id or have none, the longest, then the least ``row``."""
    kept = _matched(docs, row).where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep")))
    return kept.groupBy("k").agg(F.max_by(row, F.struct("chars", -F.col(row))).alias(row)).select(row)


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER g AS keep_id,
  CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""
