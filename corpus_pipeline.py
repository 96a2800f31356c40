"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import exact_dedup, near_join, packing, quality, repeats
from promptlens.llm.common import stash
from promptlens.llm.queries import tokenizer_file

#: A unique id of each row, which the first stage adds, the stage's writing fixes, and the last stage that removes rows takes off.
ROW = "_pipeline_row"


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with a written ROW; doc_id does not tell rows apart, as it may repeat or be null."""
    return docs if ROW in docs.columns else stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _held(docs: DataFrame) -> DataFrame:
    """``docs`` with each row whole in one column beside what a stage reads, so that no column's name can clash with the stage's own."""
    n_chars = [F.col("n_chars")] if "n_chars" in docs.columns else []
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col("doc_id"), F.col("text"), *n_chars)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the rows that stay get their ROW.

    Null text counts as empty and is scored as any other; rows that repeat
    share a score and stay or go together; a null doc_id is held out of the
    training and scored; an empty table gives no rows.
    """
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score(_held(docs).select("held", "text"), model).where("predicted = 1")
    return kept.select("held.*", F.monotonically_increasing_id().alias(ROW))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then first, row stays, whole; of rows that repeat, one.

    Null and empty texts are equal; rows of one doc_id with different texts
    are judged each by its text; a null doc_id comes after all others; an
    empty table gives no rows.
    """
    rows = identified(docs)
    return rows.join(exact_dedup.kept_rows(rows.select("doc_id", "text", ROW), ROW), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id (null last); of rows that repeat, one.

    Texts without words stand alone; an empty table gives no rows.
    """
    rows = identified(docs)
    classes = near_join.near_classes(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "class_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    kept = rows.select(ROW, "doc_id").join(classes, ROW).groupBy("class_id").agg(least.alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns if c != ROW])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 bytes or more that stand more than once are cut out of the texts, and ``n_chars`` is counted anew.

    Every row stays, also one whose text is cut to nothing; null text stays
    null; texts of equal rows that reach this stage alone are copies of each
    other and are cut; an empty table gives no rows.
    """
    cut = repeats.without_repeats(_held(docs))
    own = [F.col(c) if c in ("text", "n_chars") else F.col("held").getField(c).alias(c) for c in docs.columns]
    return cut.select(*own)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts, tokenized and packed; null text is empty and has one piece, its end mark; rows that repeat are packed each."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("suffix-array dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: A classifier is fitted in the first stage, so SQL cannot express the rows; the tests hold the operators of the stages, not yet the whole run, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
