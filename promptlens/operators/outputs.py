"""Sinks: envelopes by processing type, media sidecars, what was written lately, counts, retention; and limits of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T

# File types by kind, and the greatest file.
TEXT_TYPES = (".txt", ".md", ".pdf", ".docx")
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".gif", ".webp")
MOST_BYTES = 10 << 20
KINDS = {"layer0": "layer0_text", "media": "media_processing"}


def extension(name: Column) -> Column:
    """The end of a file name from its last dot on, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"(?:^|[^/.])(\.[^./]*)$", 1))


def is_text_file(name: Column) -> Column:
    return extension(name).isin(*TEXT_TYPES)


def is_image_file(name: Column) -> Column:
    return extension(name).isin(*IMAGE_TYPES)


def is_allowed(name: Column) -> Column:
    return extension(name).isin(*TEXT_TYPES, *IMAGE_TYPES)


def size_ok(size: Column, most: int = MOST_BYTES) -> Column:
    return size <= most


def file_path(folder: str, name: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), name)


def file_error(name: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """The first fault of a file: absent (null size), too large, or of no known type; null of a good one."""
    return F.coalesce(F.when(size.isNull(), F.lit("file not found")), F.when(size > most, F.lit("file too large")), F.when(~is_allowed(name), F.lit("unsupported type")))


def output_name(ts: Column, kind: Column, request_id: Column, user: Column) -> Column:
    """``<time>_<type>_<first 8 of the id>_<first 30 of the text>.json``."""
    return F.concat(F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), kind, F.substring(request_id, 1, 8), T.file_stem(F.substring(user, 1, 30))), F.lit(".json"))


def envelopes(prepared: DataFrame, kind: str) -> DataFrame:
    """processing_type, saved_at, file_name and the record as JSON, for rows of prepared_input."""
    p = F.col("prepared_input")
    return prepared.select(F.lit(KINDS[kind]).alias("processing_type"), F.current_timestamp().alias("saved_at"), output_name(F.current_timestamp(), F.lit(kind), p["metadata"]["request_id"], p["text_embed_stub"]["normalized_user"]).alias("file_name"), F.to_json(p).alias("prepared_input"))


def save(prepared: DataFrame, path: str, kind: str) -> None:
    """Append the envelopes under a folder of their type."""
    envelopes(prepared, kind).write.mode("append").partitionBy("processing_type").json(path)


def save_media(prepared: DataFrame, path: str) -> None:
    """Sidecars of the requests that have an image or an emoji."""
    stub = F.col("prepared_input.image_emoji_stub")
    rows = prepared.where(stub["image"].isNotNull() | (stub["emoji_summary"]["count"] > 0))
    rows.select(F.col("prepared_input.metadata.request_id").alias("request_id"), stub["image"].alias("image"), stub["emoji_summary"].alias("emoji_summary"), F.current_timestamp().alias("saved_at")).write.mode("append").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """processing_type, path, length and modificationTime of the files of an output folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.regexp_extract("path", r"processing_type=([^/]+)", 1).alias("processing_type"), "path", "length", "modificationTime")


def recent(files: DataFrame, kind: str = "all", limit: int = 10) -> DataFrame:
    """The newest files, of one type or all."""
    own = files if kind == "all" else files.where(F.col("processing_type") == KINDS.get(kind, kind))
    return own.orderBy(F.desc("modificationTime"), "path").limit(limit)


def output_stats(files: DataFrame) -> DataFrame:
    """Files of each type, and of all (``total``)."""
    return files.rollup("processing_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("processing_type", F.lit("total")).alias("processing_type"), "n")


def expired(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files older than ``hours``, which retention deletes."""
    return files.where(F.col("modificationTime") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def delete_expired(files: DataFrame, now: Column, hours: int = 24) -> int:
    """Delete the expired files through Spark's file system, task by task on the driver's list of paths; returns how many went."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for r in expired(files, now, hours).select("path").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(at.getFileSystem(conf).delete(at, False))
    return n
