"""Preparing requests: context with signatures, statistics, analysis, and the record that packs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions import screen as S
from promptlens.functions import text as T
from promptlens.functions import unicode as U
from promptlens.operators import records as R

NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(NONE)


def file_chunk(content: Column, source: Column, chunk: Column) -> Column:
    """A file's chunk with its source behind it."""
    return F.concat(content, F.lit(" [Source: "), source.cast("string"), F.lit(", Chunk: "), chunk.cast("string"), F.lit("]"))


def signed_files(files: Column, key: str) -> Column:
    """(delimited, hmac) of each (content, source, chunk_id)."""
    return F.transform(files, lambda x: T.sign_chunk(file_chunk(x["content"], x["source"], x["chunk_id"]), key))


def signed_external(texts: Column, key: str) -> Column:
    """(delimited, hmac) of each text that is not blank."""
    return F.transform(F.filter(texts, lambda x: F.coalesce(T.strip(x), F.lit("")) != ""), lambda x: T.sign_chunk(x, key))


def signed_conversation(text: Column, key: str) -> Column:
    """(delimited, hmac) of a history, both empty for a blank one."""
    blank = F.coalesce(T.strip(text), F.lit("")) == ""
    empty = F.struct(F.lit("").alias("delimited"), F.lit("").alias("hmac"))
    return F.when(blank, empty).otherwise(T.sign_chunk(text, key, "conversation"))


def context(conversation: Column, files: Column, external: Column, retrieved: Column, key: str) -> Column:
    """Signed chunks of all four sources, in this order."""
    talk = F.filter(F.array(signed_conversation(conversation, key)), lambda x: x["delimited"] != "")
    kind = "array<struct<delimited:string,hmac:string>>"
    parts = (talk, signed_files(files, key), signed_external(external, key), signed_external(retrieved, key))
    return F.concat(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts])


def statistics(user: Column, chunks: Column, file_chunks: Column, extracted: Column) -> Column:
    """char_total (with the chunks' markers and the blanks between them), token_estimate, user_external_ratio and the file counts."""
    joined = F.array_join(chunks, " ")
    tokens = F.aggregate(chunks, T.estimate_tokens(user).cast("long"), lambda n, c: n + T.estimate_tokens(c).cast("long"))
    return F.struct((T.count_characters(user) + F.length(joined)).cast("long").alias("char_total"), tokens.alias("token_estimate"), T.ratio(F.coalesce(user, F.lit("")), joined).alias("user_external_ratio"), file_chunks.cast("long").alias("file_chunks_count"), extracted.cast("long").alias("extracted_total_chars"))


def interpretation(score: Column) -> Column:
    return F.when(score < 2, "Simple input").when(score < 4, "Moderate complexity").when(score < 6, "Complex input").when(score < 8, "Highly complex input").otherwise("Very complex input with extensive external data")


def complexity(chunks: Column, stats: Column) -> Column:
    """How complex an input is: a score up to 10, what it comes from, and in words."""
    n, ratio, files = F.size(chunks), stats["user_external_ratio"], stats["file_chunks_count"]
    score = R.complexity(stats["token_estimate"], n, ratio, files)
    total = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + F.length(c))
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    return F.struct(score.alias("complexity_score"), F.round(mean, 2).alias("avg_chunk_size"), n.alias("num_external_chunks"), (files > 0).alias("has_files"), F.round(1 - ratio, 3).alias("external_data_ratio"), interpretation(score).alias("interpretation"))


def statistics_summary(stats: Column) -> Column:
    whole = F.format_string("Total: %d chars, ~%d tokens | User/External ratio: %.1f%% | File chunks: %d (%d chars)", stats["char_total"], stats["token_estimate"], stats["user_external_ratio"] * 100, stats["file_chunks_count"], stats["extracted_total_chars"])
    return whole


LAYER0 = ("normalized_text", "special_char_mask", "unicode_analysis", "heuristic_flags", "suspicious_score")


def with_layer0(df: DataFrame, user: str, external: str) -> DataFrame:
    """``df`` with LAYER0: the analysis of the user's text and all external texts together; heuristics weigh 0.7, hidden characters 0.3."""
    df = df.withColumn("_both", F.concat(F.coalesce(F.col(user), F.lit("")), F.lit(" "), F.array_join(external, " ")))
    df = S.with_heuristics(U.with_unicode(df, "_both"), "_both")
    df = df.withColumns({"unicode_analysis": F.struct(*U.ANALYSIS), "heuristic_flags": F.struct(*S.HEURISTICS)})
    score = F.col("heuristic_flags.suspicious_score") * 0.7 + F.when(F.col("unicode_analysis.unicode_obfuscation_flag"), 0.3).otherwise(0.0)
    return df.withColumn("suspicious_score", score).drop("_both", "zero_width_removed", "detected_patterns", *S.FLAGS, *U.ANALYSIS)


INPUT = {"request_id": "string", "timestamp": "timestamp", "session_id": "string", "user_prompt": "string", "conversation": "string", "external": NONE, "retrieved": NONE, "files": "array<struct<content:string,source:string,chunk_id:int>>", "image": "struct<hash:string,format:string,size_bytes:bigint,dimensions:array<int>,description:string,error:string>"}
NO_IMAGE = INPUT["image"]


def parsed(df: DataFrame) -> DataFrame:
    """Requests with every column of INPUT: an id and the time where none is given, no blank external text, and the first error (null: none)."""
    for name, kind in INPUT.items():
        df = df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))
    df = df.withColumns({"request_id": F.coalesce("request_id", F.uuid()), "timestamp": F.coalesce("timestamp", F.current_timestamp())})
    lists = {c: F.coalesce(c, F.array().cast(INPUT[c])) for c in ("external", "retrieved", "files")}
    df = df.withColumns(lists).withColumn("external", F.filter("external", lambda x: F.coalesce(T.strip(x), F.lit("")) != ""))
    return df.withColumn("error", R.validate_request(F.col("user_prompt")))


def prepare_text(df: DataFrame, key: str) -> DataFrame:
    """``df`` parsed, with prepared_input: the record of each request; a request with an error has the error's record."""
    df = parsed(df)
    df = df.withColumns({"_n": T.normalized(F.col("user_prompt")), "_c": context(F.col("conversation"), F.col("files"), F.col("external"), F.col("retrieved"), key)})
    df = df.withColumns({"_user": F.col("_n.normalized"), "_chunks": F.transform("_c", lambda x: x["delimited"]), "_hmacs": F.transform("_c", lambda x: x["hmac"])})
    extracted = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.length(f["content"]))
    df = df.withColumn("_stats", statistics(F.col("_user"), F.col("_chunks"), F.size("files"), extracted))
    df = with_layer0(df, "_user", "_chunks")
    emojis = T.emoji_summary(F.col("_n.emojis"), F.col("_n.emoji_descriptions"))
    layer0 = F.struct(
        "request_id", "timestamp", "normalized_text", "special_char_mask", F.col("_stats.token_estimate").alias("token_count"), F.lit(None).cast("string").alias("text_embedding_hash"), "unicode_analysis", "heuristic_flags",
        (F.size("_hmacs") == F.size("_chunks")).alias("hmac_verified"), F.size("_chunks").alias("external_data_count"), F.array_compact(F.array(F.col("image.description"))).alias("attachment_texts"),
        F.size("_n.emojis").alias("emoji_count"), F.col("_n.emoji_descriptions").alias("emoji_descriptions"), F.col("_stats.char_total").alias("char_total"), "suspicious_score", F.lit(True).alias("raw_text_snapshot_stored"),
    )
    made = package(F.col("user_prompt"), F.col("_user"), F.col("_chunks"), F.col("_n.emoji_descriptions"), F.col("_hmacs"), F.col("_stats"), F.col("image"), emojis, F.col("_l"))
    df = df.withColumn("_l", layer0)
    failed = error_record(F.col("error"), F.when(F.lit(False), F.col("_l")))
    df = df.withColumn("prepared_input", F.when(F.col("error").isNull(), made).otherwise(failed)).drop("_l")
    return df.drop("_n", "_c", "_user", "_chunks", "_hmacs", "_stats", *LAYER0)


def package(prompt: Column, user: Column, external: Column, emoji_descriptions: Column, hmacs: Column, stats: Column, image: Column, emojis: Column, layer0: Column) -> Column:
    """The prepared record of columns and of request_id, timestamp, session_id and files."""
    stub = F.struct(prompt.alias("original_user_prompt"), user.alias("normalized_user"), external.alias("normalized_external"), emoji_descriptions.alias("emoji_descriptions"), hmacs.alias("hmacs"), stats.alias("stats"))
    about = F.struct("request_id", "timestamp", "session_id", (F.size(external) > 0).alias("rag_enabled"), (image.isNotNull() | (emojis["count"] > 0)).alias("has_media"), (F.size("files") > 0).alias("has_file"), F.lit(0.0).alias("prep_time_ms"))
    return F.struct(stub.alias("text_embed_stub"), F.struct(image.alias("image"), emojis.alias("emoji_summary")).alias("image_emoji_stub"), about.alias("metadata"), layer0.alias("layer0"))


def error_record(error: Column, layer0: Column) -> Column:
    """The record of a request that could not be prepared: the error stands where the text would."""
    text = F.concat(F.lit("ERROR: "), error)
    stats = F.struct(F.lit(0).cast("long").alias("char_total"), F.lit(0).cast("long").alias("token_estimate"), F.lit(0.0).alias("user_external_ratio"), F.lit(0).cast("long").alias("file_chunks_count"), F.lit(0).cast("long").alias("extracted_total_chars"))
    stub = F.struct(text.alias("original_user_prompt"), text.alias("normalized_user"), _none().alias("normalized_external"), _none().alias("emoji_descriptions"), _none().alias("hmacs"), stats.alias("stats"))
    blank = F.lit(None).cast("string")
    image = F.struct(blank.alias("hash"), blank.alias("format"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("array<int>").alias("dimensions"), blank.alias("description"), error.alias("error"))
    emojis = F.struct(F.lit(0).alias("count"), _none().alias("types"), _none().alias("descriptions"))
    about = F.struct("request_id", "timestamp", blank.alias("session_id"), F.lit(False).alias("rag_enabled"), F.lit(False).alias("has_media"), F.lit(False).alias("has_file"), F.lit(0.0).alias("prep_time_ms"))
    return F.struct(stub.alias("text_embed_stub"), F.struct(image.alias("image"), emojis.alias("emoji_summary")).alias("image_emoji_stub"), about.alias("metadata"), layer0.alias("layer0"))


def payload_error(p: Column) -> Column:
    """The first fault of a prepared record; null of a sound one."""
    stub = p["text_embed_stub"]
    stats, external, hmacs = stub["stats"], F.size(stub["normalized_external"]), F.size(stub["hmacs"])
    ratio = stats["user_external_ratio"]
    return R.first_error(
        (F.coalesce(p["metadata"]["request_id"], F.lit("")) == "", "Missing request ID"),
        (F.coalesce(stub["normalized_user"], F.lit("")) == "", "Empty user input"),
        (external != hmacs, F.concat(F.lit("HMAC count ("), hmacs.cast("string"), F.lit(") doesn't match external chunks ("), external.cast("string"), F.lit(")"))),
        (stats["token_estimate"] < 0, "Invalid token estimate (negative)"),
        (stats["char_total"] < 0, "Invalid character count (negative)"),
        (~ratio.between(0, 1), F.concat(F.lit("Invalid user/external ratio: "), ratio.cast("string"))),
    )


def payload_summary(p: Column) -> Column:
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    stub, about = p["text_embed_stub"], p["metadata"]
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Request: "), about["request_id"]),
        F.format_string("Time: %.2fms", about["prep_time_ms"]),
        F.concat(F.lit("Tokens: "), stub["stats"]["token_estimate"].cast("string")),
        F.concat(F.lit("Chars: "), stub["stats"]["char_total"].cast("string")),
        F.concat(F.lit("External chunks: "), F.size(stub["normalized_external"]).cast("string")),
        F.concat(F.lit("RAG: "), yes(about["rag_enabled"])),
        F.concat(F.lit("File: "), yes(about["has_file"])),
        F.concat(F.lit("Media: "), yes(about["has_media"])),
        F.concat(F.lit("Emojis: "), p["image_emoji_stub"]["emoji_summary"]["count"].cast("string")),
    )


def prepare_media(df: DataFrame, key: str) -> DataFrame:
    """``prepare_text`` of requests with images and no context: prompt, image and emojis only."""
    return prepare_text(df.drop("conversation", "external", "retrieved", "files"), key)


def prepare_layer0(df: DataFrame, key: str) -> DataFrame:
    """``df`` parsed, with LAYER0, token_count, char_total and hmac_verified over the normalised prompt and external texts; a prompt and texts count without a blank between them."""
    df = parsed(df)
    df = df.withColumns({"_user": T.normalize(F.col("user_prompt")), "_joined": F.array_join("external", "\x00")})
    # One call for all texts of a row: NUL is a control that normalising would drop, so the texts are joined after it.
    pieces = df.select("*", F.transform(F.split("_joined", "\x00"), lambda x: T.normalize_whitespace(T.remove_controls(x))).alias("_ext"))
    pieces = pieces.withColumn("_ext", F.when(F.size("external") > 0, F.split(T.nfkc(F.array_join("_ext", "\x00")), "\x00")).otherwise(_none()))
    total = F.length("_user") + F.aggregate("_ext", F.lit(0), lambda s, x: s + F.length(x))
    made = with_layer0(pieces.withColumns({"token_count": T.estimate_tokens(F.concat("_user", F.array_join("_ext", " "))), "char_total": total, "hmac_verified": F.size(signed_external(F.col("external"), key)) > 0}), "_user", "_ext")
    return made.drop("_user", "_joined", "_ext")
