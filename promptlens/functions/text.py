"""Text columns: sanitising, normalising, tokens, hashes, delimiters."""

from __future__ import annotations

import hashlib
import unicodedata
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from promptlens.functions.patterns import POLICIES, SANITIZE, TOPICS, pyre

WHITE = r"(?U)[\s\x1c-\x1f]+"


ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, ENDS, "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: Characters that NFKC leaves as they are, and that no other of them combines with.
STABLE = r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{482}\x{48A}-\x{52F}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2022}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}"


def nfkc(c: Column) -> Column:
    """Unicode NFKC; only texts with a character beyond STABLE travel to Python."""
    other = F.rlike(c, F.lit(f"[^{STABLE}]"))
    return F.coalesce(_nfkc(F.when(other, c)), c)


def sanitize(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pattern, ci in SANITIZE:
        c = F.regexp_replace(c, pyre(pattern, ci), "")
    c = F.regexp_replace(nfkc(c), r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "")
    return F.trim(F.regexp_replace(c, WHITE, " "))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), "\n\n+", "\n")
    return strip(F.translate(c, "\t", " "))


def remove_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", "")


def emojis(c: Column) -> Column:
    block = r"([\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{2600}-\x{27BF}])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(block), F.lit(1))))


def normalize(c: Column) -> Column:
    return normalize_whitespace(nfkc(remove_controls(F.coalesce(c, F.lit("")))))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " "))) / 4)


def ratio(user: Column, external: Column) -> Column:
    return ratio_of(F.length(user), F.length(external))


def ratio_of(u: Column, e: Column) -> Column:
    """The share of the first of two lengths: 0 of nothing, 1 without the other."""
    return F.when(u + e == 0, F.lit(0.0)).when(e == 0, F.lit(1.0)).otherwise(F.round(F.try_divide(u, u + e), 3))


def delimit(c: Column, kind: str = "external") -> Column:
    tag = "CONVERSATION" if kind == "conversation" else "EXTERNAL"
    return F.concat(F.lit(f"[{tag}]"), c, F.lit(f"[/{tag}]"))


def undelimit(c: Column) -> Column:
    """Each marker at an end goes by itself, those of external data first; a pair need not be whole."""
    c = strip(c)
    for tag in ("EXTERNAL", "CONVERSATION"):
        c = F.regexp_replace(F.regexp_replace(c, rf"^\[{tag}\]", ""), rf"\[/{tag}\]\z", "")
    return c


def hmac_sha256(c: Column, key: str) -> Column:
    if not key:
        raise ValueError("the key is empty")
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = [F.lit(bytes(b ^ x for b in raw)) for x in (0x36, 0x5C)]
    inner = F.sha2(F.concat(pads[0], F.encode(c, "utf-8")), 256)
    return F.sha2(F.concat(pads[1], F.unhex(inner)), 256)


def verify_hmac(c: Column, signature: Column, key: str) -> Column:
    return F.coalesce(hmac_sha256(c, key) == signature, F.lit(False))


def dedup_key(c: Column) -> Column:
    return F.substring(F.md5(F.lower(strip(c))), 1, 12)


def file_stem(c: Column, most: int = 50) -> Column:
    name = F.trim(F.substring(F.regexp_replace(c, r"(?U)[^\p{Alnum} _-]", "_"), 1, most))
    return F.coalesce(F.nullif(F.replace(name, F.lit(" "), F.lit("_")), F.lit("")), F.lit("output"))


def policy(c: Column) -> Column:
    """The name of a known policy, white space at its ends left out; of any other its words as they are, joined by ``_``."""
    known = F.lower(strip(c))
    return F.when(known.isin(POLICIES), F.replace(known, F.lit(" "), F.lit("_"))).otherwise(F.replace(F.lower(c), F.lit(" "), F.lit("_")))


def topic(c: Column) -> Column:
    """The first topic of which a word occurs anywhere in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(F.rlike(low, F.lit("|".join(words))), F.lit(name)) for name, words in TOPICS], F.lit("general"))


@F.pandas_udf(ArrayType(StringType()))
def _emoji_names(found: pd.Series) -> pd.Series:
    name = lambda e: unicodedata.name(e, "").lower().replace(" ", "_").replace("-", "_")
    return found.map(lambda es: None if es is None else [f":{name(e)}:" if name(e) else f"emoji_{i}" for i, e in enumerate(es)])


def emoji_descriptions(found: Column) -> Column:
    """The name of each emoji of an array, ``emoji_<place>`` of one without a name."""
    return _emoji_names(found)


def demojize(c: Column) -> Column:
    """Every emoji replaced by its ``:name:``; the distinct ones of a text are named once and put in by a fold."""
    found = emojis(c)
    named = F.arrays_zip(found.alias("e"), emoji_descriptions(found).alias("n"))
    return F.aggregate(named, c, lambda text, x: F.replace(text, x["e"], x["n"]))


def normalized(c: Column, keep_emojis: bool = True) -> Column:
    """normalized, emojis and emoji_descriptions of a text; emojis are listed before controls go."""
    found = emojis(F.coalesce(c, F.lit("")))
    own = normalize(c)
    return F.struct((own if keep_emojis else demojize(own)).alias("normalized"), found.alias("emojis"), emoji_descriptions(found).alias("emoji_descriptions"))


def normalized_with_source(c: Column, source: Column, keep_emojis: bool = True) -> Column:
    """``normalized`` with its source and both lengths."""
    own = normalized(c, keep_emojis)
    return F.struct(own["normalized"].alias("normalized"), own["emojis"].alias("emojis"), own["emoji_descriptions"].alias("emoji_descriptions"), source.alias("source"), F.coalesce(F.length(c), F.lit(0)).alias("original_length"), F.length(own["normalized"]).alias("normalized_length"))


def sources_of(texts: Column, sources: Column | None = None) -> Column:
    """The source of each text of an array: as given, ``text_<place>`` without any; an error if there are more or fewer."""
    if sources is None:
        return F.transform(texts, lambda _, i: F.concat(F.lit("text_"), i.cast("string")))
    return F.when(F.size(texts) == F.size(sources), sources).otherwise(F.raise_error(F.lit("texts and sources differ in number")))


def emoji_summary(found: Column, descriptions: Column) -> Column:
    return F.struct(F.size(found).alias("count"), found.alias("types"), descriptions.alias("descriptions"))


def count_characters(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def accurate_tokens(c: Column, vocabulary: str | None) -> Column:
    """Tokens by the byte-pair ranks of a ``.tiktoken`` file; the simple estimate without one."""
    if vocabulary is None:
        return estimate_tokens(c)

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        own = _encoding(vocabulary)
        return text.map(lambda t: len(own.encode_ordinary(t)) if t else 0)

    return count(c)


_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        lines = [x.split() for x in Path(path).read_bytes().splitlines() if x]
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=words, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def sign_all(chunks: Column, key: str) -> Column:
    """The signature of each text of an array."""
    return F.transform(chunks, lambda c: hmac_sha256(c, key))


def verify_all(chunks: Column, signatures: Column, key: str) -> Column:
    """Whether each text has its signature; none has if there are more or fewer signatures than texts."""
    pairs = F.zip_with(chunks, signatures, lambda c, s: verify_hmac(c, s, key))
    return F.when(F.size(chunks) == F.size(signatures), pairs).otherwise(F.transform(chunks, lambda _: F.lit(False)))


def sign_chunk(c: Column, key: str, kind: str = "external") -> Column:
    """The text between its markers, and the signature of the bare text."""
    return F.struct(delimit(c, kind).alias("delimited"), hmac_sha256(c, key).alias("hmac"))


def verify_chunk(delimited: Column, signature: Column, key: str) -> Column:
    return verify_hmac(undelimit(delimited), signature, key)


def embedding_hash(vector: Column) -> Column:
    """A fingerprint of a vector: half the SHA-256 of its 32-bit floats, little-endian."""

    @F.pandas_udf(StringType())
    def digest(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None or not len(v) else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest()[:32])

    return digest(vector)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
