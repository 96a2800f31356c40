"""Images as binary columns, read with the standard library and arrays: headers, pixels of PNG and BMP, EXIF, statistics.

No image library is at hand.  Headers of PNG, JPEG, GIF, BMP and WEBP are read;
pixels only of PNG (8 bits a channel, not interlaced) and BMP (24 or 32 bits,
not packed): for others entropy, hidden bits and perceptual hash are null.  Text
in images is not recognised.
"""

from __future__ import annotations

import math
import struct
import zlib
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions import patterns as P
from promptlens.functions import text as T

MOST_PIXELS = 1 << 26
_PNG = b"\x89PNG\r\n\x1a\n"
_TAGS = {270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 315: "Artist", 33432: "Copyright", 37510: "UserComment", 40091: "XPTitle", 40092: "XPComment", 40094: "XPKeywords", 40095: "XPSubject", 34665: "_exif"}


def header(b: bytes) -> tuple[str, int, int] | None:
    """(format, width, height); null of what is no image."""
    if b[:8] == _PNG and b[12:16] == b"IHDR" and len(b) >= 24:
        return ("PNG", *struct.unpack(">II", b[16:24]))
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return ("GIF", *struct.unpack("<HH", b[6:10]))
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return ("BMP", w, abs(h))
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return ("WEBP", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"))
        if b[12:16] == b"VP8 ":
            return ("WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", b[26:30])))
        bits = int.from_bytes(b[21:25], "little")
        return ("WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
    for marker, body in _segments(b):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            h, w = struct.unpack(">HH", body[1:5])
            return ("JPEG", w, h)
    return None


def _segments(b: bytes):
    """(marker, body) of a JPEG's parts up to its first scan."""
    if b[:2] != b"\xff\xd8":
        return
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] != 0xDA:
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        yield b[at + 1], b[at + 4 : at + 2 + size]
        at += 2 + size


def pixels(b: bytes) -> np.ndarray | None:
    """(height, width, channels) in 8 bits."""
    head = header(b)
    if head is None or head[1] * head[2] > MOST_PIXELS:
        return None
    try:
        return _png(b) if head[0] == "PNG" else _bmp(b) if head[0] == "BMP" else None
    except (zlib.error, ValueError, struct.error, IndexError):
        return None


def _bmp(b: bytes) -> np.ndarray | None:
    start, (w, h), bits, packed = struct.unpack("<I", b[10:14])[0], struct.unpack("<ii", b[18:26]), *struct.unpack("<HI", b[28:34])
    if bits not in (24, 32) or packed:
        return None
    row = (w * bits // 8 + 3) // 4 * 4
    own = np.frombuffer(b, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (own[::-1] if h > 0 else own)[:, :, 2::-1]


def _png(b: bytes) -> np.ndarray | None:
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", b[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or laced or channels is None:
        return None
    at, data, palette = 8, [], None
    while at + 8 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        name, body = b[at + 4 : at + 8], b[at + 8 : at + 8 + size]
        if name == b"IDAT":
            data.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w, channels), np.uint8)
    for y in range(h):
        out[y + 1] = _unfiltered(int(rows[y, 0]), rows[y, 1:].reshape(w, channels), out[y])
    out = out[1:]
    return palette[out[:, :, 0]] if kind == 3 and palette is not None else out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + above
    out = np.zeros_like(row)
    left, corner = np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    up = above.astype(np.int64)
    for x in range(len(row)):
        if kind == 3:
            near = (left + up[x]) // 2
        else:
            p = left + up[x] - corner
            far = np.abs(np.stack([p - left, p - up[x], p - corner]))
            near = np.choose(far.argmin(axis=0), [left, up[x], corner])
        out[x] = (row[x] + near) & 255
        left, corner = out[x].astype(np.int64), up[x]
    return out


def grey(p: np.ndarray) -> np.ndarray:
    """Luminance in 8 bits."""
    if p.shape[2] < 3:
        return p[:, :, 0]
    return ((p[:, :, 0].astype(np.int64) * 19595 + p[:, :, 1].astype(np.int64) * 38470 + p[:, :, 2].astype(np.int64) * 7471 + 0x8000) >> 16).astype(np.uint8)


def entropy(p: np.ndarray) -> float:
    """Of the grey values, in bits."""
    share = np.bincount(grey(p).ravel(), minlength=256) / (p.shape[0] * p.shape[1])
    return float(-(share * np.log2(share + 1e-10)).sum())


def hidden_bits(p: np.ndarray) -> tuple[float, str | None]:
    """How far the lowest bits of red, green and blue are from even, 0 to 1, and beyond 0.6 the ASCII text of the first 800."""
    low = (p if p.shape[2] >= 3 else np.repeat(p[:, :, :1], 3, axis=2))[:, :, :3].ravel() & 1
    half, ones = len(low) / 2, int(low.sum())
    score = min(2 * (ones - half) ** 2 / half / 100, 1.0)
    text = np.packbits(low[:800]).tobytes().decode("ascii", "ignore") if score > 0.6 else ""
    return float(score), text[:100] if any(c.isprintable() and not c.isspace() for c in text) else None


def _reduced(g: np.ndarray, axis: int) -> np.ndarray:
    """32 means along an axis; of fewer values some stand more than once."""
    n = g.shape[axis]
    cuts = np.arange(32) * n // 32
    if n < 32:
        return np.take(g, cuts, axis)
    size = np.diff(np.append(cuts, n)).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.add.reduceat(g, cuts, axis) / size


def perceptual_hash(p: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of a 32 x 32 reduction exceed their median."""
    g = _reduced(_reduced(grey(p).astype(np.float64), 0), 1)
    wave = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)
    low = wave @ g @ wave.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if x else '0' for x in bits), 2):016x}"


def exif(b: bytes) -> dict[str, str]:
    """Text tags of a JPEG's EXIF part."""
    body = next((s[6:] for m, s in _segments(b) if m == 0xE1 and s[:6] == b"Exif\0\0"), None)
    if body is None or body[:2] not in (b"II", b"MM"):
        return {}
    end = "<" if body[:2] == b"II" else ">"
    found: dict[str, str] = {}
    todo, seen = [struct.unpack(end + "I", body[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(body):
            continue
        seen.add(at)
        for k in range(struct.unpack(end + "H", body[at : at + 2])[0]):
            entry = body[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, n, value = struct.unpack(end + "HHII", entry)
            name = _TAGS.get(tag)
            if name == "_exif":
                todo.append(value)
            elif name and kind in (1, 2, 7):
                raw = entry[8 : 8 + n] if n <= 4 else body[value : value + n]
                text = raw.decode("utf-16-le", "ignore") if name.startswith("XP") else raw[8:].decode("utf-8", "replace") if name == "UserComment" else raw.decode("utf-8", "replace")
                found[name] = text.rstrip("\0 ")
    return found


def with_image_info(df: DataFrame, content: str = "content", most: int = 10 << 20) -> DataFrame:
    """``df`` with image: hash, format, size_bytes, dimensions, description (null) and error of a binary column, and exif, its text tags."""

    @F.pandas_udf("format string, width int, height int")
    def heads(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([h if (h := header(bytes(b)) if b is not None else None) else (None, None, None) for b in column], columns=["format", "width", "height"])

    @F.pandas_udf("map<string,string>")
    def tags(column: pd.Series) -> pd.Series:
        return column.map(lambda b: exif(bytes(b)) if b is not None else {})

    c = F.col(content)
    df = df.withColumns({"_head": heads(c), "exif": tags(c)})
    size = F.octet_length(c)
    error = F.when(c.isNull(), F.lit("image not found")).when(size > most, F.lit("image too large")).when(F.col("_head.format").isNull(), F.lit("invalid or corrupted image"))
    dims = F.when(F.col("_head.width").isNotNull(), F.array("_head.width", "_head.height"))
    image = F.struct(F.sha2(c, 256).alias("hash"), F.col("_head.format").alias("format"), size.cast("long").alias("size_bytes"), dims.alias("dimensions"), F.lit(None).cast("string").alias("description"), error.alias("error"))
    return df.withColumn("image", image).drop("_head")


def exif_text(tags: Column) -> Column:
    """``Tag: value`` of the text tags, in fixed order; null without any."""
    parts = F.transform(F.filter(F.array(*[F.lit(k) for k in P.EXIF_TEXT]), lambda k: T.strip(F.coalesce(F.element_at(tags, k), F.lit(""))) != ""), lambda k: F.concat(k, F.lit(": "), F.element_at(tags, k)))
    return F.nullif(F.array_join(parts, " | "), F.lit(""))


def exif_suspicious(tags: Column) -> Column:
    values = F.transform(F.array(*[F.lit(k) for k in P.EXIF_TEXT]), lambda k: F.lower(F.coalesce(F.element_at(tags, k), F.lit(""))))
    joined = F.array_join(values, "\x00")
    found = F.lit(False)
    for x in P.EXIF_SUSPICIOUS:
        found = found | F.contains(joined, F.lit(x))
    return found


def with_analysis(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with phash, entropy, stego_score, payload, exif_text, and what of it is suspicious: tags, entropy over 7.5, hidden bits over 0.6."""

    @F.pandas_udf("phash string, entropy double, stego_score double, payload string")
    def measure(column: pd.Series) -> pd.DataFrame:
        rows = []
        for b in column:
            p = pixels(bytes(b)) if b is not None else None
            rows.append((None, None, 0.0, None) if p is None else (perceptual_hash(p), entropy(p), *hidden_bits(p)))
        return pd.DataFrame(rows, columns=["phash", "entropy", "stego_score", "payload"])

    df = with_image_info(df, content).withColumn("_m", measure(F.col(content)))
    df = df.select("*", "_m.*").drop("_m").withColumns({"exif_text": exif_text(F.col("exif")), "suspicious_metadata": exif_suspicious(F.col("exif"))})
    return df.withColumns({"suspicious_entropy": F.coalesce(F.col("entropy") > 7.5, F.lit(False)), "steganography": F.col("stego_score") > 0.6})


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two perceptual hashes differ."""
    number = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    signed = lambda x: F.when(number(x) >= big(2**63), number(x) - big(2**64)).otherwise(number(x)).cast("long")
    return F.bit_count(signed(a).bitwiseXOR(signed(b)))


def image_output(images: DataFrame) -> DataFrame:
    """One row of each request_id: images, whether any is suspicious, the greatest stego_score and the texts found (images of one request are few)."""
    bad = F.col("suspicious_metadata") | F.col("suspicious_entropy") | F.col("steganography")
    return images.groupBy("request_id").agg(F.count(F.lit(1)).alias("images_processed"), F.bool_or(bad).alias("suspicious"), F.bool_or("steganography").alias("stego_detected"), F.max("stego_score").alias("stego_score"), F.array_sort(F.collect_set("exif_text")).alias("texts"))


def placeholders() -> dict[str, Column]:
    """The two constant columns that stand for analyses without a model."""
    return {"steganography_check": F.lit("not_implemented"), "image_description": F.lit(None).cast("string")}


def capabilities() -> dict[str, bool]:
    """Which kinds of analysis this installation has."""
    has = lambda name: find_spec(name) is not None
    return {"txt": True, "md": True, "docx": True, "pdf": True, "image_headers": True, "image_pixels": True, "exif": True, "ocr": has("pytesseract"), "embeddings": has("sentence_transformers"), "generation": has("transformers"), "accurate_tokens": has("tiktoken")}


