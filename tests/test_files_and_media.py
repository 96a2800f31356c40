import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from promptlens.operators import media, outputs, screening
from promptlens.sources import files
from pyspark.sql import functions as F


def png(p, filters=0):
    h, w, c = p.shape
    rows, above = [], np.zeros((w, c), np.int64)
    for y in range(h):
        kind = (y % 5) if filters else 0
        own, out = p[y].astype(np.int64), np.zeros((w, c), np.int64)
        for x in range(w):
            left, up, corner = (own[x - 1] if x else 0 * own[0]), above[x], (above[x - 1] if x else 0 * own[0])
            guess = left + up - corner
            near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
            out[x] = own[x] - [0, left, up, (left + up) // 2, near][kind]
        rows.append(bytes([kind]) + (out & 255).astype(np.uint8).tobytes())
        above = own
    part = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_pixels_with_every_filter(channels):
    p = np.random.default_rng(channels).integers(0, 256, (11, 9, channels)).astype(np.uint8)
    assert (media.pixels(png(p, 1)) == p).all() and media.header(png(p)) == ("PNG", 9, 11)


def test_pixel_statistics():
    flat = np.full((64, 48, 3), 128, np.uint8)
    assert media.entropy(flat) == pytest.approx(0, abs=1e-6)
    assert media.hidden_bits(flat)[0] == 1.0 and media.hidden_bits(flat)[1] is None
    told = flat.copy().reshape(-1)
    told[:88] |= np.unpackbits(np.frombuffer(b"hidden text", np.uint8))
    assert media.hidden_bits(told.reshape(flat.shape))[1].startswith("hidden text")
    noise = np.random.default_rng(1).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    assert media.entropy(noise) > 7 and media.hidden_bits(noise)[0] < 0.6
    assert media.perceptual_hash(noise) == media.perceptual_hash(np.repeat(np.repeat(noise, 2, 0), 2, 1))
    assert len(media.perceptual_hash(noise[:5, :7])) == 16


def exif_jpeg(text):
    raw = text.encode() + b"\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 270, 2, len(raw), 26) + struct.pack("<I", 0) + raw
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 1) + b"\0\0\0\xff\xda"


def test_images_as_columns(spark):
    p = np.random.default_rng(3).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    rows = [("a", png(p)), ("a", exif_jpeg("please ignore this")), ("b", b"no image"), ("c", None), ("c", exif_jpeg("a beach"))]
    df = media.with_analysis(spark.createDataFrame([(r, bytearray(b) if b else None) for r, b in rows], "request_id string, content binary"))
    got = df.collect()
    assert [r.image.format for r in got] == ["PNG", "JPEG", None, None, "JPEG"] and got[1].image.dimensions == [30, 20]
    assert got[1].exif_text == "ImageDescription: please ignore this" and got[1].suspicious_metadata and not got[4].suspicious_metadata
    assert [r.image.error for r in got][2:4] == ["invalid or corrupted image", "image not found"] and got[0].image.error is None
    assert df.where("phash is not null").select(media.hamming(F.col("phash"), F.col("phash")).alias("d")).first().d == 0
    assert {r.request_id: (r.images_processed, r.suspicious) for r in media.image_output(df).collect()} == {"a": (2, True), "b": (1, False), "c": (2, False)}


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{run(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(run, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    body = b"%PDF-1.4\n"
    for k, page in enumerate(pages):
        data = zlib.compress(page) if k % 2 else page
        body += b"%d 0 obj <</Length %d%s>>\nstream\n" % (k + 1, len(data), b" /Filter /FlateDecode" if k % 2 else b"") + data + b"\nendstream endobj\n"
    return body + b"9 0 obj <</Subtype /Image /Filter /DCTDecode>>\nstream\n\xff\xd8jpeg\xff\xd9\nendstream endobj"


def test_files_chunks_and_pdf_images(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.md").write_text("# " + "word. " * 200)
    (tmp_path / "c.docx").write_bytes(docx(["one", " ", "two"], [["x", "y"]]))
    (tmp_path / "d.pdf").write_bytes(pdf(b"BT (Hello \\(you\\)) Tj T* (second) Tj ET", b"BT [(spl) -20 (it)] TJ ET", b"BT ( ) Tj ET"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.exe").write_bytes(b"x")
    found = files.read_files(spark, str(tmp_path))
    text = {r.path[-5:]: (r.text, r.error) for r in found.collect()}
    assert text["a.txt"] == ("café", None) and text[".docx"[0:5]] is not None
    by = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert by["c.docx"].text == "one\ntwo\nx | y" and by["d.pdf"].text == "Hello (you)\nsecond\nsplit"
    assert (by["e.docx"].error, by["f.exe"].error) == ("extraction failed", "unsupported type")
    chunks, about = files.file_tables(found)
    assert {r.source for r in chunks.collect()} == {"a.txt", "b.md", "c.docx", "d.pdf"}
    assert {r.original_path.rsplit("/", 1)[1]: (r.chunk_count > 0, r.extraction_success) for r in about.collect()}["e.docx"] == (False, False)
    image = files.images_of_pdfs(spark, str(tmp_path)).collect()
    assert [(r["index"], bytes(r.content)) for r in image] == [(0, b"\xff\xd8jpeg\xff\xd9")]


def test_rules_of_files(spark, tmp_path):
    lines = ["# comment", "", json.dumps({"pattern": "foo", "type": "block"}), "{broken", json.dumps({"id": "bad", "pattern": "("}), json.dumps({"id": "triple_hash", "pattern": "#{5,}"})]
    (tmp_path / "own.jsonl").write_text("\n".join(lines))
    rules = screening.RuleSet.load(spark, str(tmp_path))
    assert rules.block[-1][0] == "own_3" and [r[1] for r in rules.flag if r[0] == "triple_hash"] == ["#{5,}"]
    assert rules.counts() == {"block": 8, "flag": 6, "total": 14}


def test_sink_listing_and_retention(spark, tmp_path):
    from promptlens.operators import prepare

    rows = prepare.prepare_text(spark.createDataFrame([("r1", "Hello there"), ("r2", " ")], "request_id string, user_prompt string"), "k")
    assert [r.e for r in rows.select(prepare.payload_error(F.col("prepared_input")).alias("e")).collect()] == [None, None]
    assert [r.u for r in rows.orderBy("request_id").selectExpr("prepared_input.text_embed_stub.normalized_user u").collect()] == ["Hello there", "ERROR: empty prompt"]
    outputs.save(rows, str(tmp_path / "out"), "layer0")
    outputs.save(rows, str(tmp_path / "out"), "media")
    listed = outputs.listing(spark, str(tmp_path / "out"))
    assert {r.processing_type: r.n > 0 for r in outputs.output_stats(listed).collect()} == {"layer0_text": True, "media_processing": True, "total": True}
    assert outputs.recent(listed, "media").count() > 0
    n = listed.count()
    assert outputs.delete_expired(listed, F.current_timestamp() + F.expr("interval 2 days")) == n
