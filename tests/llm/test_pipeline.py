import random

import corpus_pipeline as p

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 99_999)}" for _ in range(n)]


def test_one_whole_row_stays_of_repeated_and_null_id_rows(spark):
    twice, bare, near, once = (prose(s) for s in range(4))
    edited = [*near[:-1], "other"]
    texts = [(1, twice), (1, twice), (None, bare), (None, bare), (None, near), (None, edited), (None, near), (5, once), (5, [*once[:-2], "a", "b"]), (7, prose(8)), (7, prose(9)), (None, prose(10))]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in texts] + [(3, "a b", "en", "s", 3), (3, "ab", "en", "s", 2), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for stage in (p.exact_stage, p.near_stage, p.repeats_stage):
        docs = stage(spark, docs, "")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [(r.doc_id, r.text or "") for r in docs.collect()]
    # One row of each group or class, with its text whole.
    either = [{" ".join(near), " ".join(edited)}, {" ".join(once), " ".join([*once[:-2], "a", "b"])}]
    for one in either:
        assert len([t for _, t in got if t in one]) == 1
    rest = sorted(((i, t) for i, t in got if not any(t in one for one in either)), key=str)
    assert rest == sorted([(1, " ".join(twice)), (None, " ".join(bare)), (7, " ".join(prose(8))), (7, " ".join(prose(9))), (None, " ".join(prose(10))), (3, "a b"), (None, "")], key=str)


def test_stages_with_clashing_columns_and_an_empty_table(spark):
    clash = "score double, predicted int, _text string, _key string, _kept string, held string, size long, bucket long"
    rows = [(i, " ".join(prose(20 + i)), "en", "s", 1, 0.5, 7, "t", "k", "x", "h", 3, 4) for i in range(3)]
    docs = spark.createDataFrame([*rows, rows[0]], f"{DOCS}, {clash}")
    for stage in (p.exact_stage, p.near_stage, p.repeats_stage):
        done = stage(spark, docs, "")
        assert done.columns == docs.columns
        got = done.where("predicted = 7 and _key = 'k' and held = 'h' and score = 0.5").collect()
        assert len(got) == (4 if stage is p.repeats_stage else 3)
        assert stage(spark, docs.limit(0), "").count() == 0
    cut = {r.doc_id: (r.text, r.n_chars) for r in p.repeats_stage(spark, docs, "").collect()}
    assert cut[0] == ("", 0) and cut[1] == (rows[1][1], 1)


def test_quality_stage_with_clashing_columns(spark, tmp_path):
    good, bad = " ".join(prose(1, 300)), "zz " * 200
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}", "en", "s", 1, 0.5, 7, "t") for i in range(80)] + [(None, None, "en", "s", 0, 0.5, 7, "t")]
    docs = spark.createDataFrame(rows, f"{DOCS}, score double, predicted int, _text string")
    spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = p.quality_stage(spark, docs, str(tmp_path))
    assert got.columns == [*docs.columns, p.ROW]
    rows = got.where("predicted = 7").collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == {i for i in range(80) if i % 2}


def removed(texts, length=200):
    """Texts without the bytes of strings of ``length`` bytes that stand more than once."""
    raws = [t.encode() for t in texts]
    seen = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((k, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return [bytes(b for b, g in zip(r, m) if not g).decode() for r, m in zip(raws, gone)]


def test_whole_run_against_plain_stages(spark, tmp_path):
    import re

    from promptlens.llm import packing, quality
    from promptlens.llm.queries import tokenizer_file
    from test_near_join import plain as classes

    rng = random.Random(3)
    shared = " ".join(prose(50, 60))
    texts = [" ".join(prose(100 + i, rng.randint(60, 200))) for i in range(24)]
    texts += [texts[0], f" {texts[1]} ", " ".join([*texts[2].split()[:-1], "edited"]), f"{texts[3]} {shared}", f"{shared} {texts[4]}"] + ["zz " * 200 + str(i) for i in range(24)] + ["", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, texts[5], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int((t or "zz")[:2] != "zz"), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).where("predicted = 1").collect()
    kept: dict = {}
    last = lambda i: (i is None, i or 0)
    for r in sorted(scored, key=lambda r: (-len(r.text or ""), last(r.doc_id))):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), (r.doc_id, r.text or ""))
    rows = sorted(kept.values(), key=lambda r: last(r[0]))
    root = classes([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    encode = packing.encoder(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), True)
    want = sorted(((i, len(encode(t)) + 1) for (i, _), t in zip(rows, removed([t for _, t in rows]))), key=str)
    assert len(want) > 20
    got: dict = {}
    pieces = p.run(spark, str(tmp_path)).collect()
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert sorted(got.items(), key=str) == want
    filled: dict = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024
