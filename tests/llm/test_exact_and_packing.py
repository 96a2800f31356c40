import random
import zlib

import duckdb
import numpy as np
import pytest
from promptlens.llm import exact_dedup, packing
from promptlens.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int, norm string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in rows], DOCS)


def test_exact_dedup_matches_oracle_with_odd_rows(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, ""), (5, None), (6, " "), (7, "é"), (8, "x" * 200_000), (9, "x" * 200_000), (10, "a b")]
    got = {tuple(r) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = set(con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.ORACLE})").fetchall())
    assert got == want


def test_exact_dedup_null_ids_repeats_and_empty_table(spark):
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs(spark, [(None, "q"), (3, "q"), (3, "q")])).collect()]
    assert sorted(got, key=str) == [(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def plain_bfd(lengths, size):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(size - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(30))
def test_counted_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 10, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.choice([0, 1, 30, 200]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    left, places = {}, 0
    for length, _, n, first, per, offset in packing.best_fit_decreasing(counts, size).itertuples(index=False):
        for k in range(n):
            b = first + k // per
            assert size - left.get(b, size) == offset + k % per * length  # gapless
            left[b] = left.get(b, size) - length
            places += 1
    assert places == len(lengths)
    assert sorted(left.values()) == plain_bfd(lengths, size)


def test_pack_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    rows = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 3000), (5, "日本語 ½ ²x <|endoftext|>"), (5, "again"), (None, "no id"), (6, "hello world")]
    got = packing.pack(docs(spark, rows), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).toPandas()
    slow = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    have = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert packing.pack(docs(spark, []), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).count() == 0


def test_both_encoders_agree(spark):
    encode = packing.encoder(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert list(encode(r.text)) == encode.slow.encode(r.text, add_special_tokens=False).ids


def test_registered_packing_has_the_ids_of_the_unmodified_tokenizer(spark, tmp_path):
    from promptlens.llm import queries
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "日本 <|endoftext|>"), (3, "<|endoftext|><|endoftext|>"), (4, "<|endoftext"), (5, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert ids[1] == [64, 220, 50256, 275, 2]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op3_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_very_long_white_space_and_words_are_encoded():
    import time

    from promptlens.llm import packing
    from promptlens.llm.queries import tokenizer_file

    encode = packing.encoder(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), True)
    for text in (" " * 2_000_000 + "a", "\n" * 2_000_000 + "a", "x" + " \n" * 1_000_000, "ab" * 200_000, "a" + " " * 999 + "b"):
        began = time.time()
        ids = encode(text)
        assert encode.slow.decode(ids.tolist(), skip_special_tokens=False) == text and time.time() - began < 60
