import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from promptlens.llm import repeats

DOCS = "doc_id long, text string, key string, n_bytes long, whole boolean, spans string, h long"


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    shared = [word(rng.randint(150, 420)) for _ in range(4)]
    out = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 1000, "xy" * 300, word(700)]
    for _ in range(25):
        out.append("".join(rng.choice([word(rng.randint(0, 250)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 400)]]) for _ in range(rng.randint(1, 6))))
    out += [out[12], out[12], out[13] + "!", "", shared[0]]
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, repeats.HOT), (2, 3), (3, 1)])
def test_matches_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 7)
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "k", 0, True, "s", 1) for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df, hot=hot).collect()}
    assert got == dict(enumerate(plain(rows, 200)))


def test_anchors_of_one_long_text_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    at = np.array([0, 5000])
    whole = {(int(p), int(a)) for _, p0, n, a, _ in zip(*repeats.anchors(data, at), strict=True) for p in range(p0, p0 + n)}
    monkeypatch.setattr(repeats, "_FAR", 700)
    parts = {(int(p), int(a)) for _, p0, n, a, _ in zip(*repeats.anchors(data, at), strict=True) for p in range(p0, p0 + n)}
    assert whole == parts and len(whole) == 4801


def test_text_stage_and_empty_table(spark):
    a = "é" * 150 + "tail one that stays"
    df = spark.createDataFrame([(1, a, "k", 0, True, "s", 1), (2, "other start " + "é" * 150, "k", 0, True, "s", 1), (None, None, "k", 0, True, "s", 1)], DOCS)
    got = {r.doc_id: r.text for r in repeats.without_repeats(df).collect()}
    assert got == {1: "tail one that stays", 2: "other start ", None: None}
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_anchors_of_a_large_batch_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa
    from promptlens.llm import common

    rng = random.Random(5)
    words = [f"w{i}" for i in range(5_000)]
    texts = [" ".join(rng.choices(words, k=4_000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(200)]), pa.array(texts)], ["key", "text"])
    common._POWERS.clear()
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in repeats._anchored(200)(iter([batch])))
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert found > 10_000 and most < 40e6, most
