import random
import re

import numpy as np
from pyspark.sql import functions as F
from promptlens.llm import near_join, words
from promptlens.llm.components import connected_components

DOCS = "doc_id long, text string, key binary, class long, n int, bands string"


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice("ab cd éf gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 60)) for _ in range(n)]
    out = [None, "", "...", "one two", "ONE, two", "a b c d e", "a b c d e f", "x " * 30_000]
    for _ in range(8):
        base = make(rng.randint(30, 300))
        for _ in range(rng.choice([1, 2, 30])):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randint(0, 9999))
            out.append(rng.choice([" ", ", ", "\n"]).join(edited))
    return out


def test_shingle_sets_match_plain_python():
    import pyarrow as pa
    from promptlens.llm.common import bytes_view

    texts = corpus(3)
    got = words.shingle_sets(*bytes_view(pa.array(texts)))
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]


def test_classes_match_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, b"", 0, 0, "") for i, t in enumerate(texts)], DOCS)
        got = {r.doc_id: r.class_id for r in near_join.near_duplicates(df).collect()}
        assert got == dict(enumerate(plain(texts)))
        assert got == {r.doc_id: r.class_id for r in near_join.near_classes(df).collect()}


def test_forest_unites_what_the_matrix_links():
    rng = np.random.default_rng(2)
    for n, m, p in ((1, 1, 1.0), (30, 20, 0.03), (40, 40, 0.02), (25, 60, 0.5), (10, 10, 0.0)):
        hit = rng.random((n, m)) < p
        i, j = near_join.forest(hit)
        assert hit[i, j].all() and len(i) < n + m

        def parts(links):
            root = list(range(n + m))
            for a, b in links:
                x, y = (root[k] for k in (a, n + b))
                root = [x if r == y else r for r in root]
            return [root.index(r) for r in root]

        assert parts(zip(i, j)) == parts(zip(*np.nonzero(hit)))


def family(seed, n):
    """Texts of which each is above the threshold to its twin only, and shares all its words with many others."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    out = []
    for _ in range(n):
        own = [f"{w}{rng.choice('xy')}" if i % 10 == 0 else w for i, w in enumerate(base)]
        twin = list(own)
        i = 10 * rng.randrange(40)
        twin[i] = base[i] + ("y" if own[i][-1] == "x" else "x")
        out += [" ".join(own), " ".join(twin)]
    return out


def test_links_between_classes_of_a_large_bucket_are_found(spark, monkeypatch):
    for name, n in (("BLOCK", 20), ("WHOLE", 1), ("LEADERS", 1)):
        monkeypatch.setattr(near_join, name, n)
    texts = family(5, 60)
    df = spark.createDataFrame([(i, t, b"", 0, 0, "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.class_id for r in near_join.near_classes(df).collect()}
    assert got == dict(enumerate(plain(texts)))
    assert got == {r.doc_id: r.class_id for r in near_join.near_duplicates(df).collect()}
    none = lambda members, *_: members.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    monkeypatch.setattr(near_join, "outsiders", none)
    assert got != {r.doc_id: r.class_id for r in near_join.near_classes(df).collect()}


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "p q r s t u", b"", 0, 0, ""), (7, "p q r s t u", b"", 0, 0, ""), (7, "p q r s t u", b"", 0, 0, ""), (9, None, b"", 0, 0, "")], DOCS)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()), key=str)
    assert got == [(7, 7, 0), (7, 7, 0), (9, 9, 0), (None, 7, 0)]
    assert near_join.near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = near_join.fewest_matches(0.8, near_join.TOLERANCE)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (20_000, 128)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert near_join.may_reach(a, b, fewest).all()
    low = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert near_join.may_reach(a, low, fewest).mean() < 0.01


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def linked(texts):
    """Of each text, how many distinct other texts are linked to it."""
    own = {t: shingles(t) for t in texts if shingles(t)}
    return [sum(len(own[t] & s) >= 0.8 * len(own[t] | s) for o, s in own.items() if o != t) if t in own else 0 for t in texts]


def test_n_links_counts_every_different_text(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    copies = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in rng.sample(range(300), 50)]
    alike = ["One two, three four five six", "one two three four five six", "ONE two three four five six!", "one two three four five six"]
    texts = copies + [copies[0].upper(), copies[1].replace(" ", ", ")] + alike + ["a lone text of six words", None, "..."]
    df = spark.createDataFrame([(i, t, b"", 0, 0, "") for i, t in enumerate(texts)], DOCS)
    for counted in (512, 7):
        monkeypatch.setattr(near_join, "COUNTED", counted)
        got = {r.doc_id: r.n_links for r in near_join.near_duplicates(df).collect()}
        assert got == dict(enumerate(linked(texts)))


def test_components_take_tasks_by_edges_and_not_by_shuffle_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        # A path of 60, a star whose centre is its largest vertex, a pair and a loop.
        edges = [(i, i + 1) for i in range(60)] + [(199, i) for i in range(100, 199)] + [(301, 300), (400, 400)]
        got = connected_components(spark.createDataFrame(edges, "u long, v long"))
        assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {r.u: r.root for r in got.collect()} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 200)} | {300: 300, 301: 300}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_chains_and_stars(spark, monkeypatch):
    from promptlens.llm import components

    monkeypatch.setattr(components, "TASK_EDGES", 40)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 200)] + [(500, i) for i in range(501, 560)] + [(900 + i, 900 + rng.randrange(i)) for i in range(1, 90)] + [(7, 7), (3, 2), (3, 2)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in rng.sample(edges, len(edges))]
    got = sorted(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect())
    assert got == sorted([(i, 100) for i in range(100, 201)] + [(i, 500) for i in range(500, 560)] + [(900 + i, 900) for i in range(90)] + [(2, 2), (3, 2)])
    # Each task leaves stars, so a table of one task needs no round; what spans tasks needs some.
    monkeypatch.setattr(components, "TASK_EDGES", 1 << 18)
    one = components.connected_components(spark.createDataFrame(edges, "u long, v long").coalesce(1), most_rounds=1).collect()
    assert sorted(tuple(r) for r in one) == got
