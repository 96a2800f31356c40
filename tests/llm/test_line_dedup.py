import random
import re

import pytest
from promptlens.llm import line_dedup

DOCS = "doc_id long, text string, line int, k1 long, n int, removed string"


def plain(rows):
    lines = [(i, k, set(re.findall(r"[^\W_]+", x.lower()))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    out = {i: [0, []] for i, _ in rows}
    for at, (i, k, s) in enumerate(lines):
        out[i][0] += 1
        if s and any(len(s & o) >= 0.8 * len(s | o) for _, _, o in lines[:at]):
            out[i][1].append(k)
    return {i: (n, sorted(r)) for i, (n, r) in out.items()}


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "the", "of"] * 5
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(30)]

    def line():
        own = list(rng.choice(base))
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
        return rng.choice([" ", ", ", " - "]).join(own)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 8)))) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (93, "A b\nb, a!\n"), (94, "long " * 50_000), (None, "A B"), (95, "a×b «ça» ÷ c\nA b ça c\n日本 語\u2026x")]
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows)
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(df, bits=12).collect()}
    assert kept[93] == "A b\n" and kept[None] == "" and kept[90] is None
    assert line_dedup.removed_lines(df.limit(0), bits=12).count() == 0


def test_ties_repeats_and_the_threshold_itself(spark):
    words = [f"w{i}" for i in range(9)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:8], "x"])), (3, " ".join(words[:8])), (4, " ".join([*words, "y", "z"])), (5, " ".join(words[:4])), (6, " ".join(words[:5]))]
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    # 8 of 10 tokens, 8 of 9, 9 of 11, and 4 of 5, the threshold itself; the row that repeats is one line twice.
    assert got == {1: (2, []), 2: (1, [0]), 3: (1, [0]), 4: (1, [0]), 5: (1, []), 6: (1, [0])}


def test_many_near_copies_of_one_line(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        own = [f"w{k}" for k in range(30)]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(30)] = f"z{rng.randint(0, 999)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows) and sum(len(r) for _, r in got.values()) > 60


def test_the_join_shuffles_its_postings_once(spark, monkeypatch):
    plans, real = [], line_dedup.stash

    def seen(df, tag):
        if tag == "line-pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, tag)

    monkeypatch.setattr(line_dedup, "stash", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is not adaptive shows reuse before it runs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_dedup.removed_lines(spark.createDataFrame([(i, f"a b c d {i}\nf g h i {i % 3}", 0, 0, 0, "") for i in range(9)], DOCS), bits=12).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("- Exchange hashpartitioning(token") == 1 and "ReusedExchange" in plans[0]


def test_pairs_are_verified_in_parts_and_without_python_workers(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"v{rng.randint(0, 400)}" for _ in range(20)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join([*base[:19], "x"])), (3 * i + 2, " ".join([*base[:14], *(f"y{k}" for k in range(6))]))]
    plans, sizes, real = [], [], line_dedup.stash

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = real(df, tag)
        if tag.endswith("-sets"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stash", seen)
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows) and sum(len(r) for _, r in got.values()) >= 55
    assert not any(word in p for p in plans for word in ("MapInArrow", "Python", "Pandas"))
    assert len(sizes) > 1 and max(sizes) < 120  # two sets for each of 60 pairs would be all at once


def test_pairs_of_long_lines_and_of_small_groups_do_not_grow_with_the_square(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(60):  # long lines that share a rare word, and few others
        rows.append((i, " ".join([f"rare{i // 20}", *(f"u{rng.randint(0, 99_999)}" for _ in range(160)), *(f"c{k}" for k in range(10))])))
    for i in range(6):  # groups of ten near copies, long and short
        own = [f"g{i}x{k}" for k in range(200 if i % 2 else 40)]
        rows += [(100 + 10 * i + c, " ".join([*own[:-1], f"e{c}"])) for c in range(10)]
    rows += [(500, " ".join([*(f"g1x{k}" for k in range(160)), *(f"z{k}" for k in range(40))])), (501, " ".join([*(f"g1x{k}" for k in range(180)), *(f"y{k}" for k in range(21))]))]
    made, real = {}, line_dedup.stash

    def seen(df, tag):
        out = real(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stash", seen)
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows) and sum(len(r) for _, r in got.values()) >= 54
    assert made["line-leaders"] + made["line-pairs"] < 120, made  # 570 pairs share a rare word, 270 are in the groups


@pytest.mark.parametrize("most", [0, 10**9])
def test_words_are_counted_only_where_the_order_by_length_makes_many_pairs(spark, monkeypatch, most):
    rng = random.Random(11)
    rows = []
    for i in range(90):  # long and short lines about the bounds of the classes of length
        own = [f"{'abcdefgh'[k % 8] * (1 + k % 5)}{k}" for k in rng.sample(range(60), rng.choice([4, 5, 6, 16, 17, 20, 21, 24, 25, 30]))]
        rows.append((2 * i, " ".join(own)))
        rows.append((2 * i + 1, " ".join([*own[: len(own) - len(own) // 9], *(f"new{i}" for _ in range(len(own) // 9)), *(f"more{i}x{k}" for k in range(len(own) // rng.choice([5, 9, 20])))])))
    counted, real = [], line_dedup.word_table
    monkeypatch.setattr(line_dedup, "word_table", lambda *a: counted.append(1) or real(*a))
    monkeypatch.setattr(line_dedup, "MOST_PAIRS", most)
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows) and sum(len(r) for _, r in got.values()) > 40
    assert len(counted) == (most == 0)


def test_postings_of_many_lines_are_joined_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        own = [f"p{rng.randint(0, 300)}" for _ in range(20)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:18], f"q{i}", own[19]]))]
    posted, real = [], line_dedup.stash

    def seen(df, tag):
        if tag == "line-pairs" and "Join" in (plan := df._jdf.queryExecution().optimizedPlan().toString()):
            posted.append(plan)
        return real(df, tag)

    monkeypatch.setattr(line_dedup, "stash", seen)
    monkeypatch.setattr(line_dedup, "MANY", 1, raising=False)
    monkeypatch.setattr(line_dedup, "leaders_of", lambda groups, *_: groups.selectExpr("id AS a", "id AS b").limit(0))  # the join finds all
    df = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.removed_lines(df, bits=12).collect()}
    assert got == plain(rows) and sum(len(r) for _, r in got.values()) >= 55
    assert len(posted) == line_dedup.TOKEN_PARTS > 1 and all(f"% {len(posted)}) = {k})" in p for k, p in enumerate(posted))
