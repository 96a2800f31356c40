import re
import zlib

import numpy as np
import pytest
from promptlens.llm import html_text, licenses, quality

DOCS = "doc_id long, text string, score string, predicted string, key string, hits int, labels string, _other int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "p", "k", 1, "l", 2) for i, t in rows], DOCS)


def test_quality_on_held_out_labels(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(d, lab).collect()}
    assert len(got) == d.count()
    own = [(got[r.doc_id], r.quality) for r in lab.collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g, _ in own)
    held = [(g.predicted, q) for g, q in own if g.held_out]
    right = np.mean([p == q for p, q in held])
    print("held-out accuracy", right, len(held))
    assert right >= 0.95
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g, _ in own)


def test_quality_odd_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (None, "x"), (3, "ab" * 60_000), (3, "ab" * 60_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    assert {r.score for r in quality.quality_scores(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0, ""), (3, None, 0, "")], "doc_id long, quality int, toxic int, text string")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(d, one).collect())
    assert quality.quality_scores(d.limit(0), none).count() == 0


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_and_spans(spark):
    t = licenses.TEMPLATES
    texts = [None, "", "MIT", "License", "mit-license, MIT LICENSE cc by", "the GNU\nGeneral Public-License apache license", "é" * 9, "word " * 40_000 + "apache license", "filler here " * 30 + t["bsd"], t["mit"].replace("free of charge", "at no cost") + " end", " ".join(t["gpl"].split()[:9]), t["isc"] + " x " + t["mpl"], t["isc"] + " x " + t["mpl"]]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), i
    assert [got[i].labels for i in (8, 9, 10, 11, 12)] == ["bsd", "mit", "", "isc,mpl", "isc,mpl"]
    assert got[0].score == 0 and got[4].score == 1 and 0.6 <= got[9].score <= 1
    assert licenses.license_scan(docs(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy <b>now</b></div><article><h1>Head &amp; line</h1><p><b>First   part<br><p>A <i>sec</i>ond&nbsp;one &lt;x&gt;.</p><p>ok</p>
<form><input name="q">Sign up</form><aside>Side</aside></article><section id="comments"><article class="comment"><p>Reader says a lot of words here, more than the page itself has.</p></article></section><footer>&copy; foot</footer>"""


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (PAGE, "Head & line First part A second one <x>. ok"),
        (None, ""),
        ("", ""),
        ("<nav>only menu</nav>", ""),
        ("<article><p>cut of", "cut of"),
        ("<main><div>one</div><div>two</main>", "one two"),
        ("plain text only", "plain text only"),
        ("<article>" + "<p>x y</p>" * 5000 + "</article>", " ".join(["x y"] * 5000)),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_extract_keeps_rows(spark):
    p = spark.createDataFrame([(1, "u", PAGE, "t", 1), (None, None, None, "t", 1), (1, "u", PAGE, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(tuple(r) for r in html_text.extract(p).collect() if r.page_id)
    assert got == [(1, "u", "Head & line First part A second one <x>. ok", 43)] * 2
    assert html_text.extract(p.limit(0)).count() == 0


PROSE = "This is a paragraph of the article, long enough to stand out from what is around it on the page. "


def test_parts_inside_an_article_are_named_by_their_last_word():
    from promptlens.llm.html_text import main_text

    leaks = '<div class="ad-container">buy</div><div class="cookie-wrapper">accept</div><div class="x comment-body">first!</div><div id="sidebar-content">links</div>'
    kept = '<section class="login-required">members read this</section><p id="search">about search</p><div class="has-sidebar">wide</div><div class="article-header"><h1>Title</h1></div>'
    page = f"<body><nav>menu</nav><article><p>{PROSE}</p>{leaks}{kept}</article><footer>end</footer></body>"
    assert main_text(page) == f"{PROSE.strip()} members read this about search wide Title"
    assert main_text(f'<div class="comment-body">first!</div><div><p>{PROSE * 3}</p><p>short</p></div>') == f"{(PROSE * 3).strip()} short"
    assert main_text(f'<article class="social"><p>{PROSE}</p><article class="comment">no</article></article>') == PROSE.strip()


def test_ratio_selects_among_regions():
    from promptlens.llm.html_text import main_text

    links = "".join(f'<div><a href="/{i}">go {i}</a></div>' for i in range(30))
    assert main_text(f"<body><div>{links}</div><div><h2>Head</h2><p>{PROSE * 4}</p><p>So.</p><p>{PROSE * 5}</p></div><div>{links}</div></body>") == f"Head {(PROSE * 4).strip()} So. {(PROSE * 5).strip()}"
    several = f"<article>{links}</article><article><p>{PROSE * 6}</p><p>{PROSE * 6}</p></article>"
    assert main_text(several + links) == f"{(PROSE * 6).strip()} {(PROSE * 6).strip()}"


def test_time_grows_with_the_page():
    import time

    from promptlens.llm.html_text import main_text

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert main_text("<article>" + "<b>x" * n + "</i>" * n + "<br>" * n) == "x" * n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_sample_is_bounded_in_bytes_and_repeated_ids_are_defined(spark):
    from promptlens.llm import quality

    rows = [(i, f"good words here {i} " * 20 if i % 2 else "zz xx " * 60 + str(i)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (1, "another text of one id")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(40)], (3, 0)], "doc_id long, quality int")
    one, two = (quality.train(d, labels).weights for d in (docs, docs.orderBy("text")))
    assert (one == two).all()
    found = spark.createDataFrame([(i, i % 2, bytearray(b"x" * 100)) for i in range(20)], "_id long, _quality int, f binary")
    kept = quality._bounded(found, 1000).collect()
    assert sum(len(r.f) for r in kept) <= 1000 and {r._quality for r in kept} == {0, 1}


def test_fit_matches_a_plain_dual_coordinate_descent():
    from promptlens.llm import quality

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 60, 20)) + (20 if i % 2 else 0) for i in range(30)]
    y, scale, cost = np.where(np.arange(30) % 2, 1.0, -1.0), rng.normal(size=100), np.full(30, 2.0)
    weights, bias = quality.dual_coordinate_descent(rows, y, scale, cost)
    x = np.zeros((30, 101))
    for i, r in enumerate(rows):
        x[i, r], x[i, 100] = scale[r] / np.sqrt(max(len(r), quality.SHORT)), 1.0
    order, w, alpha = np.random.default_rng(7), np.zeros(101), np.zeros(30)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in order.permutation(30):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0), cost[i])
            moved, w, alpha[i] = max(moved, abs(new - alpha[i])), w + (new - alpha[i]) * y[i] * x[i], new
        if moved < 1e-3:
            break
    assert weights == pytest.approx(w[:100] * scale) and bias == pytest.approx(w[100])
