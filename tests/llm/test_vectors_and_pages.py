"""Hard negatives, centroid clustering and HTML extraction against plain versions and on edge rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.llm import centroids, hard_negatives, site_style_tree

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, v string"


def _table(spark, rows):
    return spark.createDataFrame([(i, e, y, "x", "y") for i, e, y in rows], SCHEMA)


def _vectors(n, dims=64, seed=3, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if copies:
        x[:copies] = x[0]
    return [(i, [float(np.float32(v)) for v in r], i % 5) for i, r in enumerate(x)]


# ------------------------------------------------------------------ 11
def _plain_negatives(rows, step):
    kept = {}
    for i, e, y in rows:
        if i is None or y is None or not e or any(v is None or not np.isfinite(v) for v in e):
            continue
        one = (y, [int(np.floor(256 * v)) for v in e])
        kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (y, q) in kept.items():
        if a % step:
            continue
        scored = sorted((-sum(p * r for p, r in zip(q, v)), i, z) for i, (z, v) in kept.items() if i != a)
        negatives = [(-s, i) for s, i, z in scored if z != y]
        for s, i in [(-s, i) for s, i, z in scored if z == y][:5]:
            fits = [(t, j) for t, j in negatives if 80 * s <= 100 * t <= 100 * s][:5]
            out += [(a, i, r + 1, j, s, t) for r, (t, j) in enumerate(fits)]
    return sorted(out)


def _mined(spark, rows, step=10):
    return sorted(tuple(r) for r in hard_negatives.mine(_table(spark, rows), F.col("vec_id") % step == 0, F.col("label")).collect())


EDGE_VECTORS = [(None, [0.5] * 64, 1), (5000, None, 1), (5001, [], 1), (5002, [None] + [0.1] * 63, 1), (5003, [float("nan")] + [0.1] * 63, 2),
                (5004, [float("inf")] + [0.1] * 63, 2), (5005, [0.0] * 64, 3), (5010, [0.0] * 64, 3), (5011, [0.1] * 64, None)]


@pytest.mark.parametrize("copies", [0, 60])
def test_hard_negatives_equal_the_plain_search(spark, copies):
    rows = _vectors(300, copies=copies) + EDGE_VECTORS + _vectors(20, seed=3)  # repeated ids, zero vectors, unusable rows
    assert _mined(spark, rows) == _plain_negatives(rows, 10)


def test_hard_negatives_over_many_cells_parts_and_shares(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 25)
    monkeypatch.setattr(hard_negatives, "PART_ANCHORS", 7)
    base = np.random.default_rng(0).normal(size=(6, 64))
    rows = []
    for i in range(300):
        x = base[i % 6] * (i % 3 > 0) + np.random.default_rng(i).normal(size=64) * 0.4
        rows.append((i, [float(np.float32(v)) for v in x / np.linalg.norm(x)], i % 4))
    assert _mined(spark, rows) == _plain_negatives(rows, 10)


def test_hard_negatives_of_tied_small_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    tied = [(i, [float(v) for v in rng.choice([-1.0, 1.0], 8)], i % 2) for i in range(200)]
    assert _mined(spark, tied) == _plain_negatives(tied, 10)
    assert _mined(spark, tied[:1]) == [] and _mined(spark, []) == [] and _mined(spark, EDGE_VECTORS[:3]) == []
    with pytest.raises(Exception, match="beyond"):
        _mined(spark, [(1, [1e9] * 64, 1)])


def test_intervals_hold_every_product():
    x = np.random.default_rng(2).integers(-300, 300, size=(500, 24)).astype("f8")
    x[3] = 0
    code = hard_negatives.encode(x)
    for q in (x[0], x[3], -x[1], np.eye(24)[5] * 7):
        lo, hi = hard_negatives.intervals(*code, q)
        assert ((lo <= x @ q) & (x @ q <= hi)).all()
        assert np.median(hi - lo) < 1.2 * np.linalg.norm(q) * np.median(np.linalg.norm(x, axis=1)) + 1e-9


def test_survivors_are_a_part_of_the_rows(spark):
    import pandas as pd
    x = np.floor(256 * np.array([r[1] for r in _vectors(2000)])).astype("i8")
    code = hard_negatives.encode(x.astype("f8"))
    rows = pd.DataFrame(dict(vec_id=range(2000), label=0, v=[r.astype("<i4").tobytes() for r in x], code=[r.tobytes() for r in code[0]],
                             length=code[1], align=code[2], gain=code[3]))
    anchors = pd.DataFrame(dict(anchor_id=[0, 1], label=0, v=rows["v"][:2], least=np.nan))
    assert 10 <= hard_negatives.best_positives(rows, anchors, 5)[1] < 2 * 2000 * 0.8


# ------------------------------------------------------------------ 12
def _plain_lloyd(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * v)) for v in e]) for i, e, _ in rows
            if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    start = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), np.array(r[1], "<i4").tobytes()))[:k]
    c = [list(v) for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((p - q) ** 2 for p, q in zip(v, m)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (cl, _) in zip(kept, a) if cl == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i if i is not None else -1), *a) for (i, _), a in zip(kept, assign())), c


@pytest.mark.parametrize("rows", [_vectors(250) + EDGE_VECTORS, _vectors(250, copies=200), _vectors(5), _vectors(1), _vectors(40) * 2],
                         ids=["edges", "copies", "fewer than clusters", "one", "repeated rows"])
def test_clusters_equal_plain_lloyd(spark, rows):
    found = centroids.cluster(_table(spark, rows))
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance) for r in found.assigned.collect())
    assert (got, found.centroids) == _plain_lloyd(rows)
    for r in found.summary().collect():
        mine = [d for _, j, d in got if j == r.cluster]
        assert (r.n, r.cluster_inertia) == (len(mine), sum(mine))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, found.centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_no_rows(spark):
    found = centroids.cluster(_table(spark, EDGE_VECTORS[1:4]))
    assert found.assigned.count() == 0 and found.summary().count() == 0 and found.centroids == []


def test_bounds_filter_most_centroids_and_lose_none():
    rng = np.random.default_rng(5)
    means = rng.normal(size=(8, 64)) * 400
    x = np.floor(means[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 64)) * 40).astype("i8")
    c = np.floor(means).astype("i8")
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :16]
    cluster, best, verified = centroids.nearest(x, *centroids.rotated(x, axes), c, axes)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert verified < 1.5 * len(x)  # of 8 distances a row


# ------------------------------------------------------------------ 13
def _text(page):
    return " ".join(t for _, t, ok, _ in site_style_tree.main_blocks(page)[1] if ok)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain &lt;words&gt; only", "plain <words> only"), ("<p>a<br>b<b>c</b>d<p>e", "a bcd e"),
    ("<p>x &amp y &#233; &nbsp; z &am", "x & y é z &am"), ("<p>3 < 4 and 5 > 2</p>", "3 < 4 and 5 > 2"),
    ("<script>var t='</p><article>no';</script><p>yes</p><style>p{}</style><!-- <p>no</p> --><p>too", "yes too"),
    ("<nav><ul><li>m<li>n</ul></nav><div>body <span class='ad'>buy <span>now</span></span> text</div><footer>f", "body text"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>one</p><footer>by x</footer></article>", "Title one"),
    ("<div class='page has-sidebar'><main><p>a</p><section id=comments><article><p>no</p></article></section></main></div><p>out</p>", "a"),
    ("<div id='cookie-notice'>c</div><form><p>f<input></form><div class='story'><h2>s</h2><ul><li>1<li>2</ul></div><aside>z</aside>", "s 1 2"),
    ("<article class=comment><p>no</p></article><p>yes</p>", "yes"), ("<title>t</title><body><table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<p title='a>b' class=\"x\">it's</p><p class=y>don't</p><p id=\"open>rest</p><p>end", "it's don't rest end"),
    ("<article><p>cut off <fo", "cut off"), ("<article><p>" + "long " * 50_000, ("long " * 50_000).strip()),
    ("<form id=aspnet><div role=navigation>m</div><h1>T</h1><p>b</p></form>", "T b"), ("</div></p>x</b>", "x"),
])
def test_blocks_of_one_page(page, text):
    assert _text(page) == text


def test_deep_and_broken_pages_take_linear_time():
    import time
    deep = "<div>" * 20_000 + "text" + "</span></b></section>" * 20_000 + "<li>x" * 20_000 + "</div>" * 30_000
    quotes = "<a href=\"x" * 20_000 + "<p class='" * 20_000 + "<!-- " * 20_000 + "<script>" * 20_000
    start = time.process_time()
    assert _text(deep).startswith("text x x")
    _text(quotes)
    assert time.process_time() - start < 20


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "n", 7) for i, u, h in rows], "page_id long, url string, html string, host string, node int")


def _unmarked(i):
    """A page whose parts have names that say nothing: menu, article and bottom, all in div elements."""
    body = "".join(f"<p>Paragraph {chr(97 + i % 26)}{chr(97 + k)} tells of {'xyzuvw'[(i + k) % 6] * (i + 2)} things.</p>" for k in range(1 + i % 4))
    return (f"<div class=q1><div>Start</div><div>World</div><div>Contact us</div></div><div class=q2><h2>Story {'abc' * (i + 1)}</h2>"
            f"<h3>Summary</h3>{body}</div><div class=q3>All rights reserved, Example Corp.</div>")


def test_style_tree_finds_what_comes_back_on_every_page(spark):
    rows = [(i, "http://Site.example/a?%d" % i, _unmarked(i)) for i in range(24)]
    rows += [(100 + i, "http://small.example/%d" % i, _unmarked(i)) for i in range(3)]  # too few pages to judge by entropy
    rows += [(200 + i, "http://copies.example/", _unmarked(7)) for i in range(30)]      # one page over and over
    rows += [(300, None, "<p>no host</p>"), (301, "x", None), (302, "http://site.example/", ""), (303, "http://e.example", "<nav>x</nav>")]
    rows += [(None, "http://e.example", "<p>no id</p>"), (304, "u", "<p>twice"), (304, "u", "<p>twice")]
    got = [tuple(r) for r in site_style_tree.extract_main_text(_pages(spark, rows)).collect()]
    assert sorted((i, u) for i, u, _, _ in got if i is not None) == sorted((i, u) for i, u, _ in rows if i is not None)
    assert all(n == len(t) for _, _, t, n in got)
    texts = {i: t for i, _, t, _ in got}
    for i in range(24):
        assert "Contact us" not in texts[i] and "reserved" not in texts[i]
        assert texts[i].startswith("Story ") and texts[i].count("Paragraph") == 1 + i % 4
    assert all("Contact us" in texts[100 + i] and "Paragraph" in texts[100 + i] for i in range(3))
    assert all(texts[200 + i].count("Paragraph") == 4 for i in range(30))
    assert [texts[i] for i in (300, 301, 302, 303, None, 304)] == ["no host", "", "", "", "no id", "twice"]
    assert site_style_tree.extract_main_text(_pages(spark, rows).limit(0)).count() == 0


def test_style_tree_equals_plain_entropies(spark):
    pages = [_unmarked(i) for i in range(12)] + ["<div class=q1><div>Start</div></div>"] * 2
    tree = {(r.node): (r.pages, r.importance) for r in
            site_style_tree.style_tree(_pages(spark, [(i, "http://h.example/", p) for i, p in enumerate(pages)])).collect()}
    texts, looks, parents, seen = {}, {}, {}, {}
    for number, p in enumerate(pages):
        elements, blocks = site_style_tree.parse(p)
        for node in {e.node for e, _ in blocks}:
            seen[node] = seen.get(node, 0) + 1
        for e, t in blocks:
            texts.setdefault(e.node, {}).setdefault(t, []).append(number)
            parents[e.node] = e.parent.node
        for e in elements:
            if e.children:
                looks.setdefault(e.node, []).append(tuple(e.children))
    entropy = lambda xs: -sum(xs.count(x) / len(xs) * np.log(xs.count(x) / len(xs)) for x in set(xs))
    for node, by_text in texts.items():
        content = 1.0
        if seen[node] >= site_style_tree.LEAST_PAGES:
            content = 1 - np.mean([entropy(pages_of) for pages_of in by_text.values()]) / np.log(seen[node])
        shown = looks.get(parents[node], [])
        presentation = entropy(shown) / np.log(len(shown)) if len(shown) >= site_style_tree.LEAST_PAGES else 1.0
        signed = node - (1 << 64) if node >> 63 else node
        assert tree[signed][0] == seen[node]
        assert tree[signed][1] == pytest.approx(site_style_tree.CONTENT_SHARE * content + (1 - site_style_tree.CONTENT_SHARE) * presentation)


def test_common_passages_and_headings_of_articles_stay(spark):
    shared = "This passage stands in every article of the site."
    rows = [(i, "http://h.example/", f"<nav>menu</nav><article><h1>T{'x' * i}</h1><h2>Summary</h2><p>{shared}</p>"
             + "".join(f"<p>{'w' * (i + 1)} {'v' * k}</p>" for k in range(1, 2 + i % 5)) + "</article>") for i in range(40)]
    for r in site_style_tree.extract_main_text(_pages(spark, rows)).collect():
        assert shared in r.text and "Summary" in r.text and "menu" not in r.text
