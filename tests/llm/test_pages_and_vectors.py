"""HTML extraction, embedding near-dedup and nearest neighbours."""

from __future__ import annotations

import html
import itertools
import random
import time
import re

import numpy as np
import pytest

from ledgerline.llm import embed_dedup, html_mincut, nearest, queries
from tests.llm.helpers import SMALL, components


def article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"<(?:h1|/h1|p|/p|br)>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    out = queries.op6_html_text(spark, SMALL).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("plain &lt;text&gt; of its own, long enough to be what the page is about", "plain <text> of its own, long enough to be what the page is about"),
    ("<html><body><nav>Menu</nav><main><h1>T&eacute;</h1><p>One&nbsp; two<br>three.</p><form>Mail <input></form></main>"
     "<section id=comments><article><p>A reader's comment of a good many words, all of them about the article.</p></article>"
     "</section><footer>x</footer>", "Té\nOne two three."),
    ("<article><p><b>one<p>two</article><div class='cookie notice'>We use cookies to make this page better for you</div>", "one\ntwo"),
    ("<article><ul><li>a<li>b</ul><pre>c\n  d</pre><script>var t='</p>';</script><style>p{}</style>e</article", "a\nb\nc d\ne"),
    ("<article><p>kept</p><aside>Related</aside><div class='ad-box'>Buy</div><p hidden>gone</p><p>kept too</p></article><p", "kept\nkept too"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text</p></article>", "Title\nText"),
    ("<script>never closed <p>x</p>", ""),
    ("<article><p>1 < 2 &amp 3 &am</p></article>", "1 < 2 & 3 &am"),
])
def test_main_text(page, want):
    assert html_mincut.main_text(page) == want


STORY = "<p>A story with a fair number of words, so that it counts as text.</p><p>It goes on.</p>"
LONG = "Many words make a long paragraph that says a lot of things about the matter " * 4


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>STORY</article></body>",
    "<body class='has-sidebar'><div class=wrap><article>STORY</article><div class='sidebar'><p>Latest posts</p></div></div>",
    "<div id='page-with-menu'><article>STORY</article><div class='related'>Other story</div></div>",
    "<article class='post comments-open'>STORY</article>",
    "<form><nav>Menu</nav><div class='has-sidebar'><article>STORY</article></div></form>",
    "<main><div class='content has-sidebar'>STORY</div></main><section id=comments><article><p>LONG</article></section>",
    "<article><div title='hidden gems' data-hidden='false' data-class='ad'>STORY</div></article>",
    "<main><article>STORY</article><div class='comments'><article><p>Nice one</p></article></div></main>",
    "<article>STORY<div class='social share'>Tweet this</div><p aria-hidden='true'>LONG</p><div hidden>LONG</div></article>"])
def test_words_of_a_wrapper_do_not_empty_a_page(page):
    got = html_mincut.main_text(page.replace("STORY", STORY).replace("LONG", LONG))
    assert got == "A story with a fair number of words, so that it counts as text.\nIt goes on."


@pytest.mark.parametrize("page, want", [
    ("<div>Short text.</div>", "Short text."),
    ("<table><tr><td>a<td>b</tr><tr><td>c<td>d</tr></table>", "a b\nc d"),
    ("<ul><li>One<li>Two</ul>", "One\nTwo"),
    ("<div>Roses are red</div><div>Violets</div>", "Roses are red\nViolets"),
    ("<ul><li><a href=x>Home</a><li><a href=y>About us</a></ul><div>Short text.</div><div class=ad>Buy</div><div>© 2020 x</div>",
     "Short text."),
    ("<nav>Menu</nav><div class=post-body>Hi</div><div class=related><a href=z>Next story</a></div>", "Hi")])
def test_pages_without_an_article_keep_short_blocks(page, want):
    assert html_mincut.main_text(page) == want


def test_long_paragraphs_outweigh_class_words():
    page = f"<article>{STORY * 4}<div class='notice'><p>{LONG}</p></div><div class='notice'>Short</div></article>"
    assert html_mincut.main_text(page).split("\n")[8:] == [LONG.strip()]


def test_long_pages_and_deep_pages():
    many = "<article>" + "".join(f"<p>Paragraph number {i} of a long text.</p>" for i in range(4000)) + "</article><nav>m</nav>"
    assert html_mincut.main_text(many).count("\n") == 3999
    assert html_mincut.main_text("<article>" + "<div>" * 800 + "deep" + "</div>" * 800 + "</article>") == "deep"


@pytest.mark.parametrize("name", ["related-work", "social-history", "search-engines", "share-prices", "menu-of-the-day",
                                  "ad-hoc", "advertising-law", "sharing_economy"])
def test_names_that_only_contain_a_noise_word_keep_their_paragraph(name):
    text = "One paragraph of exactly sixteen words that belongs to what this article is really all about."
    assert html_mincut.main_text(f"<article>{STORY}<div class='{name}'><p>{text}</p></div></article>").endswith(text)


@pytest.mark.parametrize("name", ["site-footer", "comments-area", "related_posts", "cookie-banner", "ad-slot", "sidebar-left",
                                  "menu-item menu-item-12", "widget"])
def test_names_of_parts_drop_their_text(name):
    assert "Something else" not in html_mincut.main_text(f"<article>{STORY}</article><div class='{name}'>Something else here</div>")


@pytest.mark.parametrize("text", ["Subscribe to our newsletter today", "We use cookies to improve your visit", "Home",
                                  "About us", "Copyright notice of the owner"])
def test_menus_and_notices_go_from_pages_without_an_article(text):
    page = f"<ul><li>{text}</li></ul><div>Short text.</div><div>{LONG} cookies</div>"
    assert html_mincut.main_text(page) == f"Short text.\n{LONG}cookies".replace("  ", " ")


def test_long_alternating_pages():
    advert = "<div class='ad'><p>Buy one of these many things now and save some of your money today or else</p></div>"
    page = "<article>" + "".join(f"<p>Paragraph number {i} of a long text.</p>{advert}" for i in range(32_000)) + "</article>"
    began = time.time()
    got = html_mincut.main_text(page).split("\n")
    assert len(got) == 32_000 and time.time() - began < 20
    # weak evidence both ways, so that links decide and nothing is settled at once
    rng = random.Random(1)
    content, other = ([rng.randrange(0, 45) for _ in range(64_000)] for _ in range(2))
    links = [(k, k + 1, 30) for k in range(63_999)] + [(k, k + 2, 15) for k in range(63_998)]
    began = time.time()
    html_mincut.cut(content, other, links)
    assert time.time() - began < 20


@pytest.mark.parametrize("seed", range(80))
def test_the_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    content, other = ([rng.randrange(0, 20) for _ in range(n)] for _ in range(2))
    links = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 12)) for _ in range(rng.randrange(0, 14))]

    def cost(label):
        return (sum(o if keep else c for c, o, keep in zip(content, other, label, strict=True))
                + sum(w for a, b, w in links if label[a] != label[b]))

    best = min(map(cost, itertools.product((False, True), repeat=n)))
    got = html_mincut.cut(content, other, links)
    assert cost(got) == best
    smallest = [label for label in itertools.product((False, True), repeat=n) if cost(label) == best]
    assert got == [all(label[k] for label in smallest) for k in range(n)]


def test_html_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>é 😀</article>"), (3, "u", "<article>é 😀</article>"), (None, "u", "<nav>m</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_mincut.extract_pages(pages).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "é 😀", 3), ("3", "é 😀", 3), ("None", "", 0)]
    assert html_mincut.extract_pages(pages.limit(0)).count() == 0


SCHEMA = "vec_id long, embedding array<float>, label int"


def cosines(rows):
    m = np.array([np.asarray(r[1], float) for r in rows])
    norm = np.sqrt((m * m).sum(1))
    return (m @ m.T) / np.outer(norm, norm)


def check_links(rows, out, threshold=embed_dedup.THRESHOLD):
    score = cosines(rows)
    labels = np.array([r[2] for r in rows])
    linked = (score >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    part = components(len(rows), zip(*np.nonzero(np.triu(linked)), strict=True))
    got = {r.vec_id: r for r in out}
    for k, r in enumerate(rows):
        assert got[r[0]].n_links == linked[k].sum()
        assert got[r[0]].component_id == rows[part[k]][0]
        assert got[r[0]].kept == (rows[part[k]][0] == r[0])


def vectors(n, dim=16, spread=0.2, seed=3):
    """Clusters around the threshold, several labels, some equal vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + spread * rng.standard_normal(dim) * (i % 3)
        out.append((i, [float(np.float32(x)) for x in v], int(i % len(centres)) % 3))
    return out


@pytest.mark.parametrize("tile", [2048, 16])
def test_embedding_links_equal_brute_force(spark, tile):
    rows = vectors(240)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    check_links(rows, embed_dedup.near_vectors(df, tile=tile).collect())


def test_embedding_links_of_the_table(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    check_links(rows, queries.op7_embedding_dedup(spark, SMALL).collect())


@pytest.mark.parametrize("threshold", [0.5, 0.93, 0.999])
def test_tiles_lose_no_pair(threshold):
    rows = vectors(200, seed=8)
    m = np.array([r[1] for r in rows])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((16, 16)))[0]
    i, j = embed_dedup.similar_pairs(m, m, threshold, turn, True)
    want = np.triu(cosines(rows) >= threshold, 1)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(want)), strict=True))


NAN, INF = float("nan"), float("inf")


def test_embedding_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [NAN, 1.0], 1), (8, [INF, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1),
            (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [3e38, 0.0], 1), (14, [1e-40, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as h", "2 as w", "3 as cell", "4 as v", "5 as dim")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.near_vectors(df).collect())
    lone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    group = [("1", 6, "1", True), ("12", 6, "1", False), ("12", 6, "1", False), ("2", 6, "1", False), ("13", 6, "1", False),
             ("14", 6, "1", False), ("None", 6, "None", True)]
    assert got == sorted(lone + group)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_nearest_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    score = cosines(rows)
    np.fill_diagonal(score, -9)
    ids = np.array([r[0] for r in rows])
    at = {i: k for k, i in enumerate(ids.tolist())}
    found = {}
    for r in queries.op10_nearest(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == sorted(i for i in at if i % 50 == 0)
    hit = 0
    for q, got in found.items():
        assert sorted(got) == [1, 2, 3, 4, 5]
        order = [got[k] for k in range(1, 6)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        for v, s in order:
            assert abs(score[at[q], at[v]] - s) < 1e-12
        hit += len({v for v, _ in order} & set(ids[np.lexsort((ids, -score[at[q]]))[:5]].tolist()))
    assert hit / (5 * len(found)) >= 0.9


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (50, [0.0, 0.0], 1), (100, None, 1),
            (150, [NAN, 0.0], 1), (200, [1.0, 0.0, 0.0], 1), (4, [INF, 0.0], 1), (5, [1.0, None], 1), (None, [1.0, 0.0], 1),
            (6, [-1.0, 0.0], None), (6, [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "2 as tab", "3 as v", "4 as dim", "5 as score")
    got = [(r.query_id, r["rank"], r.vec_id, r.score)
           for r in nearest.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 6, -1.0)]
    assert nearest.search(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_small_blocks_change_nothing(spark):
    rows = vectors(150, seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(tuple(r) for r in nearest.search(df, "vec_id % 10 = 0", block=n).collect()) for n in (7, 2048))
    assert [x[:3] for x in a] == [x[:3] for x in b]


def test_repeated_rows_take_no_neighbour_s_place(spark):
    rows = vectors(60, seed=11)
    other = [(i, [x + 0.05 * (d == i % 16) for d, x in enumerate(v)], label) for i, v, label in rows]  # a second vector each
    for table in (rows, rows + other):
        want, got = ({tuple(r) for r in nearest.search(spark.createDataFrame(x, SCHEMA), "vec_id % 10 = 0").collect()}
                     for x in (table, table * 6))
        assert {x[:3] for x in got} == {x[:3] for x in want} and len(got) == 6 * 5
        score, ids = cosines(table), np.array([r[0] for r in table])
        for q in range(0, 60, 10):
            best = sorted((-max(score[np.ix_(ids == q, ids == i)].ravel()), i) for i in range(60) if i != q)[:5]
            assert [i for _, i in best] == [x[2] for x in sorted(got) if x[0] == q]


def test_rerank_counts_copies_once():
    import pyarrow as pa
    v = [[1.0, 0.0]] + [[1.0, 0.1 * i] for i in range(1, 8) for _ in range(6)]
    ids = [0] + [i for i in range(1, 8) for _ in range(6)]
    out = nearest._rerank(5)(pa.table({"query": [True] + [False] * 42, "vec_id": ids, "v": v}))
    assert out.column("vec_id").to_pylist() == [1, 2, 3, 4, 5]


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 0.999e200], 1), (3, [1.0, 1.0], 1), (4, [1e-200, 1e-200], 1), (5, [1e200, -1e200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    near = sorted(nearest.search(df, "vec_id = 1").collect(), key=lambda r: r["rank"])
    assert {r.vec_id for r in near[:2]} == {3, 4} and [r.vec_id for r in near[2:]] == [2, 5]
    assert [r.score for r in near] == pytest.approx([1.0, 1.0, 1.0, 0.0], abs=1e-6)


def test_spread_vectors_meet_on_a_grid_of_several_axes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 8)) * [4, 3, 2.5, 1, 1, 1, 1, 1]
    m = np.concatenate([c + rng.normal(size=(12, 8)) * 0.15 for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    for tile in (None, 16):
        got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df, tile=tile).collect()}
        assert got == {i: int(linked[i].sum()) for i in range(len(u))}
    classes = df.selectExpr("embedding as v", "8 as dim")
    assert len(embed_dedup.principal_axes(classes, 0.374)[8][1]) >= 2


def test_more_rows_take_more_functions():
    assert nearest.settings(0) == nearest.settings(2500) == (4, 6, 48)
    assert nearest.settings(20_000)[1] == 7 < nearest.settings(10**9)[1] <= 14
