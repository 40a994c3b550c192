"""Site templates: the counts against a plain version, broken and deep pages, whole articles."""

import functools
import random
import time
from collections import Counter, defaultdict

import pytest

from spanwright.llm import common, html_main
from spanwright.llm.html_main import ELSEWHERE, INSIDE, LEFT_OUT, MAIN, Page, article_of

PAGES = "page_id long, url string, html string"


def site(seed, n=70):
    """Pages of a few hosts: menus, notes and share bars from pools, own and copied articles, some without marks."""
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice("ab cd efg hij klmn op qrs tuv wxyz".split()) for _ in range(k))
    bars = [f"<div class=x><p>bar {words(3)}</p></div>" for _ in range(3)]
    menus = [f"<nav><ul><li><a href=/>{words(1)}</a><li>{words(2)}</ul></nav>" for _ in range(3)]
    copied = "".join(f"<p>{words(8)} {k}</p>" for k in range(4))
    rows = []
    for i in range(n):
        body = copied if rng.random() < 0.3 else "".join(f"<p>{words(8)} {i} {k}</p>" for k in range(rng.randint(1, 4)))
        body += rng.choice(bars) if rng.random() < 0.6 else ""
        article = rng.choice([f"<article>{body}</article>", f"<div>{body}</div>", f'<div id="content">{body}</div>', f"<main><h1>t {i}</h1>{body}</main>"])
        note = f"<div>{rng.choice(bars)}</div>" if rng.random() < 0.5 else ""
        rows.append((i, f"http://h{rng.randrange(3)}/{i}", f"<html><body>{rng.choice(menus)}{article}{note}<footer>f {rng.randrange(4)}</footer></body></html>"))
    return [*rows, rows[0], (900, None, None), (901, "http://h1/", "")]


def plain(rows):
    """(page_id, text, n_removed) with counts in dictionaries."""
    pages = [(i, (url or "").split("//")[-1].split("/")[0], Page(text or "")) for i, url, text in rows]

    def found(p):
        return {(ELSEWHERE, h) for h, at in zip(p.hashes, p.places) if at == ELSEWHERE} | {(INSIDE, h) for h, at in zip(p.hashes, p.places) if at == INSIDE} | {(LEFT_OUT, h) for h in p.left_out}

    def templates(only):
        n, size = Counter(), Counter()
        for k, (_, host, p) in enumerate(pages):
            own = {x for x in found(p) if x[0] == LEFT_OUT or k in only}
            n.update((host, *x) for x in own)
            size.update({(host, at) for at, _ in own})
        out = defaultdict(set)
        for (host, at, h), m in n.items():
            if m >= 3 and (at == LEFT_OUT or m >= min(0.3 * size[host, at], 1000)):
                out[host].add((at, h))
        return out

    def dead(p, own):
        state = []
        for h, up, at in zip(p.hashes, p.parents, p.places):
            state.append((at, h) in own or (up >= 0 and state[up]))
        return state

    first, evidence = templates(range(len(pages))), []
    for k, (_, host, p) in enumerate(pages):
        gone = dead(p, first[host])
        marked = any(r >= MAIN for r in p.roots)
        own = [(len(t), gone[e]) for t, e, r in zip(p.texts, p.element, p.roots) if r >= MAIN or not marked]
        if not own or sum(n for n, g in own if g) <= (0.5 if marked else 0.95) * sum(n for n, _ in own):
            evidence.append(k)
    second, out = templates(set(evidence)), []
    for i, host, p in pages:
        own = second[host] & first[host]
        gone = dead(p, own)
        alive = [not gone[e] for e in p.element]
        out.append((i, article_of(p.texts, p.roots, p.links, alive), alive.count(False) + sum((LEFT_OUT, h) in own for h in p.left_out)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_equal_a_plain_version(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(html_main, "attach", functools.partial(common.attach, max_rows=0))
        monkeypatch.setattr(html_main, "BROADCAST_ROWS", 0)
    rows = site(3)
    got = html_main.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert sorted(((r["page_id"], r["text"], r["n_removed"]) for r in got), key=repr) == plain(rows)
    assert any(r["n_removed"] for r in got) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_the_counts_decide(spark):
    rows = site(5, 60)
    with_counts = dict(r[:2] for r in plain(rows))
    assert any(text != article_of(p.texts, p.roots, p.links, [True] * len(p.texts)) for i, _, h in rows if (p := Page(h or "")) and (text := with_counts[i]) is not None)


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/", "<article>a</article>", "x", "y", "z")], PAGES + ", host string, text string, row string")
    assert html_main.main_text(df).collect()[0][:4] == (1, "http://h/", "a", 1)


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 20_000, "<a " * 100_000, "<a '" * 50_000, "<b>" * 20_000 + "<hr>x" * 20_000, "<script>" + "</script" * 50_000, "<!" * 100_000, "<!--" * 100_000, "<td><table>" + "<div>" * 9000 + "<tr></tr>" * 9000, "<div>" * 20_000 + "</p>" * 20_000, "&" * 200_000, "<p>y" * 20_000],
    ids=range(11),
)
def test_broken_and_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    Page(page)
    assert time.perf_counter() - start < 5


def test_the_largest_content_root_and_whole_names():
    text = lambda h: article_of((p := Page(h)).texts, p.roots, p.links, [True] * len(p.texts))
    assert text('<article class="teaser">see</article><div id="content"><p>the long text of a story</p></div>') == "the long text of a story"
    kept = '<div class="social-policy">p1</div><section id="related-work">p2</section><div class="content-notice-board">p3</div>'
    assert text(f'<article><p>a</p>{kept}<div class="related-posts">n</div><div class="postComments">n</div><div class="ad-300x250">n</div></article>') == "a\np1\np2\np3"
    assert text("<main><article><p>the whole body</p></article><div>beside</div></main>") == "the whole body"
    assert text("<main><h1>t</h1><p>the whole body</p><article>short</article></main>") == "t\nthe whole body\nshort"


def kept(page):
    p = html_main.read_page(page)
    return html_main.article_of(p.texts, p.roots, p.links, [True] * len(p.texts))


def test_an_article_is_not_left_out_with_its_layout():
    body = "<h1>Head</h1><p>One two three.</p>"
    assert kept(f"<body><form id='aspnet'><div>menu</div><article>{body}</article></form></body>") == "Head\nOne two three."
    assert kept(f'<div class="right-sidebar"><article>{body}</article></div>') == "Head\nOne two three."
    assert kept(f'<main class="subscription">{body}</main>') == "Head\nOne two three."
    assert kept(f"<form><div>{body}</div></form><p>x</p>") == "Head\nOne two three.\nx"
    assert kept(f'<form class="sidebar"><div class="ads"><div id="menu"><div class="popup"><article>{body}</article></div></div></div></form>') == "Head\nOne two three."
    # Where an article stands outside, nothing of it returns.
    assert kept(f'<article>{body}</article><section class="comments"><article>No!</article></section><form>{"search " * 50}</form>') == "Head\nOne two three."
    assert kept('<div class="cookie">a</div><p>text</p>') == "text"


def test_nested_layouts_take_linear_time():
    import time

    begin = time.perf_counter()
    html_main.read_page("<form><div class=ads>" * 20_000 + "x")
    assert time.perf_counter() - begin < 5
