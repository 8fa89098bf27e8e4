import pytest

import time

from folioflow.llm.mincut import blocks, extract, labelled, log_odds, main_text, source_side

BODY = "A long paragraph of the article with quite enough words to look like running text, again and again. "
PAGES = {
    "article": ("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p><b>" + BODY + "<br>next</b><p>Ti.</p></article><footer>&copy; me</footer>", "Title & more " + BODY.strip() + " next Ti."),
    "inside": (f"<main><p>{BODY}</p><div class='advert'>{BODY}</div><aside>{BODY}</aside><p>{BODY}</p><form>{BODY}<input></form><section id='comments'><p>{BODY}</p></section></main>", f"{BODY.strip()} {BODY.strip()}"),
    "plain": (f"<div id='menu'><a>one</a> <a>two</a></div><div><p>{BODY}</p><p>Short one.</p><p>{BODY}</p></div><div class='footer'>legal words</div>", f"{BODY.strip()} Short one. {BODY.strip()}"),
    "raw": (f"<head><title>t</title><style>p{{}}</style><script>var t='</p>'</script></head><article><p>{BODY}</p><!-- <p>no</p> --><script>if (a<b) x()</script></article>", BODY.strip()),
    "notice": (f"<div class='cookie-notice'><p>{BODY}</p></div><article><p>{BODY}</p><ul class='related-posts'><li><a>{BODY}</a></li></ul></article>", BODY.strip()),
    "heads": (f"<header><h1>Site</h1></header><article><header><h1>A title</h1></header><div class='post-header'><h2>Second</h2></div><p>{BODY}</p></article>", "A title Second " + BODY.strip()),
    "wrapper": (f"<div class='page has-sidebar'><div class='nav-main'><a>{BODY}</a></div><div><p>{BODY}</p><p>{BODY}</p></div><div class='sidebar'><p>{BODY}</p></div></div>", f"{BODY.strip()} {BODY.strip()}"),
    "all under one name": (f"<div class='widget'><p>{BODY}</p><p>{BODY}</p></div>", f"{BODY.strip()} {BODY.strip()}"),
    "article in a named wrapper": (f"<div class='side'><p>{BODY}</p><article><p>{BODY}</p></article></div>", BODY.strip()),
    "formula": (f"<article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here. {BODY}</p><object><p>{BODY}</p></object></article>", f"We have x=2 here. {BODY.strip()} {BODY.strip()}"),
    "hidden": (f"<article><p>{BODY}</p><p style='display: none'>{BODY}</p><p hidden>{BODY}</p></article>", BODY.strip()),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert main_text(PAGES[name][0]) == PAGES[name][1]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<<<>") == main_text("<script>") == main_text("<!--") == ""
    assert main_text("<article><p>&lt;b&gt; &#233;&nbsp;x") == "<b> é x"
    assert len(main_text("<article>" + f"<p>{BODY}</p>" * 3000 + "</article>")) > 3000 * 90
    assert [b.text for b in blocks("a<p>b<p>c<div>d</div>e</p>f")[0]] == ["a", "b", "c", "d", "e", "f"]


def test_raw_elements_end_where_they_end():
    text = "A sentence of the article that is long enough to be kept as content, with no link in it at all."
    page = f"<article><p>{'İ' * 40} {text}</p><sCript>var a = 1;</ScripT><p>Second: {text}</p><p>Third: {text}</p></article>"
    assert [b.text[:6] for b in blocks(page)[0]] == ["İ" * 6, "Second", "Third:"]


CUT = {
    "a short paragraph among long ones": (f"<div><p>{BODY * 3}</p><p>Yes.</p><p>{BODY * 3}</p></div>", "Yes.", True),
    "a linked paragraph of an article": (f"<article><p>{BODY}</p><p><a href=x>Read on</a></p><p>{BODY}</p></article>", "Read on", True),
    "a teaser among links": ("<ul>" + "<li><a href=x>A link</a></li>" * 4 + f"<li>{BODY * 2}</li>" + "<li><a href=x>A link</a></li>" * 4 + "</ul>", (BODY * 2).strip(), False),
}


@pytest.mark.parametrize("name", CUT)
def test_neighbours_outvote_a_block(name):
    page, text, content = CUT[name]
    block, keep = next((b, k) for b, k in labelled(page) if b.text == text)
    assert (log_odds(block) > 0) != content and keep == content


def made_page(rng):
    """A page of the usual parts, and the text that belongs to its article."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    run = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n)) + "</ul>"
    body, want = [], []
    for k in range(rng.randrange(2, 9)):
        t = run(1, 4) if k and rng.random() < 0.3 else run(12, 60)
        tag = "h2" if len(t) < 20 else "p"
        want.append(t)
        body.append(f"<{tag}>" + (t if rng.random() < 0.5 else f"<b>{t}</b>") + f"</{tag}>")
        if rng.random() < 0.3:
            body.append(rng.choice([f"<aside><p>{run(5, 40)}</p></aside>", f"<div class='ad'>{run(3, 30)}</div>", f"<form><label>{run(2, 5)}</label><input></form>", "<script>if (a<b) x()</script>"]))
    title = run(3, 8)
    inner = f"<h1>{title}</h1>" + "".join(body)
    inner = rng.choice(["<article>{}</article>", "<main><div class='post'>{}</div></main>", "<div class='wrap has-sidebar'><article><div>{}</div></article></div>", "<div class='entry-content'>{}</div>"]).format(inner)
    for _ in range(rng.randrange(30)):
        inner = f"<div>{inner}</div>"
    top = rng.choice([f"<header><a>{word()}</a></header><nav>{links(5)}</nav>", f"<div id='top-menu'>{links(4)}</div>", f"<div class='cookie-notice'><p>{run(10, 40)}</p></div>"])
    end = rng.choice([f"<footer>&copy; {run(2, 9)}</footer>", f"<div class='comments'><p>{run(5, 60)}</p><p>{run(5, 60)}</p></div><footer>x</footer>", f"<div class='sidebar'><p>{run(5, 50)}</p></div>"])
    return f"<html><head><title>{title}</title></head><body>{top}{inner}{end}</body></html>", " ".join([title, *want])


def test_made_pages():
    import random

    rng = random.Random(12)
    for _ in range(300):
        page, want = made_page(rng)
        assert main_text(page) == want, page


def test_large_and_odd_pages_take_seconds():
    start = time.perf_counter()
    p = f"<p>{BODY * 2}</p><p>No.</p><p><a>Link</a> {BODY * 2}</p>"
    assert len(main_text("<div>" + p * 30_000 + "</div>")) > 30_000 * 90
    deep = "<div>" * 100_000 + f"<article><p>{BODY}</p></article>" + "</div>" * 100_000
    assert main_text(deep) == BODY.strip()
    assert main_text("".join(f"<div><p>{BODY}</p>" for _ in range(30_000))).count("article") == 30_000
    main_text('<a "' * 200_000)
    main_text("<!" * 200_000)
    main_text("<p><b>" * 50_000 + "</i></q>" * 50_000)
    main_text("<b>x</z>" * 100_000)
    assert time.perf_counter() - start < 60


def brute(gain, ties):
    n = len(gain)
    cost = {}
    for mask in range(1 << n):
        side = [bool(mask >> i & 1) for i in range(n)]
        cut = sum(max(g, 0) for g, s in zip(gain, side, strict=True) if not s) + sum(max(-g, 0) for g, s in zip(gain, side, strict=True) if s)
        cost[mask] = cut + sum(c for a, b, c in ties if side[a] != side[b])
    return cost


def test_cut_is_least():
    import random

    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 8)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        ties = [(a, b, rng.randrange(1, 9)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        side = source_side(gain, ties)
        cost = brute(gain, ties)
        assert cost[sum(1 << i for i, s in enumerate(side) if s)] == min(cost.values())


def test_frame(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "x"), (2, None, None, None), (None, "v", "", "y")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars, r.text == PAGES["plain"][1]) for r in got) == [(0, 0, False), (1, len(PAGES["plain"][1]), True), (1, len(PAGES["plain"][1]), True), (2, 0, False)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
