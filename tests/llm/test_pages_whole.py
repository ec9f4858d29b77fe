"""Main text of pages whose markup is sloppy, or names only a part of what is content."""

import pytest

from vellum.llm import html_main

BODY = "".join(f"<p>A paragraph with quite a few words in it, number {k}, to read.</p>" for k in range(4))


@pytest.mark.parametrize("head", ["<head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>", "<html><head><script>x()</script><link rel=a>", "<head><noscript><style>p{}</style></noscript><title>T</title>"])
def test_heads_without_end(head):
    text = html_main.main_text(head + "<div>" + BODY + "</div>")
    assert text.count("\n") == 3 and "number 0" in text and "T" not in text.split("\n")


def test_text_ends_a_head():
    assert html_main.main_text("<head><title>T</title>Plain text<p>more of it") == "Plain text\nmore of it"


@pytest.mark.parametrize("mark", ["<![foo x]>", "<![ CDATA[", "<![1]>", "<![CDATA[x]]>", "<![if !IE]>", "<![endif]>", "<!foo>", "<![>"])
def test_marked_sections_cut_nothing(mark):
    end = "" if mark.endswith(">") else ">"
    text = html_main.main_text(f"<div><p>First part of the text, some words.</p>{mark}{end}<p>Second part of the text, some words.</p></div>")
    assert text == "First part of the text, some words.\nSecond part of the text, some words."
    assert html_main.main_text("<p>Text before it.<![ open at the end") == "Text before it."


CARD = '<article class="card"><h3>A card</h3><p>Other story</p></article>'


@pytest.mark.parametrize("page", ["<main><h1>Title</h1>" + BODY + CARD + "</main>", "<body><div><h1>Title</h1>" + BODY + "</div>" + CARD])
def test_a_card_is_not_the_main_text(page):
    text = html_main.main_text(page)
    assert text.startswith("Title\n") and text.count("number") == 4 and "Other story" not in text


def test_articles_are_chosen_by_ratio():
    page = "<main><article><h2>One</h2>" + BODY + "</article><article><h2>Two</h2>" + BODY + "</article><article><a href=1>Next</a></article></main>"
    text = html_main.main_text(page)
    assert text.count("number") == 8 and "Next" not in text


def test_formulas_and_named_paragraphs_of_an_article_stay():
    page = '<article><p>One <math><mi>x</mi><annotation encoding="tex">x</annotation></math> two.</p><p class="notice">A notice of the article itself.</p><p class="related-work">Related work.</p><p class="ad">Buy</p><div class="notice">Box</div></article>'
    assert html_main.main_text(page) == "One x two.\nA notice of the article itself.\nRelated work."


def test_pages_take_time_by_their_length():
    """Elements left open, and ends without a start, cost no search through all that is open."""
    import time

    def seconds(n):
        pages = ["<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<p>x" * n, "<body>" * n + "</head>" * n, "<td>" * n + "</li>" * n, "<li><b>" * n]
        start = time.process_time()
        for p in pages:
            html_main.main_text(p)
        return time.process_time() - start

    seconds(500)
    assert seconds(16000) < 40 * max(seconds(1000), 0.005)


def plain_main_text(parser):
    """The choice by hand: ratios, Gaussian means, two clusters, the smallest box with nearly all of what lies above."""
    import math

    blocks, holders = parser.blocks, parser.holders
    up = lambda k: [k, *(up(holders[k][0]) if k else [])]
    size = lambda wanted: sum(b[1] for b in blocks if wanted(b[4]))
    is_open = (lambda s: s != 0) if size(lambda s: s < 0) > 4 * size(lambda s: s > 0) else (lambda s: s > 0)
    ratio = [b[1] / max(1, b[2]) if is_open(b[4]) else 0.0 for b in blocks]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratio[j]) for j in range(max(0, i - 3), min(len(ratio), i + 4))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    values = [v for b, v in zip(blocks, smooth, strict=True) if is_open(b[4])]
    if not values:
        return ""
    low, high = min(values), max(values)
    while True:
        near, far = [v for v in values if v < (low + high) / 2], [v for v in values if v >= (low + high) / 2]
        if not near or not far or (sum(near) / len(near), sum(far) / len(far)) == (low, high):
            break
        low, high = sum(near) / len(near), sum(far) / len(far)
    limit = (low + high) / 2 - 1e-9
    chosen = [b for b, v in zip(blocks, smooth, strict=True) if is_open(b[4]) and v >= limit]
    rich = [b for b, v, r in zip(blocks, smooth, ratio, strict=True) if is_open(b[4]) and max(v, r) >= limit]
    total = sum(len(b[0]) for b in chosen)
    boxes = [k for k, h in enumerate(holders) if h[1] in html_main.BOXES and sum(len(b[0]) for b in chosen if k in up(b[3])) >= 0.9 * total]
    own = max(boxes, key=lambda k: len(up(k)))
    state = holders[own][2]
    full = [is_open(b[4]) and r >= limit / 2 for b, r in zip(blocks, ratio, strict=True)]
    fulls = lambda k: sum(f for b, f in zip(blocks, full, strict=True) if k in up(b[3]))
    for k in up(own)[1:] if state <= 1 else ():
        own = k if holders[k][1] in html_main.BOXES and fulls(k) > fulls(own) else own
    state = holders[own][2]
    while state > 1 and own and holders[holders[own][0]][2] == state:
        own = holders[own][0]
    if holders[own][1] == "article" and own and holders[holders[own][0]][2] > 1:
        beside = {b[3] for b in rich if holders[b[3]][1] == "article" and holders[b[3]][0] == holders[own][0]}
        own = holders[own][0] if len(beside) > 1 else own
    told = {k for b in rich for k in up(b[3])}
    out = []
    for k, b in enumerate(blocks):
        path = up(b[3])
        between = path[: path.index(own)] if own in path else None
        if between is None or not is_open(b[4]):
            continue
        articles = [x for x in between if holders[x][1] == "article"]
        links = state <= 1 and any(not sum(o[1] for o in blocks if x in up(o[3])) for x in between)
        ends = [i for i, f in enumerate(full) if f] or [0]
        if holders[own][1] == "body" and not ends[0] <= k <= ends[-1] and b[3] != own and not fulls(b[3]):
            continue
        if not links and (not articles or articles[-1] in told):
            out.append(k)
    if not out:
        return ""
    heads = [(k, b[0]) for k, b in enumerate(blocks[: out[0]]) if b[5] == 1 and b[4] > 0] + [(k, t) for k, t in parser.heads if k < out[0] and "".join(parser.title).strip().startswith(t)]
    first = [max(heads)[1]] if heads and blocks[out[0]][5] not in (1, 2, 3) else []
    return "\n".join(first + [blocks[k][0] for k in out])


P = "<p>A paragraph with quite a few words in it, number {}, to read, and then a little more of it.</p>"
SPLIT = "<div>" + "".join(f"<section>{P.format(k)}{P.format(k + 10) * k}</section>" for k in (1, 2, 5)) + "</div>"
WHOLE = [
    (SPLIT, 11, ""), ("<body><div id=c><div>" + P.format(1) + "</div><div>" + BODY * 2 + "</div></div><div><a href=1>x</a></div>", 9, ""), ("<div>" + BODY + "<ul><li>short</li><li>item</li></ul></div>", 4, "short\nitem"),
    ("<body><div>" + P.format(1) + "</div><div>" + BODY * 2 + "</div><div>Copyright line</div>", 9, ""), ("<div><h1>Title here</h1></div><div>" + BODY + "</div><footer>f</footer>", 4, "Title here\n"), ("<title>Title here - Site</title><header><h1>Title here</h1></header><div>" + BODY + "</div>", 4, "Title here\n"),
    ("<main><article>" + BODY + "</article><article><h2>Second</h2>" + P.format(9) + "</article></main>", 5, "Second"), ("<div>" + BODY + "<div>Yes.</div>" + BODY + "</div>", 8, "Yes."), ('<div class="search results">' + BODY + "</div>", 4, ""),
    ("<article>" + BODY + "<button>Press now.</button></article>", 4, "Press now."), ("<div>" + BODY + "<table><tr><td>1</td><td>2</td></tr></table><blockquote>So it is.</blockquote></div>", 4, "1\n2\nSo it is."),
]


@pytest.mark.parametrize("page, count, part", WHOLE)
def test_an_article_is_kept_whole(page, count, part):
    text = html_main.main_text(page)
    assert text.count("number") == count and part in text and "Copyright" not in text


GONE = ["<title>Title - Site</title><header><h1>Site</h1></header><div>" + BODY + "</div>", "<article>" + BODY + "</article><div class=comments>" + BODY * 9 + "</div>", "<div><a href=1>Menu</a> <a>b</a></div><div>" + BODY + "</div>", "<div>" + BODY + "</div><div><button>Press</button></div>", "<div>" + BODY + "</div><div class=search>Find it</div>"]


@pytest.mark.parametrize("page", GONE)
def test_furniture_goes(page):
    assert html_main.main_text(page) == html_main.main_text("<div>" + BODY + "</div>")


def test_regions_are_chosen_as_by_a_plain_version():
    import pandas as pd

    from tests.conftest import DATA

    pages = pd.read_parquet(f"{DATA}/sf0.01/pages.parquet").html.tolist()
    for html in [*pages, *[p.replace("article", "div") for p in pages[:100]], "<div><a href=1>x</a> y</div><div>" + BODY + "</div><footer>z</footer>", *[p for p, *_ in WHOLE], *GONE]:
        assert html_main.main_text(html) == plain_main_text(html_main.blocks_of(html))


@pytest.mark.parametrize("mark", ["<a ", "<!--", '<a href="', "&#", "&a", "<", "</a ", "<![CDATA[", "<?", "<!d", "<a/", "<a b=", "<p/ x", "<!-- -", "/x", "<script>x</"])
@pytest.mark.parametrize("end", ["", ">", '">', "-->"])
def test_unfinished_markup_takes_time_by_its_length(mark, end):
    import time

    def seconds(n):
        start = time.process_time()
        html_main.main_text("<div><p>Some words.</p><a " + mark * n + end)
        return time.process_time() - start

    seconds(100)
    assert seconds(16000) < 8 * max(seconds(4000), 0.05)


def test_a_megabyte_page_is_whole():
    text = html_main.main_text("<nav>" + "<a>x</a>" * 9000 + "</nav><article>" + "".join(P.format(k) for k in range(12000)) + "</article>")
    assert text.count("\n") == 11999 and "number 11999," in text
