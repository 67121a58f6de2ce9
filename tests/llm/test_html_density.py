import html
import math
import re

import pyarrow.parquet as pq
import pytest

from granary.llm.html_density import LEAST_LINK_SHARE, extract, in_order, main_text, measure, parse

PROSE = "A long enough sentence about the weather, the harvest and the market. " * 4
NOISE = """<header><a href="/">Home</a> Daily paper</header><div id="header"><p>The daily paper of this town and of its people</p></div><nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for all of you who read it.</div>
<aside>Most read: ten stories you must not miss this week</aside><div class="ad-box">Buy this now, it is cheap and good</div>
<form action="/s"><label>Search</label><input name="q"><button>Go</button></form><script>var x = "<p>no</p>" + "</div>";</script><style>p{}</style>"""
COMMENTS = f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{PROSE * 3}</p></article></section>'
FOOT = '<footer>&copy; the paper</footer>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title></head><body>{NOISE}{body}{COMMENTS}{FOOT}</body></html>"


WANT = " ".join(["Title & more", PROSE.strip(), "Second bold part.", PROSE.strip()])
PARTS = f"<h1>Title &amp; more</h1><p>{PROSE}</p>\n<p>Sec<b>ond</b> bold<br>part.<p>{PROSE}"


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{PARTS}</article>",
        f"<main><article>{PARTS}</article></main>",
        f'<div id="wrap" class="has-sidebar"><div class="content">{PARTS}</div></div>',
        f"<div><div><h1>Title &amp; more</h1><div>{PARTS.partition('</h1>')[2]}</div></div></div>",
        f'<article><header><h1>Title &amp; more</h1></header>{PARTS.partition("</h1>")[2]}<footer>by us</footer></article>',
        f"<ARTICLE CLASS='x'>{PARTS}</ARTICLE>",
        f"<article>{PARTS}",
    ],
)
def test_layouts(body):
    assert main_text(page(body)) == WANT


@pytest.mark.parametrize(
    "page_, want",
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("just text &lt; that &amp;amp; ends", "just text < that &amp; ends"),
        ("<p>a < b and c", "a < b and c"),
        ("<p>one<p>two <i>th</i>ree</p> <!-- <p>no</p> --> four", "one two three four"),
        ("<p>open <a href='x>y' title=\"a>b\">link</a> text", "open link text"),
        ("<div><script>if (a < b) {}", ""),
        ("<p>x&nbsp;\n y</p>", "x y"),
        ("text <div foo", "text"),
    ],
)
def test_small_pages(page_, want):
    assert main_text(page_) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 30_000 + PROSE + "</div>" * 30_000) == PROSE.strip()
    assert len(main_text("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>")) == 5000 * len(PROSE) - 1
    assert main_text("<" * 50_000 + "a" * 10) is not None
    assert main_text("<a '" * 20_000) is not None


def paragraphs(sizes):
    return ["".join(f"<p>{'word ' * (n // 5 - 1)}end{k}.</p>" for k in range(count)) for count, n in sizes]


@pytest.mark.parametrize("sizes", [[(6, 300), (5, 280)], [(5, 280), (6, 300)], [(6, 300), (2, 250), (4, 280)]])
def test_sections_of_unequal_length(sizes):
    parts = paragraphs(sizes)
    body = "".join(f'<div class="section">{p}</div>' for p in parts)
    want = " ".join(re.sub(r"<[^>]*>", " ", "".join(parts)).split())
    for inner in (f'<div class="content">{body}</div>', body):
        assert main_text(page(f'{inner}<div><a href="/x">All stories of today</a><a href="/y">All of this week</a></div>')) == want


@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", "<div><section>{}</section></div>"])
def test_articles_of_unequal_length(around):
    parts = paragraphs([(2, 250), (6, 300), (1, 280)])
    body = "".join(around.format(f"<article>{p}</article>") for p in parts)
    links = "<div><article><a href='/x'>More of it</a> <a href='/y'>And more</a></article></div>"
    assert main_text(page(body + links)) == " ".join(re.sub(r"<[^>]*>", " ", "".join(parts)).split())


STATE = '<input type="hidden" name="state" value="x"><input type=hidden name="v">'


@pytest.mark.parametrize(
    "around",
    [
        '<form id="form1" action="./page.aspx">' + STATE + "{}</form>",
        '<form action="/"><div><label>Search</label><input name="q"><button>Go</button></div>{}</form>',
        '<form class="search" action="/">' + STATE + "{}</form>",
        "<form>" + STATE + "{}",
        "<form>" + STATE + '<form action="/s"><input name="q"></form>{}</form>',
        "<form>" + STATE + "<input>" * 40 + "{}</form>",
    ],
)
def test_page_within_a_form(around):
    for body in (f"<article>{PARTS}</article>", f'<div class="content">{PARTS}</div>'):
        whole = page("@").replace(NOISE, NOISE.partition("<form")[0])
        assert main_text(whole.replace("<body>", "<body>" + around.partition("{}")[0]).replace("@", body).replace("</body>", around.partition("{}")[2] + "</body>")) == WANT


def test_forms_of_controls_are_no_article():
    form = "<form action='/send'><p>Write to us, and we will answer within two days of your letter.</p>" + "<p><label>Name</label><input name=n></p>" * 4 + "</form>"
    assert main_text(f"<body><div class='content'>{PARTS}</div>{form}</body>") == WANT
    assert main_text("<form>" * 30_000 + PROSE + "</form>" * 30_000) == PROSE.strip()


@pytest.mark.parametrize(
    "kept",
    [
        f'<p class="market-share">{PROSE}</p>', f'<p class="related-work">{PROSE}</p>', f'<div class="notice-board">{PROSE}</div>',
        f'<p class="notice">{PROSE}</p>', f'<div id="discussion">{PROSE}</div>', f"<p><label>{PROSE}</label></p>",
        f"<aside class='pull-quote'>{PROSE}</aside>", f"<aside><blockquote>{PROSE}</blockquote></aside>", f'<p id="ad-hoc">{PROSE}</p>',
    ],
)
def test_everyday_words_mark_nothing(kept):
    for tag in ("article", "div"):
        if tag == "article" or not any(w in kept for w in ('"notice"', '"discussion"', "<aside")):
            assert main_text(page(f"<{tag}>{PARTS}{kept}</{tag}>")) == f"{WANT} {PROSE.strip()}"


def test_sections_named_by_everyday_words():
    assert main_text(page(f'<section class="social-science">{PARTS}</section>')) == WANT
    assert main_text(page(f"<article>{PARTS}<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> be</p></article>")) == f"{WANT} let x=1 be"


@pytest.mark.parametrize(
    "dropped",
    [
        f'<div class="ad-box">{PROSE}</div>', f'<div class="reader-comments">{PROSE}</div>', f"<aside>{PROSE}</aside>",
        f'<div class="share"><a href="/x">{PROSE}</a></div>', '<div class="notice"><p>Write to us.</p><input name="q"></div>',
        '<label for="q">Search</label>', '<label>Search <input name="q"></label>', f'<div class="Advert 300x250">{PROSE}</div>',
    ],
)
def test_noise_within_an_article(dropped):
    assert main_text(page(f"<article>{PARTS}{dropped}</article>")) == WANT


def test_title_in_a_block_of_its_own():
    head, rest = PARTS.split("</h1>")
    body = f"<div class='intro'>{head}</h1><p>What it is about.</p></div><article>{rest}</article>"
    assert main_text(page(body)) == WANT.replace("Title & more", "Title & more What it is about.")
    assert main_text(page(f"<div><h1>The daily paper</h1></div><article>{PARTS}</article>")) == WANT


def test_short_paragraphs_among_long_ones():
    body = f"<h1>T</h1><p>{PROSE * 9}</p><p>Short.</p><ul><li>One</li></ul><ul><li><a href='/a'>Another story</a></li></ul>"
    for tag in ("article", "div"):
        assert main_text(page(f"<{tag}>{body}</{tag}>")).startswith(f"T {(PROSE * 9).strip()} Short. One")


def plain_density(chars, tags, link_chars, link_tags, share):
    """The formula as published, where zero divisors count as one."""
    if chars == 0:
        return 0.0
    lc, lt, t, other = link_chars or 1, link_tags or 1, tags or 1, chars - link_chars or 1
    base = max(math.log(chars / other * link_chars + share * chars + math.e), 1.01)
    return chars / t * max(math.log(max(chars / lc * (t / lt), 1.0)) / math.log(base), 1e-3)


def plain_counts(node):
    """Characters, tags, and those of links, by plain recursion."""
    texts = sum(len(c.strip()) for c in node.children if isinstance(c, str))
    inner = [(plain_counts(c), c) for c in node.children if not isinstance(c, str) and not c.noise]
    chars = texts + sum(x[0] for x, _ in inner)
    tags = sum(x[1] + 1 for x, _ in inner)
    link_chars, link_tags = sum(x[2] for x, _ in inner), sum(x[3] for x, _ in inner)
    return (chars, tags, chars, link_tags + 1) if node.name == "a" else (chars, tags, link_chars, link_tags)


def test_densities_against_a_plain_version():
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    for text in [*pages[:60], page(f"<div>{PARTS}<p>see <a href='/x'>this</a> one</p></div>")]:
        root = parse(text)
        nodes = in_order(root)
        measure(nodes)
        whole = plain_counts(root)
        share = max(LEAST_LINK_SHARE, whole[2] / max(1, whole[0]))
        for node in nodes:
            total = 0.0
            for c in node.children:
                if isinstance(c, str):
                    n = len(c.strip())
                    total += plain_density(n, 1, n if node.name == "a" else 0, int(node.name == "a"), share)
                elif not c.noise:
                    total += plain_density(*plain_counts(c), share)
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == plain_counts(node)
            assert node.density == pytest.approx(plain_density(*plain_counts(node), share)) and node.total == pytest.approx(total)


def test_given_pages():
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"<(/?)(p|h1|br)>", " ", inside)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", blocks)).split())
        assert main_text(r["html"]) == want
        assert main_text(r["html"].replace("<article", "<div").replace("</article", "</div")) == want


def test_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", page(f"<article>{PARTS}</article>"), "x"), (None, None, None, None), (1, "u", "<p>é</p>", "y")]
    got = extract(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in got.collect()] == [(1, "u", WANT, len(WANT)), (None, None, "", 0), (1, "u", "é", 1)]
    assert extract(spark.createDataFrame([], schema)).count() == 0
