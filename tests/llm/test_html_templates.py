"""Main text of hand-made templates, against the article that each was built from, and of all pages against their article element."""

import html as entities
import random
import re
import time

import pytest

from strophe.llm import html_main

WORDS = [f"{a}{b}" for a in ("bar", "lon", "tis", "mer", "quo", "sal") for b in ("a", "ent", "ior", "um", "esque", "y")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def chrome(rng):
    return "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News of today</a></li></ul></nav>", "<footer><p>Imprint and contact of the publisher</p></footer>"


def paragraphs(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


def article_of(rng):
    return sentence(rng, 6), [sentence(rng, rng.randint(15, 40)) for _ in range(4)]


def has_sidebar(rng, title, parts):
    return f'<div class="container has-sidebar"><article><h1>{title}</h1>{paragraphs(parts)}</article><div class="sidebar">{sentence(rng, 20)}</div></div>', [title, *parts]


def no_sidebar_page(rng, title, parts):
    return f'<body class="search-page no-sidebar with-comments"><div class="has-widget with-comments"><h1>{title}</h1>{paragraphs(parts)}</div></body>', [title, *parts]


def intro_and_body(rng, title, parts):
    return f'<article><h1>{title}</h1><div class="intro"><p>{parts[0]}</p></div><div class="body">{paragraphs(parts[1:])}</div></article>', [title, *parts]


def intro_in_plain_divs(rng, title, parts):
    return f'<div id="page"><div class="top"><h1>{title}</h1><div class="lead"><p>{parts[0]}</p></div><div class="rest">{paragraphs(parts[1:])}</div></div></div>', [title, *parts]


def comment_blockquote(rng, title, parts):
    return f'<main><h1>{title}</h1><p>{parts[0]}</p><blockquote class="comment">{parts[1]}</blockquote><p>{parts[2]}</p></main><section id="comments"><p>{sentence(rng, 300)}</p></section>', [title, *parts[:3]]


def nested_sections(rng, title, parts):
    inner = "".join(f"<section><h2>Part {i}</h2><p>{p}</p></section>" for i, p in enumerate(parts))
    return f'<div class="wrap"><div class="post">{inner}</div><div class="share-buttons"><p>{sentence(rng, 12)}</p></div></div>', [x for i, p in enumerate(parts) for x in (f"Part {i}", p)]


def title_outside(rng, title, parts):
    return f'<header><h1>The Daily Site</h1></header><h1>{title}</h1><div class="text">{paragraphs(parts)}</div><div class="related">{sentence(rng, 25)}</div>', [title, *parts]


def whole_page_form(rng, title, parts):
    return f'<form action="/"><div id="main"><h1>{title}</h1>{paragraphs(parts)}<form><p>Write to us here</p><input name="q"></form></div></form>', [title, *parts]


def unclosed(rng, title, parts):
    return f"<div class=content><h1>{title}</h1><p>{'<p>'.join(parts)}<ul><li>one<li>two <b>bold</ul><table><tr><td>cell<td>next<tr><td>third</table></div><aside>{sentence(rng, 9)}</aside>", [title, *parts, "one", "two bold", "cell", "next", "third"]


def wordpress(rng, title, parts):
    comments = "".join(f'<li class="comment"><article id="div-comment-{i}" class="comment-body"><p>{sentence(rng, 60)}</p></article></li>' for i in range(6))
    body = f'<article class="post-7 post"><header class="entry-header"><h1 class="entry-title">{title}</h1></header><div class="entry-content">{paragraphs(parts)}</div></article>'
    return f'<main>{body}<div id="comments" class="comments-area"><ol class="comment-list">{comments}</ol></div></main><div class="related-posts"><article><p>{sentence(rng, 30)}</p></article></div>', [title, *parts]


def unmarked_boilerplate(rng, title, parts):
    return f'<div class="xa"><div class="xb">{"Our paper is read by all who like to read papers. " * 3}</div><div class="xc"><h1>{title}</h1>{paragraphs(parts)}</div></div>', [title, *parts]


def stray_quotes(rng, title, parts):
    return f"<div class='content' data-x=it's><h1 title=don't>{title}</h1><!-- <p>no</p> --><p data-a='>'>{parts[0]}</p><p>{entities.escape('5 < 6 & 7')}&nbsp;x</p></div>", [title, parts[0], "5 < 6 & 7 x"]


TEMPLATES = [has_sidebar, no_sidebar_page, intro_and_body, intro_in_plain_divs, comment_blockquote, nested_sections, title_outside, whole_page_form, unclosed, wordpress, unmarked_boilerplate, stray_quotes]


def test_templates(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t, template in enumerate(TEMPLATES):
        for n in range(12):
            body, parts = template(rng, *article_of(rng))
            top, bottom = chrome(rng)
            i = 100 * t + n
            rows.append((i, f"http://{template.__name__}.org/{n}", f"<!DOCTYPE html><html><head><title>T</title><script>var a = '<p>';</script></head>{top}{body}{bottom}</html>"))
            want[i] = "\n".join(parts)
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = {TEMPLATES[i // 100].__name__: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong


@pytest.mark.parametrize("template", TEMPLATES)
def test_single_pages(template):
    """Without a host to vote, nothing of the article goes; what no word marks may stay."""
    rng = random.Random(3)
    body, parts = template(rng, *article_of(rng))
    lines = html_main.main_text(body, None, set(), set()).split("\n")
    if template is not intro_in_plain_divs:
        assert [x for x in lines if x in parts] == parts


def test_deep_and_long_pages():
    began = time.perf_counter()
    assert html_main.main_text("<div>" * 5_000 + "deep" + "</section></div>" * 5_000, None, set(), set()) == "deep"
    steps = "".join(f"<div><p>step {i}</p>" for i in range(5_000))
    text = html_main.main_text(steps, None, set(), set())
    assert len(html_main.votes(steps)) > 100 and "step 4999" in text
    many = "<article>" + "".join(f"<p>par {i}" for i in range(50_000)) + "</article>"
    assert html_main.main_text(many, None, set(), set()).count("\n") == 49_999
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_pages(spark, sf):
    """The pages are of one template; the article element, read by regular expressions, is the answer."""
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_main.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " "))).strip() for b in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)]
        assert r["text"] == "\n".join(filter(None, blocks))


def read(body, path=None):
    return html_main.main_text(f"<html><body>{body}</body></html>", path, set(), set())


PASSAGE = " ".join(f"word{i}" for i in range(60)) + "."


@pytest.mark.parametrize("inline", ["<svg><text>x</text></svg>", "<button>x</button>", "<select><option>x</option></select>", "<canvas>x</canvas>", "<audio>x</audio>", "<video>x</video>", "<object>x</object>", "<svg/>", "<button><div>x</div></button>"])
def test_inline_elements_do_not_cut_a_block(inline):
    assert read(f"<article><p>A {inline} B {PASSAGE}</p><p>C</p></article>") == f"A B {PASSAGE}\nC"


def test_an_open_inline_element_ends_with_its_block():
    assert read(f"<article><p>{PASSAGE} A <button>x</p><p>B {PASSAGE}</p></article>") == f"{PASSAGE} A\nB {PASSAGE}"


@pytest.mark.parametrize("name", ["social-history", "related-work", "search", "login", "notice", "share-prices", "hidden-costs"])
def test_class_words_alone_delete_nothing(name):
    text = read(f'<article><p>First {PASSAGE}</p><div class="{name}"><p>Second {PASSAGE}</p></div><p>Third {PASSAGE}</p></article>')
    assert text.split("\n") == [f"{x} {PASSAGE}" for x in ("First", "Second", "Third")]


def test_class_words_with_a_second_sign():
    body = f'<p>First {PASSAGE}</p><div class="advert">Buy these fine things today.</div><div class="related"><p><a href="x">{PASSAGE}</a></p></div><p>Last {PASSAGE}</p><div class="comments"><p>Reader {PASSAGE}</p></div>'
    assert read(f"<article>{body}</article>") == f"First {PASSAGE}\nLast {PASSAGE}"


def test_sibling_articles_stay():
    assert read(f"<article><p>A {PASSAGE}</p></article><article><p>B {PASSAGE}</p></article>") == f"A {PASSAGE}\nB {PASSAGE}"
