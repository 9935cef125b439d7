"""Main text of pages with comments, notices, teasers and broken markup."""

from __future__ import annotations

import time

import pytest

from gridlake.llm import html_text as H

LONG = [f"Paragraph {i} of the article tells at some length, with commas and all, what has happened on day {i} and why it matters to everybody." for i in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in LONG)
TEXT = "\n".join(LONG)
BLOCK = "".join(f"<p>Somebody writes a rather long remark number {i} here, which goes on and on and on, and is none of the article.</p>" for i in range(3))
NAMES = """article-comments reader-comments user-comments blog-comments discussion comment-thread feedback site-notice advertisement-content comments
    post-comments cookie-notice widget-ad notice sidebar-content readerComments""".split()


@pytest.mark.parametrize("name", NAMES)
def test_no_leak(name):
    block = f"<div class='{name}'>{BLOCK}</div>"
    assert H.main_text(f"<body><article>{ARTICLE}</article>{block}</body>") == TEXT
    assert H.main_text(f"<body><article>{ARTICLE}{block}</article></body>") == TEXT
    assert H.main_text(f"<body><div id=story>{ARTICLE}</div>{block}</body>") == TEXT
    assert H.main_text(f"<body><main>{ARTICLE}{block}</main></body>") == TEXT
    assert H.main_text(f"<body><div>{ARTICLE}</div><section id='{name}'>{BLOCK}</section></body>") == TEXT


def test_short_article_beside_long_blocks():
    short = "<h1>Head</h1>" + "".join(f"<p>Short line {i}.</p>" for i in range(5))
    text = "\n".join(["Head", *(f"Short line {i}." for i in range(5))])
    for block in (f"<section id='discussion-thread'>{BLOCK * 6}</section>", f"<section>{BLOCK * 6}</section>", f"<div class='plain'>{BLOCK * 6}</div>"):
        assert H.main_text(f"<body><article>{short}</article>{block}</body>") == text
        assert H.main_text(f"<body>{block}<main><article>{short}</article></main></body>") == text


def test_teasers_and_titles():
    teasers = f"<div class='teasers'>{BLOCK}</div>"
    assert H.main_text(f"<main><article>{ARTICLE}</article>{teasers}</main>") == TEXT
    assert H.main_text(f"<main><article>{ARTICLE}</article><div>{BLOCK}</div></main>") == TEXT
    assert H.main_text(f"<main><h1>Title</h1><article>{ARTICLE}</article></main>") == f"Title\n{TEXT}"
    assert H.main_text(f"<main><h1>Site</h1><article><h1>Title</h1>{ARTICLE}</article></main>") == f"Title\n{TEXT}"
    cards = "".join(f"<article><h3>Card {i}</h3><p>See more.</p></article>" for i in range(4))
    assert H.main_text(f"<body><div>{ARTICLE}</div><section>{cards}</section></body>").startswith(TEXT)
    both = H.main_text(f"<body><article>{ARTICLE}</article><article>{ARTICLE}</article><nav><a>x</a></nav></body>")
    assert both == f"{TEXT}\n{TEXT}"


def test_sections_of_an_article_stay():
    for name in ("discussion", "methods", "results", "comments-on-methods", "legal-basis"):
        page = f"<article>{ARTICLE}<section id='{name}'>{BLOCK}</section></article>"
        assert H.main_text(page).count("Somebody") == 3, name
    assert H.main_text(f"<body><div class='article-header'><h1>Title</h1></div><div>{ARTICLE}</div></body>").endswith(TEXT)
    assert H.main_text(f"<article>{ARTICLE}<div class=share><p>Share this with friends.</p></div></article>") == TEXT


@pytest.mark.parametrize(
    "piece", ["<a b=c ", "<a ", "</a ", '<x y="', "<x y='", "<", "<!", "<!--", "</", "<b>", "</i>", "<div>", "<li>", "<p>", "<p hidden>", "<script>", "<script></script ", "<td>", "<div></i>", '<x y=">" ', "<a href=\"x>", "&", "<div><li></li>", "<b><p>"]
)
def test_broken_markup_in_linear_time(piece):
    def took(size):
        page = f"<article>{ARTICLE}</article>" + piece * (size // len(piece))
        began = time.process_time()
        text = H.main_text(page)
        assert text.startswith(TEXT)
        return time.process_time() - began

    took(1000)
    large = took(1_000_000)
    assert large < 12 and large < 40 * max(took(100_000), 0.05)


def test_unclosed_quotes_keep_the_article():
    assert H.main_text(f'<body><a href="x>link</a><article>{ARTICLE}</article>') == TEXT
    assert H.main_text(f"<article>{ARTICLE}</article><p>1 < 2 and <") == TEXT
    assert H.main_text("<p>1 < 2 <b>bold</b> <3 x") == "1 < 2 bold <3 x"
    assert H.main_text("<p>a<!-- > <p>b --><p>c<!--->d<!>e<?x?>f</>g</ 3>h") == "a\ncdefgh"
    words = [f"several words of item {c}" for c in "abcd"]
    assert H.main_text("<article><ul><li>{}<ul><li>{}<li>{}</ul><li>{}</ul>".format(*words)) == "\n".join(words)
