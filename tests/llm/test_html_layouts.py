"""Layouts in which names or the step to the container must not lose text of the article."""

from __future__ import annotations

import time

import numpy as np
import pytest

from framelake.llm import html_text

STORY = "".join(f"<p>Paragraph {k} of the story, long enough to count, with marks.</p>" for k in range(12))
TEXT = " ".join(f"Paragraph {k} of the story, long enough to count, with marks." for k in range(12))


@pytest.mark.parametrize("name", ["class='has-sidebar'", "class=no-sidebar", "id='comments-open'", "class='layout widget'"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_names_around_the_article(name, tag):
    page = f"<body><nav>menu</nav><div {name}><{tag}>{STORY}</{tag}></div><div class='sidebar'>Side, one.</div></body>"
    assert html_text.main_text(page) == TEXT


def test_names_of_other_elements_still_count():
    comments = "<div class='comments-area'><article><p>Nice, really.</p></article><p>Me, too.</p></div>"
    assert html_text.main_text(f"<body><div class='has-sidebar'><article>{STORY}</article></div>{comments}</body>") == TEXT
    assert html_text.main_text(f"<body><article>{STORY}<div class='share-buttons'>Share this.</div></article></body>") == TEXT


def test_lead_in_a_block_of_its_own():
    lead = "<div class=lead><p>A lead, short, of the story.</p></div>"
    assert html_text.main_text(f"<body>{lead}<div class=story>{STORY}</div></body>") == f"A lead, short, of the story. {TEXT}"
    nested = f"<body><div>{lead}<div><div class=lead><p>Second lead, short, of it.</p></div><div class=story>{STORY}</div></div></div></body>"
    assert html_text.main_text(nested) == f"A lead, short, of the story. Second lead, short, of it. {TEXT}"
    assert html_text.main_text(f"<body><div>Bare lead, with <b>bold</b> words, of it.<div>{STORY}</div></div></body>") == f"Bare lead, with bold words, of it. {TEXT}"


def test_blocks_beside_an_article_are_left_out():
    assert html_text.main_text(f"<body><div><p>Teaser, of another.</p></div><article>{STORY}</article></body>") == TEXT


LINKS = "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(8))
#: Pages without article, main or telling names: only the ratios of their paths tell what is content.
PLAIN = {
    "divs": (f"<body><div><ul>{LINKS}</ul></div><div><h2>Head line</h2>{STORY}<ul><li>one</li><li>two</li></ul></div><div><span>Site map</span></div></body>", f"Head line {TEXT} one two"),
    "cells": (f"<body><table><tr><td><div><a href=x>Home</a></div><div><a href=y>Shop</a></div></td><td>{STORY}</td></tr></table></body>", TEXT),
    "box": (f"<body><div><p>Start of it, long enough to count, with marks, and more.</p><div><a href=z>Buy now</a></div>{STORY}<div><a href=z>Next</a></div></div></body>", f"Start of it, long enough to count, with marks, and more. {TEXT}"),
    "article": (f"<body><article><h1>Head</h1>{STORY}<div><a href=q>More of this</a></div><p>End.</p></article></body>", f"Head {TEXT} End."),
}


@pytest.mark.parametrize("name", PLAIN)
def test_ratios_choose_the_content(name):
    page, want = PLAIN[name]
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("answer", [lambda page, nodes: np.ones(len(nodes), bool), lambda page, nodes: np.zeros(len(nodes), bool)])
def test_nothing_else_would(answer, monkeypatch):
    """With a constant choice of content nodes every one of these pages comes out wrong."""
    monkeypatch.setattr(html_text, "_content", answer)
    assert all(html_text.main_text(page) != want for page, want in PLAIN.values())


@pytest.mark.parametrize("seed", range(5))
def test_nor_a_random_choice(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(html_text, "_content", lambda page, nodes: rng.random(len(nodes)) < 0.5)
    assert sum(html_text.main_text(page) != want for page, want in PLAIN.values()) >= 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>" * 100_000 + "x", "x"), ("<p><table><td>" + "<div>" * 50_000 + "x", "x"), ("<a " * 100_000, ""), ("a" + "</" * 100_000, "a"), ("<div>" * 50_000 + "</span>" * 50_000 + "x", "x"),
        ("<!--" * 50_000, ""), ("<p>" + "word " * 500_000, ("word " * 500_000).strip()), ("<p><b>x<br>" * 20_000, ("x " * 20_000).strip()),
    ],
)
def test_long_and_deep_pages(page, want):
    began = time.perf_counter()
    assert html_text.main_text(page) == want
    assert time.perf_counter() - began < 20


#: Short blocks, headings, headers and lists of an article stay; only subtrees of links without content go.
WHOLE = {
    "correction": (f"<article><h1>T</h1>{STORY}<section><h2>Correction</h2><p>It was June.</p></section></article>", f"T {TEXT} Correction It was June."),
    "byline": (f"<article><header><h1>HeadX</h1><div><p>By WriterY</p></div></header><div class=body>{STORY}</div></article>", f"HeadX By WriterY {TEXT}"),
    "headline": (f"<main><div><h1>HeadX</h1></div><div>{STORY}</div></main>", f"HeadX {TEXT}"),
    "linked headline": (f"<article><div><h1><a href=p>HeadX</a></h1></div>{STORY}</article>", f"HeadX {TEXT}"),
    "linked author": (f"<article><h1>H</h1><div><a href=w>Writer Y</a></div><div>{STORY}</div></article>", f"H Writer Y {TEXT}"),
    "author before": (f"<article><h1>H</h1><div>By <a href=w>Writer Y</a></div><div>{STORY}</div><div>Filed in <a href=t>Town</a></div></article>", f"H By Writer Y {TEXT} Filed in Town"),
    "date": (f"<article><h1>H</h1><time>1 June</time><section>{STORY}</section><div>Updated 2 June</div></article>", f"H 1 June {TEXT} Updated 2 June"),
    "figure": (f"<article>{STORY}<figure><img src=x><figcaption>A bridge</figcaption></figure></article>", f"{TEXT} A bridge"),
    "list": (f"<article>{STORY}<div><ul><li>one</li><li><a href=x>two</a></li><li>three</li></ul></div></article>", f"{TEXT} one two three"),
    "table": (f"<main>{STORY}<table><tr><th>Year<th>Rain<tr><td>1<td>2</table></main>", f"{TEXT} Year Rain 1 2"),
    "quote": (f"<article>{STORY}<blockquote>So it goes</blockquote><div>Someone</div></article>", f"{TEXT} So it goes Someone"),
    "sections": (f"<main><section><h2>A</h2>{STORY}</section><section><h2>B</h2><p>Short</p></section></main>", f"A {TEXT} B Short"),
    "code": (f"<article>{STORY}<pre>x = 1</pre><div>Done</div></article>", f"{TEXT} x = 1 Done"),
    "one form": (f"<body><form action=x><input type=hidden><div><h1>H</h1>{STORY}</div></form></body>", f"H {TEXT}"),
    "form of controls": (f"<body><div>{STORY}</div><form><label>Name</label><input><select><option>a</select></form></body>", TEXT),
    "related": (f"<article>{STORY}<section><h3>More</h3><ul>{LINKS}</ul></section></article>", TEXT),
    "tags": (f"<article><h1>H</h1>{STORY}<div><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div></article>", f"H {TEXT}"),
    "shares": (f"<article><h1>H</h1><div><a href=a>Post</a><a href=b>Send</a><a href=c>Pin</a></div><div>{STORY}</div></article>", f"H {TEXT}"),
    "links of content": (f"<article>{STORY}<p>See <a href=x>the report</a></p><p><a href=y>The whole report</a></p></article>", f"{TEXT} See the report The whole report"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_the_whole_article(name):
    page, want = WHOLE[name]
    assert html_text.main_text(page) == want
    assert html_text.main_text(f"<body><nav><ul>{LINKS}</ul></nav>{page}<footer>End</footer></body>") == want
