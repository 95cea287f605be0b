"""HTML extraction against a plain parser of well-formed pages, on broken pages, and on very long hostile ones."""

from __future__ import annotations

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from binsift.llm import html

T = "This is the first paragraph of the story and it is long enough to be a block of text that is in the article of the page."
G = f"<p>{T}</p>"
A = f"<article>{G}</article>"
RU = "Это первый абзац рассказа, он достаточно длинный, чтобы быть блоком текста в статье на этой странице. " * 3


class Plain(HTMLParser):
    """Text of the paragraphs and headings inside article elements of a well-formed page, furniture inside them left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.inside, self.gone = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("nav", "aside", "footer") or tag == "div" and dict(attrs).get("class") in ("ad", "share", "comments"):
            self.gone += 1
        if tag in ("p", "h1", "li"):
            self.parts = []
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li") and self.inside and not self.gone and (text := " ".join("".join(self.parts).split())):
            self.out.append(text)
        if tag == "article":
            self.inside -= 1
        if tag in ("nav", "aside", "footer", "div") and self.gone:
            self.gone -= 1

    def handle_data(self, data):
        self.parts.append(data)


def a_page(draw: random.Random, article: bool = True) -> tuple[str, list[str]]:
    """A well-formed page and the texts of its story."""
    words = "the of and a river stone house that it was in to with old green walk light for on hill".split()
    sentence = lambda n: " ".join(draw.choice(words) for _ in range(n)).capitalize() + "."
    story, truth = [], []
    for k in range(draw.randint(2, 7)):
        text = sentence(draw.randint(18, 60))
        truth.append(text)
        marked = text.replace(" old ", " <b>old</b> ").replace(" hill ", " &#104;ill ").replace(" walk ", "\n walk<br> ")
        story.append(f"<p{draw.choice(['', ' class=x', ' id="p1"', " style='overflow:hidden'", " title='a > b'"])}>{marked}</p>")
        if k % 3 == 2:
            story.append(f'<div class="{draw.choice(["ad", "share", "comments"])}"><p>{sentence(20)}</p></div>')
    links = "".join(f"<li><a href=/{k}>{sentence(2)}</a></li>" for k in range(6))
    body = f"<article><h1>{sentence(4)}</h1>{''.join(story)}</article>" if article else f"<div id=content>{''.join(story)}</div>"
    head = f"<head><title>{sentence(3)}</title><style>p{{}}</style><script>if (a < b) document.write('<p>{sentence(30)}</p>')</script></head>"
    page = f"<!DOCTYPE html><html>{head}<body><nav><ul>{links}</ul></nav><!-- <p>{sentence(30)}</p> -->{body}<aside><p>{sentence(30)}</p></aside><footer><p>{sentence(25)}</p></footer></body></html>"
    return page, truth


@pytest.mark.parametrize("seed", range(40))
def test_well_formed_pages_equal_a_plain_parser(seed):
    page, truth = a_page(random.Random(seed))
    plain = Plain()
    plain.feed(page)
    got = html.main_text(page)[0].split("\n")
    assert got == plain.out
    assert got[1:] == truth


def test_recall_and_precision_without_article_elements():
    kept = wanted = given = 0
    for seed in range(200):
        page, truth = a_page(random.Random(1000 + seed), article=False)
        got = html.main_text(page)[0].split("\n")
        kept, wanted, given = kept + len(set(got) & set(truth)), wanted + len(set(truth)), given + len(got)
    assert kept / wanted >= 0.98 and kept / given >= 0.98


LONG = (T + " ") * 3
CASES = {
    "a longer div beside": (f"<article><p>{T} And so on.</p></article><div><p>{LONG}</p></div>", [T + " And so on."]),
    "responses beside": (f"<article>{G}</article><section class='responses'><p>{LONG}</p></section>", [T]),
    "responses without article": (f"<div id=content>{G}</div><section class='responses'><p>{LONG}</p></section>", [T]),
    "comments as articles": (f"<main><h1>Head</h1>{G}<div class=comments><article><p>{LONG}</p></article></div></main>", ["Head", T]),
    "linked headline and paragraphs": (f"<article><h1><a href=/x>The headline of it all</a></h1>{G}<p>See <a href=/y>{T}</a></p></article>", ["The headline of it all", T, f"See {T}"]),
    "compound names of the text": (f"<article><p class='share-price'>{T}</p><p class='ad-hoc-report'>Short.</p><p id=commentary-1>{T}</p></article>", [T, "Short.", T]),
    "compound names of furniture": (f"<article>{G}<div class='share-buttons'>Share</div><div class=shareBar>it</div><div id=comments-area-2><p>{T}</p></div><div class='post-comments'>{G}</div></article>", [T]),
    "mathematics": (f"<article><p>We know <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds. {T}</p></article>", [f"We know x=1 holds. {T}"]),
    "short paragraphs": ("<div><p>One two.</p><p>Three.</p></div><nav><a href=/>home</a></nav>", ["One two.", "Three."]),
    "an article in main": (f"<main><div><p>{LONG}</p></div><article><h1>A</h1>{G}</article></main>", ["A", T]),
    "teasers led by links": (f"<div><p>{LONG}</p></div>" + f"<article><h2><a href=/1>One story</a></h2>{G}</article>" * 2, [LONG.strip()]),
    "lists": (f"<article>{G}<ul><li>One</li><li>Two <a href=/>x</a></li></ul><ul><li><a href=/>Home page</a></li><li><a href=/>Away page</a></li></ul></article>", [T, "One", "Two x"]),
}


@pytest.mark.parametrize("name", CASES)
def test_the_article_is_neither_swapped_nor_thinned(name):
    page, wanted = CASES[name]
    assert html.main_text(page)[0].split("\n") == wanted


def nested_page(draw: random.Random) -> tuple[str, list[str]]:
    """A page of random nesting with one or two articles among text that isn't theirs, and the texts of the articles."""
    words = "the of and a river stone house that it was in to with old green walk light for on hill".split()
    sentence = lambda lo, hi: " ".join(draw.choice(words) for _ in range(draw.randint(lo, hi))).capitalize() + "."
    truth: list[str] = []

    def wrapped(inner: str, depth: int) -> str:
        for _ in range(depth):
            e = draw.choice(["div", "section", "div"])
            inner = f"<{e}{draw.choice(['', ' class=row', ' class="layout-two wide"', ' id=page-7', ' class=share-price', ' class="grid ad-free"'])}>{inner}</{e}>"
        return inner

    def piece(k: int) -> str:
        kind = draw.choice(["p", "p", "p", "h2", "li", "quote", "linked", "short", "math", "named", "pre"])
        text = sentence(1, 6) if kind in ("h2", "short") else sentence(8, 60)
        truth.append(text)
        if kind == "h2":
            return f"<h2>{draw.choice([text, f'<a href=/{k}>{text}</a>'])}</h2>"
        if kind == "li":
            truth.append(other := sentence(3, 9))
            return f"<ul><li>{text}<li>{other}</ul>"
        if kind == "quote":
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind == "linked":
            return f"<p><a href=/{k}>{text[: len(text) * 2 // 3]}</a>{text[len(text) * 2 // 3 :]}</p>"
        if kind == "math":
            truth[-1] = f"Then x<y holds. {text}"
            return f"<p>Then <math><mi>x</mi><mo>&lt;</mo><mi>y</mi></math> holds. {text}</p>"
        if kind == "named":
            return f"<p class='{draw.choice(['lead', 'ad-hoc', 'comment-worthy', 'legal', 'intro promo-free', 'search-theory'])}'>{text}</p>"
        return f"<{'pre' if kind == 'pre' else 'p'}>{text}</{'pre' if kind == 'pre' else 'p'}>"

    def noise() -> str:
        text = f"<p>{sentence(10, 90)}</p>" * draw.randint(1, 2)
        return draw.choice([
            f"<div class=ad>{text}</div>", f"<div class='share-links bar'>{text}</div>", f"<aside>{text}</aside>", f"<div id=newsletter-box>{text}</div>", f"<form>{text}</form>", f"<div hidden>{text}</div>",
            "<ul>" + "".join(f"<li><a href=/{i}>{sentence(1, 4)}</a></li>" for i in range(4)) + "</ul>", f"<div class='comments-list'><article>{text}</article></div>", f"<script>{text}</script>", f"<!-- {text} -->",
        ])

    def beside() -> str:
        text = f"<p>{sentence(20, 120)}</p>" * draw.randint(1, 3)
        return draw.choice([f"<div>{text}</div>", f"<div class=sidebar>{text}</div>", f"<section class=responses>{text}</section>", f"<div class=comments><article class=comment>{text}</article></div>", f"<article class=teaser>{text}</article>", noise()])

    body = ""
    for a in range(draw.randint(1, 2)):
        truth.append(text := sentence(20, 60))
        inner = f"<header><h1>Headline {a} of it</h1></header><p>{text}</p>"
        truth.insert(len(truth) - 1, f"Headline {a} of it")
        for k in range(draw.randint(1, 6)):
            inner += wrapped(piece(k), draw.randint(0, 3)) + (noise() if draw.random() < 0.4 else "")
        body += wrapped(f"<article class={draw.choice(['post', 'story', 'entry-7'])}>{inner}</article>", draw.randint(0, 4))
        body += wrapped(beside(), draw.randint(0, 2))
    body = wrapped(beside(), draw.randint(0, 2)) + body
    body = f"<main>{body}</main>" if draw.random() < 0.4 else body
    return f"<html><head><title>x</title></head><body><header class=masthead>{sentence(5, 9)}</header><nav>{sentence(3, 5)}</nav>{body}<footer>{sentence(9, 30)}</footer></body></html>", truth


def test_recall_and_precision_on_randomly_nested_pages():
    kept = wanted = given = 0
    for seed in range(500):
        page, truth = nested_page(random.Random(seed))
        got = html.main_text(page)[0].split("\n")
        a, b = Counter(got), Counter(truth)
        kept, wanted, given = kept + (a & b).total(), wanted + b.total(), given + a.total()
    assert kept / wanted >= 0.98 and kept / given >= 0.98


BROKEN = {
    "no end of head": f"<html><head><title>x</title><body>{A}",
    "open svg": f"<svg><path d='1'>{A}",
    "open noscript": f"<noscript>{A}",
    "open iframe": f"<iframe src=x>{A}",
    "open select": f"<select><option>a{A}",
    "open svg before a closed one": f"<svg><path>{A}<svg><text>x</text></svg>",
    "open script": f"{A}<script>var x",
    "open comment": f"<!-- x {A}",
    "style that hides nothing": f"<article style='overflow:hidden'>{G}</article>",
    "class that hides nothing": f"<article class='overflow-hidden'>{G}</article>",
    "aria-hidden=false": f"<article aria-hidden='false'>{G}</article>",
    "apostrophe in a bare value": f"<article><p title=don't>{T}</p><p hidden title='x'>Not shown.</p></article>",
    "open quote": f'<article><p title="abc>{T}</p><p hidden class="x">Not shown.</p></article>',
    "page in a form": f"<form id=aspnetForm><div>{G}</div></form>",
    "unfinished tag": f"{A}<p class='",
    "upper case and blanks": f"<ARTICLE\n><P\tCLASS = 'x' >{T}</P ></ARTICLE >",
    "nested deep": "<div>" * 5000 + A + "</div>" * 5000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_keep_their_text(name):
    assert html.main_text(BROKEN[name])[0] == T


@pytest.mark.parametrize("attrs", ["class=legal", "id='related-work'", "class=search", "class=form", "class='notice big'"])
def test_doubtful_names_inside_articles(attrs):
    assert html.main_text(f"<article>{G}<div {attrs}>{G}</div></article>")[0] == f"{T}\n{T}"


def test_text_beside_teasers_and_articles_beside_comments():
    assert html.main_text(f"<div>{G}{G}{G}</div><article class=teaser><p>Another story about it all.</p></article>")[0] == "\n".join([T] * 3)
    assert html.main_text(f"<article>{G}{G}</article><article class=comment>{G}</article>")[0] == "\n".join([T] * 2)


def test_a_page_in_another_language_with_an_english_notice():
    assert html.main_text(f"<div><p>{RU}</p><p>{RU}</p></div>")[0] == "\n".join([RU.strip()] * 2)
    assert RU.strip() in html.main_text(f"<div><p>{RU}</p><p>{RU}</p></div><div>{G}</div>")[0]


HOSTILE = ["<script", "<a ", "<div>", "<!--", '<p title="', "<p a='\">", "<svg>", "<script>", "</p>", "<a href='x", "<title>", "<li>", "<svg></svg", "<!-->", "<div class='a b'>", "&lt;", "<b><i>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_long_hostile_pages_take_time_in_proportion(piece):
    start = time.process_time()
    html.main_text(piece * (5_000_000 // len(piece)))
    assert time.process_time() - start < 10
