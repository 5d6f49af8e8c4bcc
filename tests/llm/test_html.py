"""Page extraction: marks of the article and around it, hostile pages, awkward rows, labels by a plain second pass."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowlens.llm import html

PROSE = ("This is the story of a town by the river, and it was told to all of them for many years with great care. " * 3).strip()
HARMLESS = ["class='post comments-open'", "class='content no-sidebar'", "class='site-content has-sidebar'",
            "class='entry widget-free'", "class='article social-science'", 'aria-hidden="false"', 'data-id="menu"',
            'data-role="navigation"', 'data-hidden-count="0"', "class=comments-open", "title='it is hidden'"]
OUTSIDE = ["<div class='sidebar-left'>", "<div hidden>", '<div class="x comment-list">', "<section id=comments>",
           "<div role='navigation'>", "<div style='display: none'>", "<aside>", "<div class=ad>", "<form>",
           "<div class='related posts'><article>", "<ol class='comment-thread'><article class='comment-body'>"]


@pytest.mark.parametrize("attribute", HARMLESS)
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_harmless_names(element, attribute):
    page = f"<body><nav>x y</nav><{element} {attribute}><p>{PROSE}</p><p>{PROSE}</p></{element}><footer>f</footer>"
    assert html.main_text(page) == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("start", OUTSIDE)
def test_marked_elements_are_out(start):
    stop = "</article></div></section></aside></form></ol>"
    assert html.main_text(f"<body>{start}<p>{PROSE} NOT</p>{stop}<div><p>{PROSE}</p></div>") == PROSE
    page = f"<body class='widget'><div id=page class='nav'><article><p>{PROSE}</p></article></div>{start}<p>{PROSE} NOT</p>{stop}"
    assert html.main_text(page) == PROSE  # what holds the article is not outside, whatever it is called


@pytest.mark.parametrize("piece", ["<a \"'", "<a ", "<p title=it's>", "<!--", "<", "</x>", "<div></span>", "<b><i>", "<script>",
                                   "<div class=\"", "<p>", "<a href=x>", "&amp", "</script", "<a =\"x\"b", "<b></div>",
                                   "<div class=nav><article>", "<script/", "<a b=", "<p><b>"])
def test_time_grows_with_length(piece):
    def seconds(size):
        start = time.process_time()
        html.main_text("<div>" + piece * (size // len(piece)))
        return time.process_time() - start

    assert seconds(400_000) < 8 * max(seconds(100_000), 0.05)


def test_markup_as_browsers_read_it():
    def text(inner):
        return html.main_text(f"<article><p>{inner}</p></article>")

    assert text("<b title=it's>One</b> &lt; two < 3, a <i class='x>y'>very</i> &eacute;t&#233; <a href=\"a>b\">day</a>") == \
        "One < two < 3, a very été day"
    assert text("energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here") == "energy is E=m here"
    assert text("one<!-- two --> three<br>four<script>var x = '<p>five</p>';</script> six") == "one three four six"
    assert text("one <svg><text>two</text></svg><textarea>three</textarea>four") == "one four"
    assert html.main_text(f"<article><p>{PROSE}</p><p>tail <a href='") == f"{PROSE} tail"


def plain_labels(found):
    """The second pass in words: look left and right of every block by itself."""
    first = [html._first_pass(b) for b in found]
    if any(b.main and x == "good" and not b.heading and len(b.text) >= html.LENGTH_LOW for b, x in zip(found, first)):
        first = [x if b.main else "bad" for b, x in zip(found, first)]
    if "good" not in first:
        stand = {i for i, x in enumerate(first) if x == "near"} or {
            i for i, x in enumerate(first) if x == "short" and not found[i].heading
            and html._stop_share(found[i].text) >= html.STOP_HIGH}
        first = ["good" if i in stand else x for i, x in enumerate(first)]

    def look(i, step, decided):
        i += step
        while 0 <= i < len(first):
            if first[i] in decided:
                return first[i]
            i += step
        return "bad"

    out = []
    for i, label in enumerate(first):
        left, right = (look(i, step, ("good", "bad")) for step in (-1, 1))
        near = {step: look(i, step, ("good", "bad", "near")) for step in (-1, 1)}
        if label == "near":
            label = "good" if "good" in (left, right) else "bad"
        elif label == "short" and found[i].heading:
            label = "good" if near[1] != "bad" and right == "good" else "bad"
        elif label == "short" and left == right:
            label = left
        elif label == "short":
            label = "good" if near[-1 if left == "bad" else 1] == "near" else "bad"
        out.append(label)
    return out


def test_labels_equal_a_plain_second_pass():
    draw = random.Random(4)
    stop, rare = "the of and in to a is was".split(), "river stone cloud Zeppelin quartz".split()
    for _ in range(400):
        parts = []
        for _ in range(draw.randrange(1, 9)):
            share, size = draw.random(), draw.choice([3, 8, 20, 60])
            words = " ".join(draw.choice(stop) if draw.random() < share else draw.choice(rare) for _ in range(size))
            words = draw.choice([words, words, f"<a href=x>{words}</a>", f"{words} ©"])
            parts.append(draw.choice(["<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<nav>{}</nav>", "<main><p>{}</p></main>"])
                         .format(words) if draw.random() < 0.9 else f"<article>{words}</article>")
        page = "".join(parts)
        assert [b.label for b in html.classify(page)] == plain_labels(html.blocks(page)), page


def test_awkward_rows(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, page, "clash"), (1, page, "clash"), (None, None, None), (2, "", "x"), (3, "<p>" * 50_000, "x"),
            (4, f"<article>{'<p>' + PROSE * 300 + '</p>'}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract(pages)
    assert got.columns == pages.columns
    by_id = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 6 and by_id[1] == PROSE and by_id[None] == by_id[2] == by_id[3] == "" and by_id[4] == PROSE * 300
    empty = html.report(pages.limit(0).withColumn("url", F.lit("u")))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.collect() == []
