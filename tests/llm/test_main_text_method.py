"""Main text through the scan: what it removes, marked elements of all pages, odd markup, linear time."""

import html
import re
import time

import pytest

from sightline.llm import maintext

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(PAGES).select("html").collect()]


@pytest.fixture(scope="module")
def learned(pages):
    return maintext.learn(pages[:150])


def marked_element(page):
    """Words of the marked element by plain regular expressions; None where the mark does not end."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    return inner and html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<!--.*?-->", "", inner[1], flags=re.DOTALL))).split()


def test_every_page_against_its_marked_element(pages, learned):
    compared = 0
    for page in pages:
        wanted = marked_element(page)
        if wanted is not None:
            compared += 1
            assert maintext.main_text(page, *learned).split() == wanted
    assert compared > len(pages) / 2


def test_pages_without_the_mark_give_the_same_text(pages, learned):
    for page in pages:
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert maintext.main_text(plain, *learned) == maintext.main_text(page, *learned)


def test_the_scan_removes_what_is_not_content(pages, learned):
    """Menus, adverts and footers are tokens of the sequence; the region leaves them out on most pages, with and without mark."""
    for text, weights in ((lambda p: p, learned[0]), (lambda p: re.sub(r"</?article>", "<div>", p), learned[1])):
        removed = 0
        for page in pages:
            tokens = maintext.runs(text(page))
            a, b = maintext.best_region(tokens, weights)
            removed += sum(t.words for t in tokens[a:b]) < sum(t.words for t in tokens)
        assert removed > len(pages) / 2


def test_learned_weights_are_of_both_signs(learned):
    for weights in learned:
        assert weights.content[(False, "nav>li", True)] < -0.4 and weights.content[(False, "footer>footer", False)] < -0.4
        assert max(weights.content.values()) > 0.4


LONG = "The body of the page goes on for some more words than that."


@pytest.mark.parametrize("page, text", [
    (f"<body><form><nav><a>Home</a></nav><article><p>{LONG}</p></article></form></body>", LONG),
    (f"<body><form><nav><a>Home</a></nav><div><p>{LONG}</p></div><footer>Foot</footer></form></body>", LONG),
    (f'<article><p>{LONG}</p></article><div class="reco">More stories you may like</div>', LONG),
    (f"<article><p>{LONG}</p></article><div>Between the two</div><article><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><div hidden>Not shown</div><p>End</p></article>", f"{LONG}\nEnd"),
    (f'<article><p>{LONG}</p><p style="color:red; display: none">Not shown</p><p aria-hidden="true">Nor this</p></article>', LONG),
    (f"<article><h1><a href=/x>A linked headline</a></h1><p>{LONG}</p></article>", f"A linked headline\n{LONG}"),
    (f"<div><h1><a href=/x>A linked headline</a></h1><p>{LONG}</p></div>", f"A linked headline\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a>One ref</a></li><li><a>Two</a></li></ul></article>", f"{LONG}\nOne ref\nTwo"),
    (f"<article><p title=it's>{LONG}</p><p>It's third</p></article>", f"{LONG}\nIt's third"),
    (f"<main><h1>Headline</h1><article><header><h2>Sub</h2><p>By me</p></header><p>{LONG}</p></article>"
     "<section id=comments><article>Nice</article></section></main>", f"Headline\nSub\n{LONG}"),
    (f"<body><div class='ad'>Unclosed advert<article><p>{LONG}</p></article></body>", LONG),
    (f"<article><p><b>{LONG}<div>Second</b> part</div></article>", f"{LONG}\nSecond part"),
    (f"<article><p>{LONG}</p><label>Name</label><select><option>One<option>Two</select><p>End", f"{LONG}\nEnd"),
])
def test_cases(learned, page, text):
    assert maintext.main_text(page, *learned) == text


@pytest.mark.parametrize("piece", ["<b>x ", "<div><p>x ", "<li>x ", "<article>x ", "<nav>x ", "<form>x</div> ", "<a b='x ", "<i>x</p> ", "<h1>x ", "</b "])
def test_long_and_deep_pages_take_linear_time(learned, piece):
    began = time.monotonic()
    maintext.main_text(piece * 100_000, *learned)
    assert time.monotonic() - began < 20
