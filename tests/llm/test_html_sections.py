"""Main text that lies in several elements of an article."""

import numpy as np
import pytest

from ledgerloom.llm import htmltext


def prose(word, n):
    return ", ".join([f"{word} goes on"] * n) + "."


def test_chosen_blocks_outside_of_the_largest_element_stay():
    body, more = prose("Body", 60), prose("More", 20)
    got = htmltext.main_text(f"<html><body><article><div class='body'><p>{body}</p></div><div class='more'><p>{more}</p></div></article></body></html>")
    assert got == f"{body}\n\n{more}"


def test_all_sections_stay_beside_a_long_one():
    parts = [prose("First", 15), prose("Second", 80), prose("Third", 15)]
    got = htmltext.main_text("<html><body><article>" + "".join(f"<section><p>{x}</p></section>" for x in parts) + "</article></body></html>")
    assert got == "\n\n".join(parts)


def test_headline_outside_of_the_body_stays():
    head, body = "A headline, of some length, outside of the body", prose("Body", 60)
    got = htmltext.main_text(f"<html><body><article><h1>{head}</h1><div class='body'><p>{body}</p></div></article></body></html>")
    assert got == f"{head}\n\n{body}"


def plain_scores(page):
    """Ratios and scores of a page's blocks, by loops over its blocks."""
    n, paths = len(page.texts), page.paths
    mean = lambda values, p: sum(v for v, q in zip(values, paths, strict=True) if q == p) / paths.count(p)
    length = [len(t) for t in page.texts]
    marks = [sum(c in ".,;:!?¡¿、。，！？،؟।" for c in t) for t in page.texts]
    text, dots = [mean(length, p) for p in paths], [mean(marks, p) for p in paths]
    smooth = lambda x, i: sum(w * x[min(max(i + d, 0), n - 1)] for w, d in zip(htmltext.SMOOTH, (-2, -1, 0, 1, 2), strict=True))
    linked = [mean(page.links, p) / mean(length, p) for p in paths]
    ratios = [(text[i] * smooth(text, i) * (1 + dots[i]) * (1 + smooth(dots, i))) ** 0.5 * (1 - linked[i]) for i in range(n)]
    outside = [htmltext.OUTSIDE if any(page.within) and not w else 1 for w in page.within]
    return ratios, [mean([r * f * o for r, f, o in zip(ratios, page.priors, outside, strict=True)], p) for p in paths]


MIXED = (
    "<body><ul class='x1'><li><a href=1>One</a><li><a href=2>Two</a></ul><div><b>Site</b></div><article><h1>Head</h1>"
    f"<div class='t t2'><p>{prose('Body', 30)}<p>Short.<p>{prose('More', 9)}</div><ul><li><a href=3>See also</a></ul></article><div>Small print</div></body>"
)


def test_ratios_against_plain():
    page = htmltext.Page(MIXED)
    ratios, scores = plain_scores(page)
    assert page.ratios().tolist() == pytest.approx(ratios)
    assert page.scores().tolist() == pytest.approx(scores)


def test_ratios_decide(monkeypatch):
    want = f"Head\n\n{prose('Body', 30)}\n\nShort.\n\n{prose('More', 9)}"
    assert htmltext.main_text(MIXED) == want
    monkeypatch.setattr(htmltext.Page, "ratios", lambda page: np.full(len(page.texts), 100.0))
    without = htmltext.main_text(MIXED)
    assert without != want and "Small print" in without and "One" in without


def test_no_class_names_are_needed():
    page = f"<body><ul><li><a href=1>One, two</a><li><a href=2>Two</a></ul><div><p>{prose('Body', 30)}<p>{prose('More', 40)}</div><div>Small print</div></body>"
    assert htmltext.main_text(page) == f"{prose('Body', 30)}\n\n{prose('More', 40)}"


def test_article_in_a_marked_wrapper():
    assert htmltext.main_text(f"<div class='menu-and-more'><nav><a href=1>x</a></nav><article><p>{prose('Body', 9)}</article></div>") == prose("Body", 9)


def test_deep_pages():
    deep = "<div>" * 3000 + "<ul>" + "<li><span>item, that goes on.</span>" * 3000
    assert htmltext.main_text(deep) == "\n\n".join(["item, that goes on."] * 3000)


def test_page_without_main_text():
    assert htmltext.main_text("<body><nav><a href=1>Menu</a></nav><div class=ad>Buy, buy, and buy more of it.</div><footer>Foot</footer>") == ""
