"""Tag-path ratios decide; names in the markup only settle what is small."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodemark.llm import html

SF = "/root/testdata/sf0.01"
TEXT = "<p>First paragraph, with some words; it is long enough to count.</p><p>Second paragraph, and more text here: fine, good.</p>"
WANT = "First paragraph, with some words; it is long enough to count.\nSecond paragraph, and more text here: fine, good."
WRAPPERS = [
    '<div class="content has-sidebar">{}</div>',
    '<div id="page" class="site no-sidebar">{}</div>',
    '<div class="topic social-science">{}</div>',
    '<div class="js-menu-closed wrap"><article>{}</article></div>',
    '<article><div class="entry share">{}</div></article>',
    "<form action=/x>{}</form>",
    '<form><div class=menu><a href=/>All, the things, here.</a></div><div class=post>{}</div><div class="comment-list"><p>I read it, and I liked it, a lot.</p></div></form>',
    '<div style="visibility: hidden" id=js-wrapper>{}</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_stay(wrapper):
    assert html.main_text(f"<html><body><nav><a href=x>Home</a></nav>{wrapper.format(TEXT)}<footer>c 2020, all.</footer></body></html>") == WANT


def test_long_comments_of_readers_go():
    page = f'<html><body><div class=post>{TEXT}</div><section class="comments">{"<p>I like it, a lot, really: yes.</p>" * 6}</section></body></html>'
    assert html.main_text(page) == WANT


def test_two_parts_of_an_article_stay():
    part = lambda n: "<div>" + "<p>Some words, and more of them; they go on.</p>" * n + "</div>"
    assert html.main_text(f"<html><body><nav><a href=x>Home</a></nav><div>{part(9)}{part(5)}</div></body></html>").count("\n") == 13


def pages():
    return [r or "" for r in pq.read_table(f"{SF}/pages.parquet", columns=["html"])["html"].to_pylist()]


def bare(page):
    """The page with neither classes, ids, roles nor telling element names."""
    return re.sub(r"<(/?)(article|nav|footer|aside|main|header|section)\b[^>]*>", r"<\1div>", re.sub(r'\s(class|id|role)=("[^"]*"|[^\s">]+)', "", page))


def test_scores_find_articles_without_names(monkeypatch):
    have = pages()
    want = [html.main_text(p) for p in have]
    assert sum(html.main_text(bare(p)) == w for p, w in zip(have, want, strict=True)) >= 0.95 * len(have)
    r = random.Random(1)
    monkeypatch.setattr(html, "path_scores", lambda nodes: np.array([r.random() for _ in nodes]))
    assert sum(html.main_text(bare(p)) == w for p, w in zip(have, want, strict=True)) < 0.6 * len(have)


def test_scores_against_a_plain_version():
    """Ratios by path, each smoothed over the nodes with weights exp(-d^2 / 2) for d up to 2, multiplied."""
    r = random.Random(2)
    for n in (1, 2, 3, 50):
        nodes = [(r.randint(0, 4), "".join(r.choice("ab,. ;c") for _ in range(r.randint(1, 40)))) for _ in range(n)]
        of = {p: [t for q, t in nodes if q == p] for p, _ in nodes}
        length = [sum(map(len, of[p])) / len(of[p]) for p, _ in nodes]
        punct = [(1 + sum(c in ",.;" for t in of[p] for c in t)) / len(of[p]) for p, _ in nodes]

        def smooth(x):
            near = [[(math.exp(-((i - j) ** 2) / 2), v) for j, v in enumerate(x) if abs(i - j) <= 2] for i in range(len(x))]
            return [sum(w * v for w, v in s) / sum(w for w, _ in s) for s in near]

        assert np.allclose(html.path_scores(nodes), [a * b for a, b in zip(smooth(length), smooth(punct), strict=True)])
