"""Pages without an element made for the article; license scans of long texts."""

import itertools
import math
import random
import time

import pytest

from offerlens.llm import html_text, licenses

TEXT = " ".join(["The quick brown fox has run over the lazy dog in the yard again today."] * 6)
NAV = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>'


def main_text(html):
    return html_text.extract(html, html_text.default_model(), plain=html_text.plain_model())


@pytest.mark.parametrize(
    "body",
    [f"<p>{TEXT}</p>", f"<div>{TEXT}</div>", f"{NAV}<div>{TEXT}</div><footer>(c) someone</footer>", f"<table><tr><td>{NAV}</td><td>{TEXT}</td></tr></table>", f"<main>{TEXT}</main>", f"<div id=wrap><article>{TEXT}</article></div>"],
)
def test_text_without_an_article_element(body):
    assert main_text(f"<html><body>{body}</body></html>") == TEXT


def test_pages_without_an_article_stay_empty():
    assert main_text(f"<p>{TEXT}</p>") == TEXT
    assert main_text(f"<body>{NAV}<div class='cookie-notice'><p>{TEXT}</p></div><footer>{TEXT}</footer></body>") == ""
    assert main_text(f"<body>{NAV}<div class='ad'>{TEXT}</div><div class='comments'><div class=comment><p>{TEXT}</p></div></div></body>") == ""
    assert main_text("") == main_text(None) == main_text("<html><body></body></html>") == ""


def test_the_plain_model_is_used_only_where_nothing_is_found():
    html = f"<body><article><h1>A title</h1><p>{TEXT}</p></article><div>{TEXT}</div></body>"
    assert main_text(html) == html_text.extract(html, html_text.default_model())


def test_each_pair_is_in_one_chain_and_the_best_is_first():
    def worth(at, chain):
        return len(chain) - sum(math.log2(1 + max(0, at[y][0] - at[x][0] - (at[y][1] - at[x][1]))) for x, y in itertools.pairwise(chain))

    rng = random.Random(4)
    for _ in range(60):
        at = [(i, rng.randrange(6)) for i in sorted(rng.sample(range(14), 9))]
        found = list(licenses.chains(at))
        assert sorted(x for c in found for x in c) == list(range(len(at)))
        assert all(at[x] < at[y] and at[x][1] < at[y][1] for c in found for x, y in itertools.pairwise(c))
        rising = [c for n in range(1, 7) for c in itertools.combinations(range(len(at)), n) if all(at[x][1] < at[y][1] for x, y in itertools.pairwise(c))]
        best = max(worth(at, c) for c in rising)
        assert worth(at, found[0]) >= best - 1  # one chain is kept a place of the template
    assert list(licenses.chains([])) == []


def test_time_is_in_proportion_to_the_text():
    words = "0 x y 4 x y by x y under x y".split()
    scan = licenses.Scanner()

    def took(n):
        begun = time.perf_counter()
        scan.find(" ".join((words * (n // len(words) + 1))[:n]) + " licensed cc")
        return time.perf_counter() - begun

    took(1000)
    assert took(64_000) < 24 * max(took(8_000), 0.02)


def test_every_copy_in_a_long_text_is_found():
    rng = random.Random(6)
    name, texts = next((n, t) for n, t in licenses.TEMPLATES.items() if max(len(licenses.words_of(x)) for x in t) > 40)
    template = max(texts, key=len)
    n = len(licenses.words_of(template))
    words, starts = [], []
    for k in range(30):
        words += [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((0, 3, 400)))]
        starts.append(len(words))
        words += licenses.words_of(template)
    found = sorted((m.first, m.behind) for m in licenses.Scanner().find(" ".join(words)) if m.name == name and m.n_words == n)
    assert found == [(s, s + n) for s in starts]
