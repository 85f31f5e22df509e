"""Main text against a slow version that is written from the definition, and on pages out of the ordinary."""

import math
import random
import time

import pytest

from larkspur.llm import mainhtml
from larkspur.llm.mainhtml import extract_main, main_text

WORDS = "stone river cloud of the and light walks over hills in early spring".split()


def random_page(rng):
    """(html, lines): lines as (text, tags since the last, path of (element, number), what is said of it)."""
    html, lines, count, tags = [], [], [0], [0]

    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    def element(path, said, depth):
        kind = rng.choice(["div", "section", "div class=promo", "nav", "p", "p", "p", "h2"] if depth < 4 else ["p", "p class=promo"])
        name = kind.split()[0]
        said = max(said, 2 if name == "nav" else 1 if "promo" in kind else 0)
        count[0] += 1
        path = [*path, (name, count[0])]
        tags[0] += 1
        html.append(f"<{kind}>")
        if name in ("p", "h2"):
            words = text(rng.choice([1, 2, 4, 30, 60]) if name == "p" else 3)
            html.append(f"{words}</{name}>")
            lines.append((words, tags[0] + 1, path, said))
            tags[0] = 0
            return
        for _ in range(rng.randint(1, 4)):
            element(path, said, depth + 1)
        tags[0] += 1
        html.append(f"</{name}>")

    for _ in range(rng.randint(1, 5)):
        element([], 0, 0)
    return "".join(html), lines


def slow_main_text(lines):
    ratios = [0.0 if said == 2 else len(text) / max(1, tags) for text, tags, _, said in lines]
    soft = []
    for i in range(len(lines)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratios[j]) for j in range(max(0, i - 3), min(len(lines), i + 4))]
        soft.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    low, high = min(soft), max(soft)
    for _ in range(32):
        above = [x for x in soft if x > (low + high) / 2]
        below = [x for x in soft if x <= (low + high) / 2]
        if not above:
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    cut = min((low + high) / 2, 30)
    content = [s >= cut and r >= cut and said != 2 and (said != 1 or r >= 30) for s, r, (_, _, _, said) in zip(soft, ratios, lines, strict=True)]
    paths = [x[2] for x in lines]
    region = ()
    if any(content):
        holds = [tuple(p[:k]) for p in paths for k in range(len(p) + 1) if k == 0 or p[k - 1][0] in ("div", "section")]
        region = max((h for h in holds if all(tuple(p[: len(h)]) == h for p, ok in zip(paths, content, strict=True) if ok)), key=len)
        while len(region) > 1:
            added = [x for x in lines if tuple(x[2][: len(region) - 1]) == region[:-1] and tuple(x[2][: len(region)]) != region]
            if any(x[3] for x in added) or not any(x[2][-1][0] == "h2" for x in added):
                break
            region = region[:-1]
    return "\n".join(x[0] for x, ok in zip(lines, content, strict=True) if tuple(x[2][: len(region)]) == region and (ok or x[3] == 0))


def test_main_text_is_that_of_the_slow_version():
    rng = random.Random(3)
    for _ in range(800):
        html, lines = random_page(rng)
        assert main_text(html) == slow_main_text(lines), html


PAGE = (
    "<html><body><div class=ad>Buy it now, and buy it here.</div><div><h1>The title</h1><p>{0}</p><p>Short.</p><p>{0}</p></div>"
    "<div>Others have read this as well.</div></body></html>"
)


def test_the_clusters_decide(monkeypatch):
    page = PAGE.format("This is a long paragraph, as there are in texts, " * 4 + "and it ends.")
    text = main_text(page)
    assert text.startswith("The title\n") and "Short." in text and "Buy" not in text and "Others" not in text
    monkeypatch.setattr(mainhtml, "content_lines", lambda ratios, said, sigma: ratios >= 0)
    assert "Buy" in main_text(page) and "Others" in main_text(page)


@pytest.mark.parametrize("part", ["<section class='related-work'>{}</section>", "<div id='social-history'>{}</div>", "<p class='ad-hoc'>{}</p>", "<div class='content widget'>{}</div>"])
def test_names_do_not_remove_content(part):
    long = "Others have done the same before, and some of them have done it better than we ever did or will do. " * 3
    page = f"<article><p>{long}one.</p>{part.format('<p>' + long + 'two.</p>')}<p>{long}three.</p></article>"
    assert main_text(page).split() == (long + "one. " + long + "two. " + long + "three.").split()


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "text" + "</div>" * 20_000, "<b><p>x" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 2_000, "<div><h2>x</h2>" * 5_000 + "y" * 2_000, "</p>" * 50_000 + "x", "<li>" * 30_000 + "x"])
def test_deep_pages_take_linear_time(page):
    begun = time.perf_counter()
    assert main_text(page)
    assert time.perf_counter() - begun < 5


def test_long_repeated_rows_and_other_columns(spark):
    long = "<article>" + "<p>Many words that make a paragraph of some length here.</p>" * 40_000 + "</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "y"), (None, None, "<p>Text</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main(df).collect()
    assert sorted((r.page_id or 0, r.text.count("\n"), r.n_chars == len(r.text)) for r in got) == [(0, 0, True), (1, 39_999, True), (1, 39_999, True)]
    empty = extract_main(df.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and not empty.collect()
