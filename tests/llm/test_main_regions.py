"""Main text of pages without article or main elements."""

import pytest

from larkspur.llm.mainhtml import main_text

LONG = "This sentence is long enough to stand out from all of the short lines around it, "


def items(tag, n):
    return "".join(f"<{tag}>{LONG * 2}number {k}.</{tag}>" for k in range(n))


LIST = f"<ul>{items('li', 6)}</ul>"
TABLE = "<table><tbody>" + "".join(f"<tr><td>{LONG * 2}row {k}.</td></tr>" for k in range(6)) + "</tbody></table>"
TERMS = "<dl>" + "".join(f"<dt>Term {k}</dt><dd>{LONG * 2}</dd>" for k in range(6)) + "</dl>"
FIGURE = f"<figure><div>{LONG * 9}</div><figcaption>{LONG}</figcaption></figure>"


@pytest.mark.parametrize("middle", [LIST, TABLE, TERMS, FIGURE])
@pytest.mark.parametrize("nav", ["", "<nav><a href=x>Home</a><a href=y>About</a></nav>"])
def test_text_around_a_list_table_or_figure_stays(middle, nav):
    page = f"<html><body>{nav}<div class='content'><h1>The title</h1><p>Intro: {LONG}</p>{middle}<p>Rest: {LONG}</p><p>End.</p></div></body></html>"
    lines = main_text(page).split("\n")
    assert lines[0] == "The title" and lines[1].startswith("Intro:") and lines[-2].startswith("Rest:") and lines[-1] == "End."
    assert "Home" not in lines


@pytest.mark.parametrize(("first", "second"), [(13, 7), (7, 13), (18, 2)])
@pytest.mark.parametrize("wrap", ["<html><body>{}</body></html>", "<html><body><div class='content'>{}</div></body></html>", "{}"])
def test_text_in_sibling_divs_stays(first, second, wrap):
    page = wrap.format(f"<div><h1>The title</h1>{items('p', first)}</div><div>{items('p', second)}<p>End.</p></div>")
    lines = main_text(page).split("\n")
    assert len(lines) == first + second + 2 and lines[0] == "The title" and lines[-1] == "End."


def test_the_innermost_element_with_all_content_is_taken():
    page = f"<html><body><div>Top bar</div><div class='content'><h1>The title</h1>{items('p', 3)}{LIST}</div><div>Links</div></body></html>"
    lines = main_text(page).split("\n")
    assert lines[0] == "The title" and len(lines) == 10 and "Top bar" not in lines and "Links" not in lines
