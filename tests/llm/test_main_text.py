"""Extraction on hand-written pages, none of which the layouts of the training pages make, and through Spark."""

import pytest

from quarry.llm import html_main as H

P1 = "The committee met on Tuesday to discuss the plan, which had been delayed twice since the spring."
P2 = "Several members asked for more time; others said that the costs would only grow if nothing was done."
P3 = "A vote is expected next week."

PAGES = {
    "article first, no heading": (f"<html><body><article><p>{P1}</p><p>{P2}</p></article><footer>&copy; 2020 Press</footer></body></html>", [P1, P2]),
    "one sentence": (f"<html><body><article><p>{P3}</p></article></body></html>", [P3]),
    "unlisted class": (f"<html><body><h1>The plan</h1><div class='css-2b'><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></body></html>", ["The plan", P1, P2, P3]),
    "no class between nav and footer": (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div><div><p>{P1}</p><p>{P2}</p></div></div>"
                                        "<footer><p>&copy; The Press. All rights reserved.</p></footer>", [P1, P2]),
    "bare paragraphs": (f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>", [P1, P2, P3]),
    "a paragraph that is a link": (f"<article><h1>Plan</h1><p>{P1}</p><p><a href='/z'>{P2}</a></p><p>{P3}</p></article>", ["Plan", P1, P2, P3]),
    "menu, sidebar, comments": (f"<div id='top-menu'><a href=1>Home</a> <a href=2>Sport</a></div><main><h1>Plan</h1><p>{P1}</p><aside><h3>Related</h3><ul><li><a href=3>Older plan</a>"
                                f"</li></ul></aside><p>{P2}</p></main><section class='comments'><h3>Comments</h3><div class='comment'><p>I think this is a fine plan, thank you.</p></div></section>",
                                ["Plan", P1, P2]),
    "cookie notice and form": (f"<div class='cookie-banner'>We use cookies to make this site better. <button>OK</button></div><article><p>{P1}</p><p>{P2}</p></article>"
                               "<form id='newsletter'><label>Your address</label><input><button>Send</button></form>", [P1, P2]),
    "list and quotation": (f"<article><h2>Points</h2><ul><li>{P3}</li><li>Costs grow</li></ul><blockquote>{P2}</blockquote></article>", ["Points", P3, "Costs grow", P2]),
    "advert inside": (f"<article><p>{P1}</p><div class='advert'>Buy two and get a third one free today.</div><p>{P2}</p></article>", [P1, P2]),
    "script and style": (f"<style>p {{}}</style><article><script>var x = '<p>no</p>';</script><p>{P1}</p></article><script>1</script>", [P1]),
    "formula": ("<article><p>We know that <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds for all of these cases here.</p></article>",
                ["We know that a=2 holds for all of these cases here."]),
    "open head": (f"<head><title>t</title><article><p>{P1}</p></article>", [P1]),
    "plain text only": (P1, [P1]),
}


@pytest.fixture(scope="module")
def model():
    return H.default_field()


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(model, name):
    page, want = PAGES[name]
    assert H.extract(page, model) == "\n".join(want)


SCHEMA = "page_id long, url string, html string, text string, n_chars long, label int"


def test_pages_through_spark(spark, model):
    pages = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES.values())]
    long = "<article>" + "".join(f"<p>{P1} {i}.</p>" for i in range(4000)) + "</article>"
    rows = pages + [(0, "u0", pages[0][2]), (None, None, None), (100, None, ""), (101, "x", long), (102, "y", "<nav><a href=1>Home</a></nav>"), (103, "z", "<<p>&#x41;&amp;amp;")]
    got = H.main_text(spark.createDataFrame([(*r, "t", 3, 1) for r in rows], SCHEMA), model).collect()
    assert len(got) == len(rows)
    found = {r.page_id: r.text for r in got}
    for i, (_, want) in enumerate(PAGES.values()):
        assert found[i] == "\n".join(want)
    assert sum(r.page_id == 0 for r in got) == 2 and found[None] == found[100] == "" and found[102] == ""
    assert found[101].count("\n") == 3999 and all(r.n_chars == len(r.text) for r in got)
    assert H.main_text(spark.createDataFrame([], SCHEMA), model).count() == 0
