"""Main texts of made-up pages whose article is known, and of the given pages by a plain cut."""

import html
import re

import numpy as np
import pyarrow.parquet as pq

from retailscope.llm import pages
from retailscope.llm.queries import QUERIES
from tests.conftest import SMALL

LONG = "This paragraph is long enough to be told from a menu, and it goes on for a while, as articles do. "


def cut(page):
    """The given pages are made from one pattern; this reads it without a parser."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)(?:\s[^>]*)?>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in parts)
    return "\n".join(x for x in lines if x)


def test_op4_on_the_table(spark):
    t = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    found = {r.page_id: r for r in QUERIES["op4_page_text"](spark, SMALL).collect()}
    assert len(found) == len(t)
    for row in t:
        r = found[row["page_id"]]
        assert (r.url, r.text, r.n_chars) == (row["url"], cut(row["html"]), len(cut(row["html"])))


def test_page_without_article_element():
    page = f"""<html><body class="nav-open"><div id="top-header"><h2>Site</h2></div><ul class=menu><li><a href=x>One</a><li><a href=y>Two</a></ul>
    <div class="cookie-notice">We use cookies. {LONG}</div>
    <div id=wrap><div class="content"><h1>Title &amp; more</h1><p>{LONG * 3}<p>{LONG * 2}<br>tail <b>bold</b><i>er</i>
    <p>Short.</p><form><p>{LONG}</p><input name=q></form><aside>{LONG}</aside><script>if (a < b) "{LONG}"</script><style>p {{}}</style>
    <blockquote>{LONG}</blockquote></div><div class="sidebar">{LONG}<a href=z>z</a></div></div>
    <div id="comments"><p>{LONG}</p></div><div style="display: none">{LONG}</div><footer><p>{LONG}</p></footer>"""
    long = LONG.strip()
    assert pages.main_text(page) == "\n".join(["Title & more", " ".join([long] * 3), " ".join([long] * 2) + " tail bolder", "Short.", long])


def test_header_inside_the_article_belongs_to_it():
    page = f"<header><p>{LONG}</header><main><article><header><h1>Head</h1></header><p>{LONG * 4}</p><footer>by me</footer></article></main>"
    assert pages.main_text(page) == f"Head\n{(LONG * 4).strip()}"


def test_link_lists_inside_the_region_go():
    page = f"<div><p>{LONG * 3}</p><p><a href=1>{LONG}</a></p><p>{LONG} <a href=2>link</a></p></div>"
    assert pages.main_text(page) == f"{(LONG * 3).strip()}\n{LONG.strip()} link"


def test_odd_pages(spark):
    texts = [None, "", " ", "<", "<!-- x", "plain text", "&amp;&nbsp;&#x41;&bogus;", "<p>" * 50_000 + "x", "<div>" * 50_000 + LONG + "</div>" * 50_000, "<nav>" + LONG, "</p></div>x", "<a>" + LONG + "</a>", "<p>" + "w " * 200_000, "<title>t</title><p>" + LONG, "<script>never closed " + LONG, "<p>a  \n b</p>"]
    want = ["", "", "", "<", "", "plain text", "& A&bogus;", "x", LONG.strip(), "", "x", "", ("w " * 200_000).strip(), LONG.strip(), "", "a b"]
    rows = [(i, f"u{i}", t, i) for i, t in enumerate(texts)] + [(None, None, "<p>no id", 0), (1, "u1", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = pages.extract(df).collect()
    assert len(found) == len(rows)
    assert [r.text for r in sorted(found[:-2], key=lambda r: r.page_id)] == want
    assert pages.extract(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert np.allclose(pages.smoothed(np.full(7, 3.0)), 3)
    assert 1.2 < pages.threshold(np.array([1, 1.1, 1.2, 5, 5.2])) <= 5
    assert pages.threshold(np.array([2.0, 2.0])) == 2


def test_no_part_of_the_article_goes():
    long = LONG.strip()
    nested = f"<body><nav><a href=x>{LONG}</a></nav><article><h1>Title</h1><p>Lead.</p><div class=body><p>{LONG * 8}</p></div><ul><li><a href=1>A reference</a><li>Item</ul></article><div><p>Elsewhere</p></div></body>"
    assert pages.main_text(nested) == "\n".join(["Title", "Lead.", " ".join([long] * 8), "A reference", "Item"])
    uneven = f"<body><div id=wrap><h1>Title</h1><section><p>{LONG * 9}</p></section><section><p>{LONG}</p></section></div></body>"
    assert pages.main_text(uneven) == "\n".join(["Title", " ".join([long] * 9), long])
    several = f"<main><article><p>{LONG * 9}</p></article><article><p>{LONG}</p></article></main>"
    assert pages.main_text(several) == "\n".join([" ".join([long] * 9), long])


def test_cues_of_wrappers():
    long = LONG.strip()
    for inner in ("article", "main", "div"):
        page = f'<body><div class="layout with-sidebar"><{inner}><p>{LONG * 3}</p><div class=share><p>{LONG}</p></div></{inner}><div class="sidebar"><p>{LONG}</p></div></div></body>'
        assert pages.main_text(page) == " ".join([long] * 3), inner
    comments = f"<body><article><p>{LONG}</p></article><div id=comments><article><p>{LONG * 3}</p></article></div></body>"
    assert pages.main_text(comments) == long
    assert pages.main_text(f"<body><div><p>{LONG}</p></div><div id=comments><p>{LONG * 3}</p></div></body>") == long
    assert pages.main_text(f"<div class=widget><main><p>{LONG}</p></main></div><div><p>{LONG}</p></div>").startswith(long)


def menu(name, *lines):
    return f"<div class={name}>{''.join(f'<p>{x}' for x in lines)}</div>"


TOP = menu("x1", "Home", "Products", "About us", "Contact")
END = menu("x2", "Copyright 2024", "Terms", "Privacy", "Imprint")


def test_clusters_decide_without_any_cue():
    """No element and no class says what the text is: runs of short lines around the dense ones go."""
    body = [(LONG * k).strip() for k in (3, 4, 2, 3, 5, 2)]
    page = f"<html><body>{TOP}{''.join(f'<p>{x}' for x in body)}{END}</body></html>"
    assert pages.main_text(page) == "\n".join(body)
    lists = "<ul><li>first<li>second<li>third</ul>"
    page = f"<html><body>{TOP}<div class=x3><h1>Title</h1><p>{body[0]}<p>{body[1]}{lists}<p>{body[2]}<p>{body[3]}<p>The end.</div>{END}"
    assert pages.main_text(page) == "\n".join(["Title", *body[:2], "first", "second", "third", *body[2:4], "The end."])


def test_smoothing_matters(monkeypatch):
    """A lone dense line among short ones isn't content; without smoothing it would be, and the run before it too."""
    body = [(LONG * k).strip() for k in (3, 4, 2, 3, 5, 4)]
    legal = menu("x2", "Copyright 2024", "Terms", "Privacy", LONG, "Imprint", "Jobs", "Press")
    page = f"<html><body>{TOP}<h1>Title</h1>{''.join(f'<p>{x}' for x in body)}{legal}</body></html>"
    want = "\n".join(["Title", *body])
    assert pages.main_text(page) == want
    monkeypatch.setattr(pages, "smoothed", lambda values, sigma=1.0: values)
    assert pages.main_text(page) != want
