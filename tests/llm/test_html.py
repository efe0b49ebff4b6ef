"""Main text of pages with wrappers, boilerplate within the article, odd markup and none of the usual names; and what the cut decides."""

import duckdb
import numpy as np
import pytest

from weftline.llm import html_extract as he

PROSE = [
    "The river rose again in the year 1950, and the people of the town moved their boats to higher ground.",
    "When the water fell in spring, they found the old bridge gone and the mill full of sand and stones.",
    "Nobody could say how long the repairs would take, but the council met each week until the work was done.",
    "In the end the new bridge stood where the old one had been, and the mill was turned into a school.",
]
OTHER = ["I remember that flood well, my grandmother told me about the night when the mill was lost.", "Thank you for this piece. I would like to know more about the council and its weekly meetings."]
BODY, TALK = ("".join(f"<p>{x}</p>" for x in lines) for lines in (PROSE, OTHER))
LINKS = "".join(f"<li><a href=x>Go {k}</a></li>" for k in range(6))


@pytest.fixture(scope="module")
def pages():
    return [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


@pytest.fixture(scope="module")
def weights(pages):
    known = [b for p in pages for b in he.blocks(p)[:50] if b.said and not b.hidden]
    return he.fit_shape(np.array([he.shape(b) for b in known]), np.array([float(b.said > 0) for b in known]))


def test_pages_are_their_articles(pages, weights):
    for p in pages:
        inner = p[p.index("<article>") : p.index("</article>")]
        want = [b.text for b in he.blocks(inner)]
        assert he.main_blocks(p, weights) == want


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{BODY}</article><div id='comments'><h3>Comments</h3>{TALK}</div>",
        f"<article>{BODY}<section class='comments'>{TALK}</section></article>",
        f"<article>{BODY}</article><section class=comment-list><article>{TALK}</article></section>",
        f"<main><article>{BODY}</article><aside><h3>About us</h3>{TALK}</aside></main>",
        f"<div class='cookie-notice'><p>{OTHER[0]}</p></div><article>{BODY}</article>",
        f"<div class=sidebar><h3>Latest</h3><p>{OTHER[0]}</p></div><div class=content>{BODY}</div>",
        f"<article>{BODY}</article><footer>{TALK}<p>&copy; 2020</p></footer>",
        f"<article>{BODY}</article><form><label>Name</label><input><p>{OTHER[1]}</p><button>Send</button></form>",
        f"<header><p>The River News</p></header><article>{BODY}</article>",
        f"<article>{BODY}</article><div class=related-posts><h3>Related</h3><article><h2><a href=x>Boats</a></h2><p>{OTHER[0]}</p></article></div>",
        f"<ol class=breadcrumb><li><a href=x>Home</a></li><li>News</li></ol><article>{BODY}</article>",
        f"<article>{BODY}<p class='ad'>{OTHER[0]}</p></article>",
        f"<article>{BODY}<ul>{LINKS}</ul></article>",
        f"<article>{BODY}</article><div hidden>{TALK}</div><div style='display: none'>{TALK}</div>",
        f"<div><div><a href=a>Home</a> | <a href=b>News</a></div><div>{BODY}</div><div><a href=x>Privacy</a> &copy; 2020</div></div>",
        f"<div class='has-sidebar no-comments with-banner'><div class=post>{BODY}</div></div>",
        f"<div class=banner><article>{BODY}</article></div>",
        f"<form action=x.aspx><div>{BODY}</div></form>",
        f"<div class=content-sidebar><article>{BODY}</article></div>",
        f"<!-- <p>{OTHER[0]}</p> --><script>var a='<p>x</p>'</script><style>p{{}}</style><article>{BODY}</article>",
    ],
)
def test_boilerplate_goes_and_wrappers_stay(page, weights):
    assert he.main_blocks(f"<html><body>{page}</body></html>", weights) == PROSE


@pytest.mark.parametrize(
    ("middle", "text"),
    [
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<h2 id="related">Related floods</h2>', "Related floods"),
        (f'<p class="side-note">{OTHER[0]}</p>', OTHER[0]),
        (f'<section id="search"><p>{OTHER[0]}</p></section>', OTHER[0]),
        ("<p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "We know that x=2 holds."),
        (f"<p title=it's>{OTHER[0]}</p>", OTHER[0]),
        (f'<p title=it"s data-x="a>b">{OTHER[0]}</p>', OTHER[0]),
        ("<p>Yes.</p>", "Yes."),
        ("<figure><img src=x><figcaption>The old bridge.</figcaption></figure>", "The old bridge."),
        ("<header><p>By A. Writer</p></header>", "By A. Writer"),
        ('<p>A <span class="comment">word</span>&nbsp;&amp; more</p>', "A word & more"),
    ],
)
def test_text_within_the_article_stays(middle, text, weights):
    page = f"<body><nav><a href=x>Home</a></nav><article>{BODY}{middle}<p>{OTHER[1]}</p></article><footer>c</footer>"
    assert he.main_blocks(page, weights) == [*PROSE, text, OTHER[1]]


def changes(page, weights):
    """Blocks that the cut labels otherwise than their own cost, with the cut's label."""
    found = he.blocks(page)
    score, edges = he.costs(found, weights)
    return {b.text: k for b, k, v in zip(found, he.min_cut(score, edges), score, strict=True) if k != (v >= 0)}


def test_the_cut_changes_labels_both_ways(weights):
    kept = changes("<body><div>" + "".join(f"<p>{x}</p>" for x in PROSE[:2]) + "tab | bar" + "".join(f"<p>{x}</p>" for x in PROSE[2:]) + "</div>", weights)
    assert kept == {"tab | bar": True}
    links = "".join(f"<td><a href=x>Go to {k}</a></td>" for k in range(4))
    dropped = changes(f"<body><article>{BODY}</article><table><tr>{links}<td>{' '.join(OTHER)}</td>{links}</tr></table>", weights)
    assert dropped == {" ".join(OTHER): False}


def test_missing_class_and_empty_pages():
    x = np.array([he.shape(b) for b in he.blocks("<p>one two</p><p>three</p>")])
    assert he.fit_shape(x, np.ones(2)).tolist() == list(he.PRIOR.values()) and he.fit_shape(x[:0], np.ones(0)).tolist() == list(he.PRIOR.values())
    assert he.main_blocks(None, he.fit_shape(x[:0], np.ones(0))) == [] == he.main_blocks("<div></div>", np.array(list(he.PRIOR.values())))
    deep = "<div>" * 3000 + f"<article>{BODY}</article>" + "</div>" * 3000
    assert he.main_blocks(deep, np.array(list(he.PRIOR.values()))) == PROSE


def test_query_and_count_of_changes(spark):
    from weftline.llm.html_extract import op10_html_extraction

    rows = op10_html_extraction(spark, "/root/testdata/sf0.001").collect()
    html = {r[0]: r[1] for r in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()}
    for r in rows:
        p = html[r["page_id"]]
        want = "\n\n".join(b.text for b in he.blocks(p[p.index("<article>") : p.index("</article>")]))
        assert r["text"] == want and r["n_chars"] == len(want)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = he.cut_changes(pages, he.fit(pages)).first()
    assert got["blocks"] > 500 and got["changed"] >= 0
