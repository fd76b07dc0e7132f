"""Operator 6: pages without an article element, broken markup of any length, hidden text, class names."""

import time

import pytest
from sieveline.llm import html_region

STORY = "plain words of a story that goes on. " * 8
WANT = " ".join(STORY.split())


@pytest.fixture(scope="module", params=["priors", "learned"])
def weights(request, spark, sf):
    if request.param == "priors":
        return html_region.default_weights()
    return html_region.weights_from(html_region.labelled_sample(spark.read.parquet(f"{sf}/pages.parquet"), "page_id"))


PAGES = {
    "div": (f"<body><ul class=menu><li><a href=x>Home page</a><li><a href=y>News of the day</a></ul><div id=content><p>{STORY}<p>{STORY}</div><div class='sidebar widget'><p>{STORY}</p></div></body>", f"{WANT} {WANT}"),
    "bare div": (f"<div class=nav><a href=1>one</a> <a href=2>two</a></div><div>{STORY}<br>{STORY}</div><div id=footer>Copyright somebody</div>", f"{WANT} {WANT}"),
    "table layout": (f"<table><tr><td><a href=1>one</a><br><a href=2>two</a></td><td>{STORY}</td></tr></table>", WANT),
    "share price": (f"<article><div class='share-price search'><p>{STORY}</p></div><p>{STORY}</p></article>", f"{WANT} {WANT}"),
    "hidden inline": (f"<article><p>{STORY}<span style='display:none'>SECRET <span>MORE</span> <b>TEXT</b></span>end</p><p hidden>no</p></article>", f"{WANT} end"),
    "hidden block": (f"<article><div style='display: none'><p>no</p><div>no</div></div><p>{STORY}</p></article>", WANT),
    "inner boilerplate": (f"<article><h1>T</h1><p>{STORY}</p><div class=ad>buy this now</div><aside><p>{STORY}</p></aside><form>mail <input></form><p>The end.</p><section class=comments><p>{STORY}</p></section></article>", f"T {WANT} The end."),
    "own header": (f"<header>Site</header><main><header><h1>Title</h1></header><p>{STORY}</p></main><footer>f</footer>", f"Title {WANT}"),
    "outside text": (f"<div>loose words that stand before it and mean nothing at all</div><article><p>{STORY}</p></article><div>more of them</div>", WANT),
    "cookie notice": (f"<div class='cookie-notice'>{STORY}</div><div class=post><h2>Head line</h2><p>{STORY}</p></div><div class='comment-list'><p>{STORY}</p></div>", f"Head line {WANT}"),
    "unclosed": (f"<div class=ad>unclosed<article><p>{STORY}", WANT),
    "quotes": (f"<article><p title='a > b' alt=\"c > d\">{STORY}</p><p class=x' >{STORY}</p></article>", f"{WANT} {WANT}"),
    "mixed names": (f"<article><p>{STORY}</p><div class='comment-list'><p>{STORY}</p></div><div class='related-articles'><ul><li>other</li></ul></div><div class='social share-buttons'>Share it</div></article>", WANT),
    "linked heading": (f"<article><h1><a href=x>A linked title</a></h1><p>{STORY}</p></article>", f"A linked title {WANT}"),
    "references": ("<article><p>a&nbsp;&lt;b&gt; &eacute; &#233;&#x4e2d; 1 < 2</p></article>", "a <b> é é中 1 < 2"),
    "raw text": (f"<article><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><textarea>no</textarea><p>{STORY}</p></article>", WANT),
    "none": ("<nav>only a menu</nav>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(weights, name):
    page, want = PAGES[name]
    assert html_region.extract(page, weights) == want


BROKEN = {
    "open tags": lambda n: "<b " * n, "quotes": lambda n: '<a title="x' * n, "mixed quotes": lambda n: "<a x='1\" y=\"2' " * n + ">", "stray ends": lambda n: "<div>" * n + "</q1>" * n,
    "deep": lambda n: "<div class=a>" * n + "x" + "</div>" * n, "articles": lambda n: "<article>x" * n, "comments": lambda n: "<!-- " * n, "data": lambda n: "<![CDATA[" * n,
    "less than": lambda n: "< " * n, "bang": lambda n: "<!" * n, "scripts": lambda n: "<script>" * n, "hidden spans": lambda n: "<span hidden>" * n + "x" + "</span>" * n, "bodies": lambda n: "<div><body>x" * n,
    "paragraphs": lambda n: "<p>word" * n, "entities": lambda n: "&amp" * n, "equals": lambda n: "<a " + "= " * n, "names": lambda n: "<p class=a-b>x" * n, "ends": lambda n: "</" * n, "hrs": lambda n: "<br>" * n,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_a_megabyte_of_broken_markup_takes_little_time(weights, name):
    page = BROKEN[name](1)
    page = BROKEN[name](1_000_000 // max(3, len(page)))
    began = time.perf_counter()
    html_region.extract(page + "<article><p>the end of it</p></article>", weights)
    assert time.perf_counter() - began < 6  # some 0.1 to 1.5 s; a quadratic scan takes minutes


def test_labels_outweigh_priors():
    """A class name that priors speak against, but under which labelled pages keep their text."""
    page = "<div class=sidebar><p>" + STORY + "</p></div><div class=story2>" + "<p>unwanted words here</p>" * 5 + "</div>"
    learned = html_region.weights_from([(page, WANT)] * 60)
    assert html_region.extract(page, html_region.default_weights()) != WANT
    assert html_region.extract(page, learned) == WANT
