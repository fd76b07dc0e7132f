"""Footers, comments and adverts with mixed names inside the main element; columns without a main element; the scan."""

from sieveline.llm import html_region as h

W = h.default_weights()
PARA = "<p>" + "a long paragraph of plain prose that goes on for a while. " * 3 + "</p>"
TEXT = " ".join(("a long paragraph of plain prose that goes on for a while. " * 3).split())


def test_a_footer_a_comment_and_an_advert_inside_main_are_left_out():
    for name in ("content-footer", "comment-entry", "ad-content", "article-comments", "post-sidebar", "main-nav", "story-related"):
        page = f'<main><h1>Headline</h1>{PARA}<div class="{name}">Not part of it at all</div>{PARA}</main>'
        assert h.extract(page, W) == f"Headline {TEXT} {TEXT}", name


def test_an_article_s_own_heading_stays():
    for name in ("entry-header", "article-header", "post-title", "entry-content", "story-body", "main-article"):
        assert h.extract(f'<article><div class="{name}"><h1>Headline</h1></div>{PARA}</article>', W) == f"Headline {TEXT}", name


def test_a_side_column_without_a_main_element():
    page = f'<body><div class="page"><div class="col">{PARA}{PARA}</div><div class=side><p>Some links and words beside it</p></div></div></body>'
    assert h.extract(page, W) == f"{TEXT} {TEXT}"


def test_fitted_weights_keep_it_so():
    pages = [f'<body><nav>menu words here</nav><article><h1>T{i}</h1>{PARA}</article><div class="ad">buy {i}</div><footer>foot {i}</footer></body>' for i in range(40)]
    fitted = h.weights_from([(p, h.label_by_markup(p)) for p in pages])
    page = f'<main><h1>Headline</h1>{PARA}<div class="content-footer">Foot</div><div class="comment-entry">Reader</div><div class="ad-content">Buy</div></main>'
    assert h.extract(page, fitted) == f"Headline {TEXT}"


def brute(found, scores, weights):
    """The texts of the best contiguous regions, all of them tried."""
    sums = {}
    for i in range(len(found)):
        total = 0.0
        for j in range(i, len(found)):
            total += (sum(weights.get("<" + t, h.TAG_COST) for t in found[j].tags) if j > i else 0.0) + found[j].words * max(scores[j], 0.0)
            sums[i, j + 1] = total
    best = max(sums.values(), default=0.0)
    return {" ".join(b.text for b, s in zip(found[a:b], scores[a:b]) if s > 0) for (a, b), total in sums.items() if total >= best - 1e-9}


def test_the_scan_finds_the_best_region():
    import random

    rng = random.Random(5)
    decided = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(2, 14)):
            kind = rng.choice(["p", "li", "td", "div class=ad", "div class=entry", "hr"])
            parts.append("<tr><td></td></tr>" * rng.randrange(9) + f"<{kind}>" + "word " * rng.randrange(1, 9) + f"</{kind.split()[0]}>")
        page = "<body>" + "".join(parts) + "</body>"
        found, mains = h.blocks(page, h._evidence(W), (0.0, 0.0))
        scores = [h._word_score(b, mains == 1, W) for b in found]
        text = h.extract(page, W)
        assert text in brute(found, scores, W)
        decided += text != " ".join(b.text for b, s in zip(found, scores) if s > 0)
    assert decided > 10  # without the scan the result would be another
