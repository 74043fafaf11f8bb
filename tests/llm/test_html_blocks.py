"""The tree's features, pages without any mark, broken and hostile markup, odd tables."""

import time

import pytest

from quillspark.llm import html_text


def test_tree_splits_on_neighbours():
    used = html_text.default_classifier().tree.used()
    assert {"words", "link_density"} <= used and {"words_before", "link_density_before", "words_after", "link_density_after"} & used


def test_unmarked_pages():
    word = lambda n: " ".join(["word"] * n)
    page = f"<body><div><a href=a>Home</a></div><div><a href=b>About us</a></div><h1>Big news today</h1><p>{word(60)}</p><div>A short line</div><p>{word(40)}</p><div><a href=c>Next page</a></div></body>"
    assert html_text.main_text(page) == f"Big news today\n{word(60)}\nA short line\n{word(40)}"


def test_names_are_learned_and_unknown_ones_say_nothing():
    assert html_text.main_text("<article><h1>A</h1><section class='reviews zq-x'><p>Great read</p></section><p>x <math>a+b</math> y</p><button>Go</button><noscript>plain</noscript></article>") == "A\nGreat read\nx a+b y\nGo\nplain"
    assert html_text.main_text('<main><p>One</p><div id="cookieBanner">We use cookies</div><div class="ad-slot">Buy now</div><form><p>Name</p></form><aside>Rel</aside><p>Two</p></main>') == "One\nTwo"
    assert html_text.main_text('<main><h1>T</h1><p>a</p></main><section id="comments"><article><p>a reader says this</p></article></section>') == "T\na"


@pytest.mark.parametrize("name", ["social-issues", "legal-news", "search-engine-history", "widget-maker", "related-work", "menu-of-the-day", "history-of-search", "cookieRecipes", "share_prices", "the-art-of-the-menu"])
def test_a_compound_says_no_more_than_its_head(name):
    body = "<h1>Title here</h1><p>Some words of a text that goes on</p><p>and on</p>"
    text = "Title here\nSome words of a text that goes on\nand on"
    assert html_text.main_text(f'<body><nav>Home</nav><article class="{name}">{body}</article></body>') == text
    assert html_text.main_text(f'<article><p>First of all</p><div class="{name}">{body}</div></article>') == f"First of all\n{text}"
    assert html_text.main_text(f'<div class="{name}"><article>{body}</article></div>') == text


@pytest.mark.parametrize("name", ["legal", "search", "social", "menu", "notice", "tags"])
def test_an_articles_own_name_does_not_count_against_it(name):
    assert html_text.main_text(f'<nav>Home</nav><article class="{name}"><p>Some words of a text</p></article>') == "Some words of a text"


@pytest.mark.parametrize("name", ["cookie-banner", "site-footer", "adSlot", "menu-list", "post-sidebar", "comment-box", "main-nav"])
def test_a_part_beside_the_text_is_known_by_its_head(name):
    assert html_text.main_text(f'<article><p>One</p><div class="{name}">Not of it</div><p>Two</p></article>') == "One\nTwo"
    assert html_text.main_text('<article><p>One</p></article><section><article class="comment"><p>says a reader</p></article></section>') == "One"


def test_neighbours_decide_where_nothing_is_marked():
    """Pages with names from outside the table, in which a short line is a heading before a long block and nothing at the end."""
    import random

    import numpy as np

    draw = random.Random(9)
    line = lambda sign, n: sign + " ".join(["word"] * n)
    pages = []
    for k in range(60):
        rows = []
        for _ in range(draw.randint(1, 4)):
            rows += [("+", draw.randint(2, 5)), *(("+", draw.randint(30, 150)) for _ in range(draw.randint(1, 2)))]
        rows += [("-", draw.randint(2, 5))]
        pages.append("<body>" + "".join(f'<div class="zq{draw.randrange(99)} kx-{k}">{line(*r)}</div>' for r in rows) + "</body>")
    table = html_text.training_pages()
    found = [f for f in map(html_text.blocks, table) if f]
    y = np.array([b.text[0] == "+" for f in found for b in f], np.float64)
    whole = html_text.default_classifier()

    def blind(x):
        return np.concatenate([x[:, :2], np.zeros((len(x), 4), np.float32), x[:, 6:]], axis=1)

    alone = html_text.Tree(blind(np.concatenate([html_text.features(f, whole.speech) for f in found])), y)
    right = {"whole": 0, "alone": 0}
    for page in pages:
        f = html_text.blocks(page)
        want, x = [b.text[0] == "+" for b in f], html_text.features(f, whole.speech)
        right["whole"] += (whole.tree.predict(x) >= 0.5).tolist() == want
        right["alone"] += (alone.predict(blind(x)) >= 0.5).tolist() == want
    assert right["whole"] >= 0.9 * len(pages) and right["alone"] <= 0.5 * len(pages), right


@pytest.mark.parametrize("part", ['<p a="', "<p", '<p a=">" ', "<p a='", "<div>x", "<svg>", "<textarea", "</div>", '<a href=">', '<div class="x">y', "<select>", "<article><div>", "</article>", "<!--", '<p a="x>', "<", "&"])
def test_time_goes_by_size(part):
    took = []
    for size in (250_000, 1_000_000):
        page = part * (size // len(part))
        began = time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_odd_tables(spark):
    long = "<article>" + "<p>word and word</p>" * 60_000 + "</article>"
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, None), (2, "u", "", "x"), (3, "u", long, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = html_text.extract(table).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in out) == [(-1, 0), (1, 1), (1, 1), (2, 0), (3, 14 * 60_000 - 1)]
    assert html_text.extract(table.limit(0)).collect() == [] and html_text.extract(table).columns == ["page_id", "url", "text", "n_chars"]
