"""Main text on layouts that hide or mimic it; widths of graph searches that measure their own recall."""

import numpy as np
import pytest

from quern.llm import hnsw, html_text

LONG = "<p>Sidebar text that goes on and on about other things, with many words in it.</p>" * 6
FIRST, SECOND = "First one is quite long for a paragraph.", "Second para that's fine and rather long too."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<p data=it's>{FIRST}</p><p>{SECOND}</p><p>Third one here.</p>", f"{FIRST}\n\n{SECOND}\n\nThird one here."),
        (f"<nav><a href=x>Home</a></nav><article><header><h1>The big title</h1></header><p>{FIRST}</p></article><footer>Imprint</footer>", f"The big title\n\n{FIRST}"),
        (f"<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as was shown long ago.</p><p>{FIRST}</p></article>", f"Energy is E=m, as was shown long ago.\n\n{FIRST}"),
        (f"<nav><a href=a>One</a></nav><article><h1>Short</h1><p>{FIRST}</p></article><div class='sidebar'>{LONG}</div><footer>x</footer>", f"Short\n\n{FIRST}"),
        (f'<p title="a > b" class=x>{FIRST}</p><p title = \'c > d\'>{SECOND}</p>', f"{FIRST}\n\n{SECOND}"),
    ],
)
def test_nothing_is_lost_or_kept_wrongly(page, text):
    assert html_text.main_text(f"<body>{page}</body>") == text


def test_cut_mends_more_than_it_breaks():
    import random

    r, w = random.Random(99), html_text.weights()
    alone = cut = 0
    for _ in range(150):
        found = html_text.blocks(html_text.example(r))
        want = [html_text.CONTENT_SIGN in b["text"] for b in found]
        for b in found:
            b["text"] = b["text"].replace(html_text.CONTENT_SIGN, "") or "x"
        alone += sum((x > 0) != y for x, y in zip(html_text.leanings(found, w), want))
        cut += sum(x != y for x, y in zip(html_text.label(found, w), want))
    assert cut < alone


def test_extraction_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, _main string")
    assert html_text.extract(none).count() == 0
    some = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>" + "a" * 100_000, "x")], none.schema)
    assert [r["_main"]["n_chars"] for r in html_text.extract(some).collect()] == [0, 0, 100_000]


def test_searches_widen_until_they_find_enough():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(6000, 96)), rng.normal(size=(100, 96))
    index = hnsw.Index(x)
    narrow = index.width
    index.widen(21)
    assert index.width > narrow
    best = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(np.intersect1d(a, b)) / 20 for a, b in zip(index.query(q, 20), best)]) >= 0.9
