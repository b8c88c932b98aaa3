import itertools
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from reelsight.llm import html_extraction as hx

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def models(spark):
    return hx.fit(spark.read.parquet(PAGES))


def by_template(html):
    """Main text of a given page, by the one template that all of them share."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^<>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())


def test_given_pages(spark, models):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
        html = {r.page_id: r.html for r in pages.collect()}
        got = hx.extract(pages, models=models).collect()
        assert len(got) == len(html)
        assert sum(r.text == by_template(html[r.page_id]) for r in got) >= 0.99 * len(got)
        assert all(r.n_chars == len(r.text) for r in got)


def test_layouts_never_seen(spark, models):
    """Precision and recall of words on layouts drawn from other pages."""
    found = wanted = both = exact = n = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 2300").collect():
        for made in hx.training_pages(r.html, f"held out {r.page_id}", 2):
            want = " ".join("".join((" " if gap else "") + t for _, t, gap in hx.Pages([made]).pieces
                                    if hx._MAIN in t).replace(hx._MAIN, "").split())
            got = hx.main_texts([made.replace(hx._MAIN, "").replace(hx._NOISE, "")], models)[0]
            a, b = Counter(got.split()), Counter(want.split())
            found, wanted, both = found + sum(a.values()), wanted + sum(b.values()), both + sum((a & b).values())
            exact, n = exact + (got == want), n + 1
    assert both > 0.98 * found and both > 0.98 * wanted and exact > 0.8 * n


P1 = "The first paragraph has a good number of plain words, so that it reads like prose. It ends here."
P2 = "A second one follows &amp; says <b>more</b> about the same thing, at some length, with a <a href=x>link</a> inside."
SAID = ("The first paragraph has a good number of plain words, so that it reads like prose. It ends here. "
        "A second one follows & says more about the same thing, at some length, with a link inside.")


@pytest.mark.parametrize("html", [
    f"<body><div id='top-nav'><a href=/>Home</a> <a href=/b>Blog</a></div><div class='post-content'><p>{P1}</p><p>{P2}</p></div>"
    f"<div class='comments-area'><h3>Comments</h3><div class=comment><p>{P1}</p></div></div><div id=footer>All rights reserved.</div>",
    f"<html><body><header><a href=/>Site</a></header><main><p>{P1}<p>{P2}</main><aside><h3>Related</h3><ul><li><a href=1>One</a>"
    f"<li><a href=2>Two</a></ul><p>{P1}</p></aside><footer>Imprint</footer></body></html>",
    f"<div class=wrapper><div class='cookie-banner'><p>We use cookies to make this site better for all of you.</p></div>"
    f"<article><p>{P1}</p><div class=advertisement><p>Buy now, and buy much more of it than you need!</p></div><p>{P2}</p>"
    f"</article><form action=/s><label>Search</label><input name=q></form></div>",
])
def test_other_layouts(models, html):
    assert hx.main_texts([html], models) == [SAID]


def test_odd_pages(spark, models):
    deep = "<div>" * 3000 + "<p>deep down</p>"
    rows = [(1, None), (2, ""), (3, "   "), (4, "<p></p><div> \n</div>"), (5, "<script>var a = '<p>no</p>';</script><style>p{}</style>"),
            (6, deep), (7, "</div></p></b></x>"), (8, "<p" * 50), (9, "<article><p>one &lt;two&gt;&nbsp; three\n\tfour<br>five" + " six" * 50_000),
            (10, "<!-- a <p>b</p> --><article><p>Some words stand here, <i>and</i><b>more</b> of them follow it.</p></article>"),
            (10, "<!-- a <p>b</p> --><article><p>Some words stand here, <i>and</i><b>more</b> of them follow it.</p></article>"),
            (None, "<article><p>No id, no address, but a text that is long enough to read.</p></article>"), (11, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    df = spark.createDataFrame([(i, None if i is None else "u", h, "x", 3) for i, h in rows],
                               "page_id long, url string, html string, text string, n_chars int")
    got = hx.extract(df, models=models)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {}
    for r in got.collect():
        assert r.n_chars == len(r.text) and r.text == " ".join(r.text.split())
        texts.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, texts.values())) == len(rows)
    assert all(texts[i] == [""] for i in (1, 2, 3, 4, 5, 7))
    assert texts[9][0].startswith("one <two> three four five six six") and texts[9][0].count("six") == 50_000
    assert texts[10] == ["Some words stand here, andmore of them follow it."] * 2
    assert texts[None] == ["No id, no address, but a text that is long enough to read."]


def test_tables_without_text(spark):
    for rows in ([], [(1, None), (2, "")]):
        df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
        assert sorted(map(tuple, hx.extract(df).collect())) == [(i, "u", "", 0) for i, _ in rows]


def test_decoding_finds_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        leaf = ~np.isin(np.arange(n), parent)
        main, noise = rng.uniform(0.01, 0.99, n), rng.uniform(0.01, 0.99, n)
        score = np.stack([np.log1p(-main) + np.log(noise), np.log(main) + np.log1p(-noise), np.log(main) + np.log(noise)], 1)
        best = max((c for c in itertools.product(range(3), repeat=n)
                    if all(c[k] != 2 for k in range(n) if leaf[k])
                    and all(c[parent[k]] in (2, c[k]) for k in range(1, n))),
                   key=lambda c: sum(score[k, c[k]] for k in range(n)))
        assert hx.decode(parent, leaf, main, noise).tolist() == [x == 1 for x in best]


def test_trees_score_as_the_fitted_model(spark):
    pages = spark.read.parquet(PAGES).limit(10)
    rows = pages.select(pages.page_id.cast("string"), "html").mapInArrow(hx._train, "x array<double>, main double, noise double")
    rows = rows.select(array_to_vector("x").alias("features"), "x", "main").cache()
    model = hx.boosting("main", 4).fit(rows)
    got = model.transform(rows).select("x", vector_to_array("probability")[1].alias("p")).collect()
    want = np.clip([r.p for r in got], hx.LEAST_CHANCE, 1 - hx.LEAST_CHANCE)
    assert np.allclose(hx.Boosted.of(model).chance(np.array([r.x for r in got])), want)


def test_features_by_hand():
    pages = hx.Pages(["<body><div class='side-bar menu'><a href=x>one</a> <a href=y>two</a></div><p>Some text.</p></body>", "", "<p>x"])
    assert pages.tags == ["#page", "div", "p", "#page", "#page", "p"]
    assert pages.parent.tolist() == [-1, 0, 0, -1, -1, 4] and pages.end.tolist() == [3, 2, 3, 4, 6, 6]
    assert pages.own[:, 0].tolist() == [0, 6, 9, 0, 0, 1] and pages.own[:, 3].tolist() == [0, 6, 0, 0, 0, 0]
    assert pages._below(pages.own)[:, 0].tolist() == [15, 6, 9, 0, 1, 1]
    assert hx.attribute_words("articlecomments")[2] == 1 or hx.attribute_words("articlecomments")[-1] == 1
