import html as H
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.html_extraction import PRIOR, learned, main_text, minimum_cut, op7_html_extraction, with_main_text

LONG = "This is a sentence of the article that says something at some length, as sentences do. " * 3


def test_minimum_cut_against_all_labellings():
    random.seed(1)
    for _ in range(60):
        n = random.randrange(1, 8)
        a, b = ([random.randrange(12) for _ in range(n)] for _ in "ab")
        edges = [(i, j, random.randrange(8)) for i, j in itertools.combinations(range(n), 2) if random.random() < 0.5]
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        got = minimum_cut(a, b, edges)
        assert cost(got) == min(map(cost, itertools.product([False, True], repeat=n)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<article><h1>A &amp; B</h1><p>One<b>two</b> three<br>four&nbsp;five</article>", "A & B Onetwo three four five"),
        ("<body><header><p>Site name</p></header><main><p>Text &lt;here&gt;.</p></main><footer>c</footer>", "Text <here>."),
        ("<article><p>Body.</p><section class='comments'><p>I disagree with this strongly.</p></section></article>", "Body."),
        ("<article><p>Body.<div class='cookie-notice'>We use cookies.</div><p>More.</article><aside><p>Side.</aside>", "Body. More."),
        ("<article><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>Yes.</p><form><input value=x>Mail<button>Go</button></form></article>", "Yes."),
        ("<article><p>Cut off in the mid", "Cut off in the mid"),
        ("<article><h1>Title</h1><p>A <span class='ad'>Buy now!</span> b.</p></article>", "Title A b."),
        (f"<div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><p>{LONG}<p>Short.<p>{LONG}</div><div class=footer>x</div>", f"{LONG.strip()} Short. {LONG.strip()}"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article>x < y and a<b</article>", None),
    ],
)
def test_pages(page, text):
    assert text is None or main_text(page) == text


@pytest.mark.parametrize("page", ["<" * 5000, "<a b='" * 500, "<!--", "<p>" * 20_000, "</p>" * 1000, "<div>" * 3000 + "deep" + "</div>" * 10, "\x00<p>\ud7ff", "<article>" + "<p>w" * 3000])
def test_odd_pages_end(page):
    main_text(page)


@pytest.mark.parametrize("page", ["<a ", "<script a='", "<a b='", "<!-- ", "<p>w", "</b>", "<b>t<br>", "<td></td>", "<div><li>", "<a \">\"", "<![CDATA[", "&amp", "<title>", "<a href=x>y", "<p>A sentence, of some length, that ends here.<li>x"])
def test_a_megabyte_takes_a_few_seconds(page):
    started = time.process_time()
    main_text("<div>" * 5000 + page * (1_000_000 // len(page)))
    assert time.process_time() - started < 8


def test_many_stray_tags():
    started = time.process_time()
    main_text("<div>" * 10_000 + "</i>" * 10_000 + "<td>" * 10_000 + "<b>" * 20_000 + "x<br>" * 20_000)
    assert time.process_time() - started < 3


def plain_page(rng):
    """A page without article or main, its parts in divs of meaningless classes, and its blocks with whether they are content."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    menu = [words(rng.randrange(1, 3)) for _ in range(rng.randrange(4, 12))]
    paragraphs = [words(rng.randrange(25, 90)).capitalize() + ", " + words(12) + "." for _ in range(rng.randrange(3, 9))]
    foot = [words(3), words(2)]
    rows = "".join(f"<li><a href='/{k}'>{m}</a></li>" for k, m in enumerate(menu))
    html = f"<html><body><div class=x1><ul>{rows}</ul></div><div class=x2><h1>{words(5)}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class=x3>" + "".join(f"<a href=q>{f}</a> " for f in foot) + "</div></body></html>"
    return html, {m: False for m in menu} | {p: True for p in paragraphs}


def test_held_out_blocks_of_pages_without_an_article(spark, sf):
    weights = learned(spark.read.parquet(f"{sf}/pages.parquet"))
    assert np.abs(weights - np.array(list(PRIOR.values()))).max() > 0.5 and np.abs(weights).max() < 1000  # fitted, and finite
    rng, tp, fp, fn = random.Random(4), 0, 0, 0
    for _ in range(60):
        html, truth = plain_page(rng)
        text = main_text(html, weights)
        for block, content in truth.items():
            got = f" {block} " in f" {text} "
            tp, fp, fn = tp + (got and content), fp + (got and not content), fn + (content and not got)
    assert 2 * tp / (2 * tp + fp + fn) > 0.95


def test_whole_table(spark, sf):
    rows = op7_html_extraction(spark, sf.replace("0.001", "0.01")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(H.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", inner))).split()) and r["n_chars"] == len(r["text"])


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "u", "<article>é</article>", "x", "y")], "page_id long, url string, html string, _html string, text string")
    assert tuple(with_main_text(d, ["page_id", "_html", "text"]).first()) == (1, "x", "é")


def test_nulls_and_clashes(spark):
    d = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article>é</article>")], "page_id long, url string, html string").withColumn("_main_text", F.lit(1))
    assert sorted((r["text"], r["_main_text"]) for r in with_main_text(d, ["page_id", "url", "_main_text"]).collect()) == [("", 1), ("", 1), ("é", 1)]
    assert with_main_text(d.limit(0), ["page_id"]).count() == 0
