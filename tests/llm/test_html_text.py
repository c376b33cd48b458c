import random

import numpy as np
import pytest

from ripplework.llm.html_blocks import blocks_of
from ripplework.llm.html_model import Labeller, features, training_pages
from ripplework.llm.html_text import extract_text

WORDS = [f"{a}{b}" for a in ("re", "un", "for", "in") for b in ("ler", "tion", "ging", "sa", "ment")]


def test_blocks():
    page = '<!DOCTYPE html><head><title>t</title></head><body class="a b"><p>one &amp; <b>two<br>three</b>\n four<p>five<script>x="</p>"</script><!-- <p>no</p> --><ul><li>a<li>b</ul>tail < 3 &lt;p&gt; <a href="x>y">link</a></body'
    got = [(b.text, b.path[-1]) for b in blocks_of(page)]
    assert got == [("one & two three four", "p"), ("five", "p"), ("a", "li"), ("b", "li"), ("tail < 3 <p> link", ".b")]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> \n </p>") == []
    assert [b.text for b in blocks_of("plain")] == ["plain"]


def test_held_out_accuracy():
    xs, ys = training_pages(150, 12345, WORDS)
    shown = Labeller().probabilities(xs)
    right = np.concatenate([(p >= 0.5) == (y > 0) for p, y in zip(shown, ys, strict=True)])
    assert right.mean() > 0.99


def test_real_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r["page_id"]: "\n\n".join(b.text for b in blocks_of(r["html"]) if "article" in b.path) for r in pages}
    got = {r["page_id"]: r["text"] for r in extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, "u", None, 5), (None, None, "", 6), (1, "u", "<article><p>A &lt;b&gt; c." + " w" * 30000 + "</p></article>", 7)] * 2
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 6 and sorted(r["n_chars"] for r in got)[:4] == [0] * 4
    assert all(r["text"].startswith("A <b> c. w") for r in got if r["n_chars"])
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    model = Labeller.fresh(3)
    xs, ys = training_pages(6, 1, WORDS)
    assert random.Random(0) and rng is not None
    before = model.fit(xs, ys, epochs=1)[0]
    assert model.fit(xs, ys, epochs=30)[-1] < before / 3


def test_batching_changes_nothing():
    xs, _ = training_pages(20, 2, WORDS)
    model = Labeller()
    together, alone = model.probabilities(xs), [model.probabilities([x])[0] for x in xs]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, alone, strict=True))


def test_malformed_markup():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p>one<svg viewBox='0'/>two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>one<svg><svg>x</svg>y</svg>two") == ["one two"]
    assert texts("<p>one</p><button>press<p>two</p>") == ["one", "press", "two"]
    assert texts("<html><head><title>t</title><p>body text</p>") == ["body text"]
    assert texts("<p>one</p><script>if (a < b) '<p>no</p>'") == ["one"]
    assert texts('<p class="x>never closed</p><p>next</p>') == ["never closed", "next"]
    assert texts("a &<b>lt;</b> b &amp;lt; c") == ["a &lt; b &lt; c"]
    assert texts("<object><object>x</object>y</object><p>after</p>") == ["after"]


KINDS = {
    "aside": "<aside><p>see also this other story</p></aside>",
    "comments": "<div class='comments'><p>nice text, thanks for it</p><p>I don't agree at all</p></div>",
    "comment section": "<section id='comments'><p>first to say a word here</p></section>",
    "menu": "<nav><a href='/'>Home</a><a href='/b'>About</a></nav>",
    "form": "<form><label>Your name</label><input name='q'><p>send it to us</p></form>",
    "notice": "<div class='cookie-notice'>We use cookies here</div>",
    "advert": "<div class='ad'>Buy one and get one free</div>",
    "footer": "<footer><p>printed by the press of the town</p></footer>",
    "script": "<script>var x = '<p>no</p>';</script>",
}


@pytest.mark.parametrize("container", ["article", "main", "section", "div class='post'", "div class='qwzx'", "div"])
@pytest.mark.parametrize("kind", KINDS)
def test_parts_inside_the_article_go(container, kind):
    """Pages written by hand: the paragraphs of the article, whatever holds it, and nothing else."""
    model = Labeller()
    said = [f"This is paragraph {k} of the text, and it has a good number of words in it, so that it reads like one." for k in range(5)]
    inside = KINDS[kind]
    tag = container.split()[0]
    page = f"<html><head><title>t</title></head><body><header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><{container}>" + "".join(f"<p>{x}</p>" for x in said[:3]) + inside + "".join(f"<p>{x}</p>" for x in said[3:]) + f"</{tag}><footer>All rights are with the owner</footer></body></html>"
    blocks = blocks_of(page)
    odds = model.probabilities([features(blocks)])[0]
    assert [b.text for b, p in zip(blocks, odds, strict=True) if p >= 0.5] == said
