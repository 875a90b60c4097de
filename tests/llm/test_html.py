import html as markup
import random
import re

import pytest

from retrievo.llm import html_crf
from retrievo.llm.html_blocks import blocks, name_parts
from retrievo.llm.html_crf import extract_main, extract_text, features, fit, marked_labels, other_layout


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return fit(spark.read.parquet(f"{sf_dir}/pages.parquet"), limit=120)


def test_blocks():
    page = "<p>a &lt;b&gt;&amp; &copy;<p>c<br>d<b>e</b> f<!-- x <p> --><ul><li>1<li><a href='>'>two</a></ul>" \
           "<script>'<p>no</p>'</script><div CLASS='Site-header'>g</p>h</span></div></td><p>i &am"
    assert [(b.text, b.chain[-1][0]) for b in blocks(page)] == [
        ("a <b>& ©", "p"), ("c de f", "p"), ("1", "li"), ("two", "li"), ("gh", "div"), ("i &am", "p")]
    assert [b.text for b in blocks("<div>a<table><tr><td>b<td>c</table>d</div>e")] == ["a", "b", "c", "d", "e"]
    assert name_parts(' class="Site-header navBar" id=main2') == ("site", "header", "nav", "bar", "main")
    for odd in ("", " \n", "<", "<p", "<p class='", "a<b>c", "</div></div>x", "<!--", "<script>x", "&#xZ;&#1114112;", "<p>" * 3000 + "z"):
        blocks(odd)


def test_held_out_pages(spark, field):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = " ".join(markup.unescape(re.sub(r"<[^>]*>", " ", inner[1])).split())
        assert extract_text(r.html, field) == want
    rng, wrong, total = random.Random(5), 0, 0
    for r in rows:
        page = blocks(r.html)
        made, labels = other_layout(page, marked_labels(page), rng)
        found = field.decode(field.scores(features(made)))
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_decoding_is_the_best_chain(field):
    import itertools
    rng = random.Random(2)
    for _ in range(20):
        scores = [rng.uniform(-2, 2) for _ in range(7)]
        value = lambda ys: sum(s * y for s, y in zip(scores, ys)) + sum(field.change[a, b] for a, b in zip((0, *ys), ys))
        best = max(itertools.product((0, 1), repeat=7), key=value)
        assert field.decode(scores) == list(best)
        p, expected = field.marginals(scores)
        assert all(0 <= x <= 1 for x in p) and abs(expected.sum() - 7) < 1e-6


def test_rows(spark, field):
    rows = [(1, "u", None, "k"), (None, None, "", "k"), (2, "u", "<nav>menu</nav>", "k"), (2, "u", "<nav>menu</nav>", "k"),
            (3, "u", "<article><p>Whole text of an article.</p><div class=ad>Buy it.</div></article>" + " " * 100_000, "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main(frame, field)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect())
    assert got == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("3", "Whole text of an article.", 25), ("None", "", 0)]
    assert extract_main(frame.where("false"), field).count() == 0
    assert html_crf.fit(frame.where("false")).weight == {}
