import random
import re
from html import unescape

import pytest

from readloom.llm import html_text
from readloom.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labeller():
    return html_text.train()


def plain_article(html):
    """The article's text by string cutting alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_match_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF1}/pages.parquet").collect()}
    got = QUERIES["op7_html_lstm"](spark, SF1).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_unseen_synthetic_pages(labeller):
    rng, right, total = random.Random(4242), 0, 0
    for _ in range(200):
        html, labels = html_text.synthetic_page(rng)
        page = html_text.blocks(html)
        assert len(page) == len(labels)
        right += sum(a == b for a, b in zip(labeller.label([page])[0] if page else [], labels, strict=True))
        total += len(labels)
    assert right > 0.98 * total


def test_blocks_of_odd_markup():
    text = lambda h: [b.text for b in html_text.blocks(h)]
    assert text("") == [] and text("<p") == [] and text("plain") == ["plain"]
    assert text("<p>a <b>b</b>c<br>d &amp;lt; &eacute;\n\t x<p>e<!-- <p>f</p> -->g") == ["a bc", "d &lt; é x", "eg"]
    assert text("<script>var t='</p>';</script><P CLASS=x>Hi</P><style>q{}</style><title>no</title>") == ["Hi"]
    assert text("<div title='a>b'>in</div><a href=x>y</a> z") == ["in", "y z"]
    assert html_text.blocks("<ul><li>a<li>b</ul><p>c")[2].path == ("p",)
    assert text("<html><head><title>t</title><article><p>One.</p></article>") == ["One."]
    assert text("<head><meta charset=x><p>Two.") == ["Two."] and text("<script src=https://x.com/>code</script><p>a") == ["a"]
    assert text("<script/>code</script><style/>p{}</style><p>b</p>") == ["b"] and text("<p>a<script>x</script>b") == ["ab"]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.<svg><title>no</title><text>yes</text></svg></p>") == ["Let x=1 be.yes"]
    assert text("<noscript><p>seen</p></noscript><xmp><b>&amp;</b></xmp><template><p>no</p></template>") == ["seen", "<b>&amp;</b>"]
    assert text("a<!-->b<!--->c<!-- d --!>e") == ["abce"] and text("<svg/><p>after</p><svg><path d=x /></svg>") == ["after"]


def test_odd_rows(spark, labeller):
    many = "<article>" + "<p>One more line of the long text.</p>" * 6000 + "</article>"
    rows = [(1, "u", None, 1), (1, "u", "", 2), (None, None, "<article><p>The whole text of it.</p></article>", 3), (2, "u", many, 4), (2, "u", many, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df, labeller).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 5
    assert all(r.n_blocks == 6000 for r in got if r.page_id == 2)
    assert [r.n_chars for r in got if r.page_id == 2] == [6000 * len("One more line of the long text.\n") - 1] * 2
    assert html_text.extract(df.limit(0), labeller).collect() == []


def deep_page(rng):
    """An article, comments, an aside and a footer, each inside several elements with many class words."""
    some = "row col-md-12 d-flex elementor-widget-wrap wp-block-group mb-3 container-fluid layout__item region-a panel pane".split()
    names = lambda n: " ".join(rng.choices(some, k=n))
    labels = []

    def nest(html, depth):
        for _ in range(depth):
            html = f'<div class="{names(rng.randint(2, 7))}">{html}</div>'
        return html

    def paragraphs(n, good):
        labels.extend([good] * n)
        return "".join(f'<div class="{names(3)}"><p class="{names(2)}">{html_text._words(rng, 8, 40)}</p></div>' for _ in range(n))

    head = f"<header><nav>{nest(''.join(f'<li><a href=#>{html_text._words(rng, 1, 2)}</a></li>' for _ in range(5)), 4)}</nav></header>"
    labels.extend([False] * 5)
    form = rng.randrange(3)
    article = nest(paragraphs(20, True), 5)
    article = [f"<article class='{names(3)}'>{article}</article>", f"<main>{article}</main>", nest(f"<div class='entry-content {names(4)}'>{article}</div>", 3)][form]
    rest = f"<section class='comments-area {names(2)}'>{nest(paragraphs(4, False), 3)}</section><aside class='{names(4)}'>{nest(paragraphs(2, False), 4)}</aside><footer>{nest(paragraphs(1, False), 3)}</footer>"
    return nest(head + article + rest, 2), labels


def test_deep_class_rich_pages(labeller):
    rng, right = random.Random(77), {True: [0, 0], False: [0, 0]}
    for _ in range(45):
        html, labels = deep_page(rng)
        page = html_text.blocks(html)
        assert len(page) == len(labels)
        for got, want in zip(labeller.label([page])[0], labels, strict=True):
            right[want][0] += got == want
            right[want][1] += 1
    assert right[True][0] > 0.9 * right[True][1] and right[False][0] > 0.9 * right[False][1]


def test_deep_paths_and_long_blocks_are_read_whole():
    inner = "".join(f'<div class="{" ".join(f"{c}{d}" for c in ("one", "two", "three", "four", "five", "six", "seven", "eight"))}">' for d in "xyz")
    rows = [html_text.vectors(html_text.blocks(f"<{tag}>{inner}<p>The same text.</p>"))[0] for tag in ("article", "aside")]
    assert (rows[0] != rows[1]).any()
    last = [html_text.blocks(f'<div class="a b c d e f {name}"><p>x</p></div>')[0].path for name in ("comments", "story")]
    assert last[0] != last[1]
    words = [f"w{k}" for k in range(60)]
    one, two = (html_text.vectors(html_text.blocks(f"<p>{' '.join([*words[:30], w, *words[30:]])}</p>"))[0] for w in ("abcd", "efgh"))
    assert (one != two).any()
