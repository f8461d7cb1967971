import html
import random
import time

import pytest
from pyspark.sql import types as T

from bagspark.llm import html_extraction as X
from bagspark.llm import html_tree as H
from tests.conftest import rows

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("host", "key", "shape", "text", "texts", "level", "levels", "wrapper")],
])


def frame(spark, data):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in data], SCHEMA)


def extracted(spark, data):
    return {r["page_id"]: r["text"] for r in X.main_text(frame(spark, data)).collect()}


def sentence(rng, n=12):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Ünder", "x&y", "a<b", "delta", "语言"]) for _ in range(n))


def semantic(rng, title, paragraphs):
    e = html.escape
    menu = "".join(f'<li><a href="/{k}">{rng.choice("abc")} item {k}</a></li>' for k in range(rng.randrange(2, 6)))
    comments = "".join(f'<article class="comment"><p>{e(sentence(rng))}</p></article>' for _ in range(rng.randrange(3)))
    body = "".join(f"<p>{e(p)}</p>" for p in paragraphs)
    return (
        f"<!doctype html><html><head><title>{e(title)}</title><style>p{{}}</style></head><body><header><h2>Site {rng.random()}</h2></header><nav><ul>{menu}</ul></nav>"
        f'<div class="cookie-notice"><p>We use cookies</p></div><main><article class="with-sidebar"><h1>{e(title)}</h1>{body}<aside>See {e(sentence(rng))}</aside></article></main>'
        f'<div id="sidebar">{e(sentence(rng, 40))}</div><form><label>Mail</label><button>Go</button></form><section id="comments">{comments}</section><footer>&copy; x</footer></body></html>'
    )


def soup(rng, title, paragraphs):
    """No telling names: a menu of links, a constant notice, a text region and a constant end."""
    e = html.escape
    menu = "".join(f"<div><a href=/{k}>{e(sentence(rng, 2))}</a></div>" for k in range(rng.randrange(3, 9)))
    body = "".join(f"<div class=b>{e(p)}" + "<br>" * rng.randrange(2) + "</div>" for p in paragraphs)
    return f"<body><div class=x1>{menu}</div><div class=x2><div>All rights are ours, always and for ever, whatever you read</div><div class=x3><h1>{e(title)}</h1>{body}</div></div><div class=x4>Written with care</div>"


def site(seed, host, make, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        title, paragraphs = sentence(rng, 4) + f" {k}", [sentence(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(1, 5))]
        out.append((f"https://{host}/p/{k}", make(rng, title, paragraphs), " ".join([title, *paragraphs])))
    return out


def test_templates_with_and_without_telling_names(spark):
    pages = site(1, "a.example.org", semantic, 30) + site(2, "b.example.org", soup, 30) + site(3, "c.example.org", semantic, 1)
    found = extracted(spark, [(k, u, h) for k, (u, h, _) in enumerate(pages)])
    assert found == {k: t for k, (_, _, t) in enumerate(pages)}


def test_broken_markup_references_and_white_space(spark):
    page = (
        "<article><h1>A &amp B&nbsp;&lt;c&gt; &am</h1><p><b>One <i>t</i>wo\n three<br>four<p>fi<!-- no -->ve<script>var a='</p>';</script> six<ul><li>x<li>y</ul></div>"
        "<p title='a > b'>se<em>ven</em> &#228;&#x20AC; 1 < 2<table><tr><td>l<td>r</table><style>b{}</article><footer>end"
    )
    found = extracted(spark, [(1, "http://h/1", page), (2, "http://h/2", page.replace("<style>b{}", ""))])
    assert found[2] == "A & B <c> &am One two three four five six x y seven ä€ 1 < 2 l r"
    assert found[1] == found[2]  # an open style hides the rest of the page, which holds no text of the article


def test_nulls_empties_repeats_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>word {k} of a long page</p><div class=q><p>q{k}</p></div>" for k in range(5000)) + "</article>"
    data = [
        (1, None, None), (2, None, ""), (None, "no url", "<article>text</article>"), (4, "http://h/", "plain words"), (5, "http://h/", "<nav><p>only menu</p></nav>"),
        (6, "http://x/", long), (6, "http://x/", long), (7, "http://h/", "<article></article>"),
    ]
    out = X.main_text(frame(spark, data))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r[0] or 0), r[2][:30], r[3] == len(r[2])) for r in out.collect())
    assert got == [(0, "text", True), (1, "", True), (2, "", True), (4, "plain words", True), (5, "", True), *[(6, "word 0 of a long page q0 word 1"[:30], True)] * 2, (7, "", True)]
    assert {r[3] for r in out.where("page_id = 6").collect()} == {len(" ".join(f"word {k} of a long page q{k}" for k in range(5000)))}
    assert rows(X.main_text(frame(spark, []))) == []


def test_copies_of_one_page_are_not_mistaken_for_its_frame(spark):
    pages = site(5, "d.example.org", semantic, 1) * 8
    assert set(extracted(spark, [(k, u, h) for k, (u, h, _) in enumerate(pages)]).values()) == {pages[0][2]}


def shapes(*pages):
    return [H.tree(p)[0] for p in pages]


def test_repeats_fold_and_mismatches_become_optional():
    a, b, c = shapes("<ul><li>1<li>2<li>3</ul><p>x", "<ul><li>1</ul><div class=ad>buy</div><p>x<p>y", "<p>x")
    merged = H.generalised(H.generalised(a, b), c)
    found = [(n.sym, n.optional) for n in merged]
    assert found == [("ul", True), ("div|class=ad", True), ("+", False)]
    assert [k.sym for k in merged[0].kids] == ["+"]
    assert len({H.packed(H.generalised(merged, x)) for x in (a, b, c)} | {H.packed(merged)}) == 1


def test_every_text_of_a_page_has_a_slot_of_the_wrapper():
    rng = random.Random(4)
    make = lambda: "".join(rng.choice(["<p>a", "<div><p>b</div>", "<ul><li>1<li>2</ul>", "<div class=k>c</div>", "<table><tr><td>x<td>y<tr><td>z</table>", "d"]) for _ in range(rng.randrange(1, 9)))
    pages = shapes(*(make() for _ in range(60)))
    merged = pages[0]
    for p in pages[1:]:
        merged = H.generalised(merged, p)
    copy = H.unpacked(H.packed(merged))
    assert H.packed(copy) == H.packed(merged)
    placed = [H.placed(p, copy) for p in pages]
    assert sum(s >= 0 for p in placed for s in p) >= 0.9 * sum(map(len, placed))


@pytest.mark.parametrize("words", ["<" * 3000, "<a" * 3000, "<p \"" * 3000, "&" * 3000, "<!--" * 2000, "</div>" * 3000, "<div>" * 3000 + "x" + "</div>" * 3000 + "y", "<b" * 30000, "<title " * 3000])
def test_hostile_markup_ends(words):
    start = time.perf_counter()
    nodes, texts, _ = H.tree(words)
    H.packed(nodes)
    assert time.perf_counter() - start < 5
    assert len(list(H.slots(nodes))) <= len(texts)


def test_levels_follow_places():
    assert X.standing(("div|class=page no-sidebar", "article", "header|class=entry-header", "h1")) == X.ARTICLE
    assert X.standing(("div|class=sidebar", "main")) == X.MAIN
    assert X.standing(("article", "footer")) == X.DROPPED
    assert X.standing(("section|id=comments", "article", "p")) == X.DROPPED
    assert X.standing(("div|class=post-content", "p")) == X.CONTENT
    assert X.standing(("div", "p")) == X.OTHER
