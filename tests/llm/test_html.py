import random
import re
import time
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.llm import crf, html


def texts(page):
    return [b[0] for b in html.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b</p>c", ["a", "b", "c"]), (
            "<p> a\n\t b&nbsp;c </p>", ["a b c"]
        ), ("<p>a<b>b</b><i>c</i></p>", ["abc"]), ("x<br>y", ["x y"]), ("<ul><li>a<li>b</ul>", ["a", "b"]),
        (
            "<script>var x='</p>'; if (a<b) {}</script><p>t", ["t"]
        ), ("<style>p{}</style >t", ["t"]), ("<title>no</title><p>yes</p>", ["yes"]), ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        (
            "a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &unknown;", ["a <b> &amp; ééé &unknown;"]
        ), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ('<a title="x > y">t</a>', ["t"]), ("<p>a</div></p>b", ["a", "b"]), ("", []), (None, []), ("<", ["<"]), ("<p", ["<p"]),
        ("<script>never closed <p>x", []), (
            "<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]
        ), ("<P CLASS=X>a</P>", ["a"]), ("</p></p>a", ["a"]), ("<svg><text>no</text></svg>yes", ["yes"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_ancestors_are_features():
    (_, _, features, tag, linked), = html.blocks('<div class="Side-bar" id=top><p>x <a href=y>abc</a></p></div>')
    assert {
        "in=div", "in=p", "in=a", "name=side", "name=bar", "name=top"
    } - {"in=a"} <= features and tag == "p" and linked == 3


def test_deep_and_long_pages_are_read_whole():
    assert texts("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y") == ["x", "y"]
    assert len(texts("<p>" + "word " * 200_000)[0]) == 999_999
    assert texts("</b>" * 20_000 + "x") == ["x"] and texts("<b>" * 20_000 + "</i>" * 20_000 + "x") == ["x"]


def test_held_out_pages():
    pages = html.labelled_pages(80, seed=99)
    model = html.own_model()
    right = total = 0
    for page, got in zip(pages, html.main_texts(pages, model)):
        want = [t for t, marked, *_ in html.blocks(page) if marked]
        right += "\n".join(want) == got
        total += 1
    assert right / total > 0.85


def test_hand_made_pages():
    article = "<h1>Title</h1><p>First paragraph of the story, with words.</p><p>Second one.</p>"
    noise = [
        '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav>', '<header><h1>Site name</h1></header>', '<div class="cookie-notice"><p>We use cookies on this site to do things.</p><button>OK</button></div>',
        '<div class="ad">Buy this now, it is very cheap and very good.</div>', '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>', '<form><label>Mail</label><input><button>Join</button></form>', "<script>var a = '<p>no</p>'</script>",
    ]
    end = [
        '<footer>&copy; 2020 Somebody</footer>',
        '<section id="comments"><div class="comment"><p>I do not agree with this at all, sorry.</p></div></section>',
    ]
    rng = random.Random(0)
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>")):
        for _ in range(5):
            page = "<html><body>" + "".join(
                rng.sample(noise, 4)
            ) + open_ + article + close + "".join(rng.sample(end, 2)) + "</body></html>"
            assert html.main_texts(
                [page], html.own_model()
            )[0] == "Title\nFirst paragraph of the story, with words.\nSecond one."


def test_table_of_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op9_html(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = [" ".join(unescape(re.sub("<[^>]+>", "", part)).split()) for part in re.split("</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark, clashing):
    rows = [
        (1, None, None),
        (2, "u", ""),
        (3, "u", "   "),
        (4, None, "<article><p>x</p></article>"),
        (4, None, "<article><p>x</p></article>"),
        (None, "u", "\x00<article>&#0;<p>�</article>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select(
        "*", F.lit("own").alias("TEXT"), F.lit(1).alias("label")
    )
    got = html.extract_main_text(pages).collect()
    assert [r["text"] for r in got][:5] == ["", "", "", "x", "x"] and len(got) == 6 and got[3]["n_chars"] == 1
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_decoding_equals_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = crf.Crf({}, np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    emissions = [rng.normal(size=(n, 3)) for n in (1, 4, 0, 6, 4)]

    def score(e, ys):
        return field.first[ys[0]] + sum(e[t, y] for t, y in enumerate(ys)) + sum(
            field.steps[a, b] for a, b in zip(ys, ys[1:])
        )

    for e, got in zip(emissions, field.decode(emissions)):
        if len(e):
            assert tuple(got) == max(itertools.product(range(3), repeat=len(e)), key=lambda ys: score(e, ys))
        else:
            assert len(got) == 0


def test_training_follows_the_likelihood():
    """The trained field's gradient is about zero: expected counts equal observed ones, up to the penalty."""
    data = [([["a"], ["b"], ["a"]], [0, 1, 0]), ([["b"], ["b"]], [1, 1]), ([["a"], ["a"]], [0, 1])]
    field = crf.train(data, 2, epochs=400)
    labels = [p.tolist() for p in field.decode([field.emissions(x) for x, _ in data])]
    assert labels[0] == [0, 1, 0] and labels[1] == [1, 1]


ARTICLE = '<h1>Ther onin edst</h1><p>Thntblere of then, edtioner in inea that esly.</p>{}<p>Aned ouen.</p><ul><li>onin</li><li>inea that</li></ul><p>Last <a href="/x">line</a> of it.</p>'
MAIN = "Ther onin edst\nThntblere of then, edtioner in inea that esly.\nAned ouen.\nonin\ninea that\nLast line of it."
AROUND = {
    "cookie": '<div class="cookie"><p>Nous utilisons des cookies sur ce site pour vous.</p></div>', "notice": '<p class="notice">This site will be down on Monday for work on it.</p>', "alert": '<div role="alert">Attention please, work ahead.</div>',
    "comments": '<section class="comments"><h2>Comments</h2><div class="comment"><b>Jo</b><p>Nice reading, thanks a lot for it.</p></div></section>', "comment": '<article class="comment"><p>Nice reading, thanks a lot for it.</p></article>',
    "ad": '<div class="ad">Buy cheap things here and now.</div>', "advert": '<aside class="advert">Buy cheap things now</aside>', "sponsored": '<section class="sponsored"><p>Buy cheap things here and now.</p></section>',
    "aside": "<aside><p>Some side text that is quite long and has words.</p></aside>", "sidebar": '<div class="sidebar"><h3>More</h3><p>Some side text that is quite long.</p></div>', "form": "<form><label>Name</label><input><select><option>One</option></select><button>Send it</button></form>",
    "nav": '<nav><a href="/">Home</a> | <a href="/a">About</a></nav>', "menu": '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul>', "header": "<header><h1>The Daily</h1><p>News of the day</p></header>", "footer": "<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer>",
    "dialog": "<dialog open><p>Sign up for our letter now.</p></dialog>", "share": '<div class="share"><a href="#">Tweet</a></div>', "related": '<section class="related"><h2>Related</h2><ul><li><a href="/1">Other story here</a></li></ul></section>',
}


@pytest.mark.parametrize(
    ("open_", "close"),
    [
        ("<article>", "</article>"),
        ("<main>", "</main>"),
        ('<div class="content">', "</div>"),
        ('<main><article class="post">', "</article></main>"),
        ("<div>", "</div>"),
    ],
)
def test_parts_before_after_and_inside_go(open_, close):
    pages = []
    for part in AROUND.values():
        pages += [
            f"<html><body>{part}{open_}{ARTICLE.format('')}{close}</body></html>",
            f"<html><body>{open_}{ARTICLE.format('')}{close}{part}</body></html>",
            f"<html><body>{open_}{ARTICLE.format(part)}{close}</body></html>",
        ]
    got = html.main_texts(pages, html.own_model())
    assert sum(g == MAIN for g in got) >= 0.95 * len(got)


@pytest.mark.parametrize("tail", ["", ">", "'>"])
@pytest.mark.parametrize("piece", ["<a ", "<p ", "<a '", "<a \"'", "<", "</a ", "<!", "<!--", "&", "<script>", "<b>"])
def test_hostile_pages_take_linear_time(piece, tail):
    field = html.own_model()
    page = piece * (1_000_000 // len(piece)) + tail
    began = time.process_time()
    html.main_texts([page], field)
    assert time.process_time() - began < 5


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<a ", "<p>", "'", '"', ">", "</p>", "x", "</", "<!", "<!--", "-->", "<", " "]), max_size=14).map("".join))
def test_pages_are_cut_as_by_the_pattern(page):
    """The memory of failed tags changes nothing: every place is cut as one pattern, tried there alone, would."""
    whole = re.compile(html.TOKEN.pattern + "|([^<]+)|<", re.S)
    at, held, said = 0, [], []
    while found := whole.match(page, at):
        at = found.end()
        said.append(found[0])
        if found[4] is not None or found[2] is None and found[0] == "<":
            held.append(found[0])
    assert "".join(said) == page
    want = " ".join(unescape("".join(held)).split())
    got = " ".join(" ".join(b[0] for b in html.blocks(page)).split())
    assert got.replace(" ", "") == want.replace(" ", "")


def test_deep_pages():
    near = "<p>a" + "<b>" * 300 + "x<p class=only>c"
    assert [b[0] for b in html.blocks(near)] == ["ax", "c"]
    assert "name=first" not in list(html.blocks("<p class=first>a" + "<b>" * 30 + "x<p>c"))[1][2]
    deep = "".join(f'<div class="{"abcdefghij"[k % 10] * (k // 10 + 1)}">' for k in range(1000)) + "text"
    ((_, _, features, _, _),) = html.blocks(deep)
    assert len([f for f in features if f.startswith("name=")]) == 1000
    ((_, _, kept, _, _),) = html.blocks(deep, {"name=aaa", "in=div"})
    assert kept == {"name=aaa", "in=div"}


def test_fields_are_fitted_fast():
    began = time.process_time()
    html.train(html.labelled_pages())
    assert time.process_time() - began < 5
