import html
import random
import time

import pytest

from kvlake.llm import html_text as h

ARTICLE = "<article><h1>Title</h1><p>First  paragraph with <a href='#'>a link</a> &amp; more\n words.</p><p>Second <b>one.</p></article>"
TEXT = "Title\nFirst paragraph with a link & more words.\nSecond one."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=a>A</a></ul></nav>{}<footer>&copy; someone</footer>",
        "<script>var a='<p>'; </script><div class='ad'>Buy this now, it is the best thing ever sold to anyone.</div>{}<aside><p>Side story of some length to read.</p></aside>",
        "<div id='cookie-banner'>We use cookies to make this page better for you and others.</div>{}<section class='comments'><p>Great text, I liked all of it very much indeed!</p></section>",
        "<form><input name=q><button>Go</button></form><div class=sidebarLeft><p>Menu text</p></div>{}<!-- <p>gone</p> --><noscript>Turn it on</noscript>",
        "<div class=wrap><div class=col>{}</div><div class=links><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div></div>",
        "<header><h1>Site</h1></header><main>{}</main><div role=complementary>Else</div><div hidden>No</div><div style='display: none'>No</div>",
    ],
)
def test_article_alone(around):
    assert h.main_text(around.format(ARTICLE)) == TEXT


def test_without_semantic_tags():
    page = "<body><div class=top><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop</a></div><div><div class=text><h2>Head</h2><p>Some words that make a paragraph long enough.</p><ul><li>one<li>two</ul><p>Another paragraph, long enough as well.</p></div></div><p>tail</p></body>"
    assert h.main_text(page) == "Head\nSome words that make a paragraph long enough.\none\ntwo\nAnother paragraph, long enough as well."


def test_odd_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p></p>  ") == ""
    assert h.main_text("only text &lt;here&gt; &#233;&nbsp;x") == "only text <here> é x"
    assert h.main_text("<p>a</p>b<p>c") == "a\nb\nc"
    assert h.main_text("<div><p>cut <a href='x") == "cut <a href='x"
    assert h.main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert h.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    long = "word " * 50000
    assert h.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert h.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, "clash"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    rows = sorted(h.extracted(df).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]
    assert h.extracted(df.where("page_id > 5")).count() == 0


def test_names_do_not_cut_the_article():
    words = "a paragraph of the article that is long enough to count as text "
    page = f"<article><h1>T</h1><p>{words}</p><div class='share-price-table'><p>Price 12</p></div><section class='related-work'><h2>Others</h2><p>{words}</p></section><div class='comments-area'><p>Great!</p></div><div class=adSlot><p>Buy</p></div></article>"
    w = words.strip()
    assert h.main_text(page) == f"T\n{w}\nPrice 12\nOthers\n{w}"


def test_unnamed_boxes_beside_the_text_of_an_article():
    words = "a paragraph of the article that is long enough to count as text and goes on for quite a while so that it is dense "
    body = "".join(f"<p>{words}{k}</p>" for k in range(8))
    comments = "".join(f"<div><a href=u{k}>user {k}</a> <span>{k} May</span><p>I <b>like</b> it.</p></div>" for k in range(6))
    page = f"<body><div class=m><a href=1>x</a><a href=2>y</a></div><article><h1>Title</h1><p>By me</p><div class=c1>{body}</div><div class=c2>{comments}</div><div class=c3><p>Buy it now.</p></div></article></body>"
    assert h.main_text(page) == "\n".join(["Title", "By me", *(f"{words}{k}" for k in range(8))])
    # and without an article the heading's box frames the text
    assert h.main_text(page.replace("article>", "div>")) == h.main_text(page)


def test_time_grows_with_the_page():
    for page in ("<a " * 350000, "<div>" * 100000 + "</p>" * 100000, '<a "b>"' * 150000, "<div>x" * 100000, "<a><div>" * 50000 + "</a>" * 50000, "<ul><li>" * 30000 + "<tr>" * 30000, "<!--" * 250000, "<p class='" * 100000, "<script>" * 100000):
        at = time.time()
        h.main_text(page)
        assert time.time() - at < 8, page[:20]
    many = "<div class=t><p>words and more words here</p><p>some more of them</p></div>"
    assert h.main_text(many * 3000) == "\n".join(["words and more words here", "some more of them"] * 3000)


def test_built_pages(spark):
    """Pages put together from known blocks: what comes back is the article's blocks, whatever stands around and between them."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefg&<é ") for _ in range(r.randint(2, 9))).strip() or "w"
    words = lambda a, b: " ".join(" ".join(word() for _ in range(r.randint(a, b))).split())
    around = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=x>{html.escape(words(1, 2))}</a>' for _ in range(4))}</ul></nav>",
        lambda: f"<div class='{r.choice(['ad', 'ad-slot', 'cookie-notice', 'comments', 'sidebarLeft', 'related-posts'])}'><p>{html.escape(words(3, 20))}</p></div>",
        lambda: f"<aside><h2>{html.escape(words(1, 3))}</h2></aside>",
        lambda: f"<form><p>{html.escape(words(1, 3))}<input name=q></form>",
        lambda: "<script>if (a < b) document.write('<p>no</p>')</script>",
        lambda: "<!-- <p>no</p> -->",
    ]
    rows, want = [], {}
    for k in range(120):
        blocks, parts = [], []
        for _ in range(r.randint(1, 9)):
            t = words(12, 40)
            cut = t.find(" ") + 1
            blocks.append(t)
            tag = r.choice(["p", "h2", "blockquote", "div"])
            parts.append(f"<{tag}>" + html.escape(t[:cut]) + r.choice(["{}", "<b>{}</b>", "<span class=x>{}</span>", "  \n\t{} "]).format(html.escape(t[cut:])) + f"</{tag}>")
            if r.random() < 0.3:
                parts.append(r.choice(around)())
        extra = lambda: "".join(r.choice(around)() for _ in range(r.randint(0, 3)))
        rows.append((k, "u", f"<html><head><title>t</title></head><body>{extra()}<article>{''.join(parts)}</article>{extra()}<footer>end</footer></body></html>"))
        want[k] = "\n".join(blocks)
    got = {x.page_id: x for x in h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, t in want.items():
        assert got[k].text == t and got[k].n_chars == len(t), rows[k]
