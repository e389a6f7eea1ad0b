from __future__ import annotations

import html
import re

from graphspark.llm.html_text import content, extract, main_text, page_lines, smoothed


def truth(page):
    """The synthetic pages' article by their fixed layout."""
    body = page[page.index("<article>") + 9 :].split("</article>")[0].split("<footer>")[0]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:h\d|p)>", body)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract(pages).collect()
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_without_marks():
    long = "Some long text of the article that goes on and on, with much to say about its subject."
    page = f'<div id="top-nav"><a href=1>Home</a> <a href=2>News</a></div><div class="post"><h2>Title here</h2><p>{long}</p>Loose text &amp; more of it here for the reader.<p>{long} Again</div><ul><li><a href=1>x</a><li><a href=2>y</a></ul><div class="comments"><p>{long}</p></div><form>Name <input> Send</form><p>&copy; 2020'
    assert main_text(page).split("\n") == ["Title here", long, "Loose text & more of it here for the reader.", f"{long} Again"]


def test_parts_are_dropped():
    page = "<header>Site</header><main><header><h1>Head</h1></header><p>Body  one\n two<br>three</p><aside>Side</aside><div class='cookie-notice'>We use</div><noscript>no</noscript><script>var a='<p>x</p>'</script><table><tr><td>a<td>b</table></main><footer>f</footer>"
    assert main_text(page) == "Head\nBody one two three\na\nb"


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>cut <b>off</b> &am") == "cut off &am"
    assert main_text("</div></p><p>stray</p></b>") == "stray"
    rows = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x y z</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(rows).collect()) == [(0, "x y z", 5), (1, "", 0), (1, "", 0)]
    assert extract(rows.where("false")).count() == 0
    assert main_text("<p>" + "word " * 100_000 + "</p>") == ("word " * 100_000).strip()


def test_smoothing_and_clusters():
    assert smoothed([1.0, 1.0, 1.0], 1.0) == [1.0, 1.0, 1.0]
    s = smoothed([0.0, 0.0, 9.0, 0.0, 0.0], 1.0)
    assert s[2] == max(s) and abs(s[1] - s[3]) < 1e-12 and s[0] < s[1]
    assert content([]) == [] and page_lines("") == []


def unmarked(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def bare(page):
    """Without marks, class names and the names of a page's parts."""
    return re.sub(r"<(/?)(nav|footer)>", r"<\1div>", re.sub(r' class="[^"]*"', "", unmarked(page)))


def flat(page):
    """The article's blocks directly in the body."""
    return re.sub(r"</?article>", "", page)


def test_the_ratio_finds_articles_without_marks(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for change, extra in ((unmarked, 0.0), (flat, 0.001), (bare, 0.03)):
        want = [truth(p).split("\n") for p in pages]
        got = [main_text(change(p)).split("\n") for p in pages]
        total = sum(map(len, want))
        assert sum(x in g for w, g in zip(want, got) for x in w) >= 0.98 * total
        assert sum(x not in w for w, g in zip(want, got) for x in g) <= extra * total


PARA = "A paragraph that says enough about its subject to be told from a menu, an advert or a footer of the page."


def test_two_articles_and_lists_of_links():
    links = "".join(f'<li><a href="{i}">Reference {i} to read</a></li>' for i in range(4))
    page = f"<nav><a href=1>Home</a></nav><main><article><h2>One</h2><p>{PARA}</p><ul>{links}</ul></article><div><a href=1>Buy this</a> <a href=2>Buy that</a></div><article><h2>Two</h2><p>{PARA} Again.</p><div><a href=9>Share it</a></div></article></main><footer>f</footer>"
    want = ["One", PARA, *(f"Reference {i} to read" for i in range(4)), "Two", f"{PARA} Again."]
    assert [x for x in main_text(page).split("\n") if "Buy" not in x] == want
    assert "Share" not in main_text(page)
    apart = page.replace("<main>", "").replace("</main>", "")
    assert main_text(apart).split("\n") == want


def test_pages_without_any_name():
    menu = "".join(f'<div><a href="{i}">Item {i}</a></div>' for i in range(6))
    body = f"<h1>Head</h1><p>{PARA}</p><p>Short one.</p><h3>Part</h3><p>{PARA} More.</p>"
    page = f"<body><div>{menu}</div><div>{body}</div><div>Seen 1</div><div><a href=1>About</a></div></body>"
    assert main_text(page).split("\n") == ["Head", PARA, "Short one.", "Part", f"{PARA} More."]


def test_long_pages_of_many_blocks():
    blocks = [f"Block {i} has some words of its own." for i in range(20_000)]
    page = "<div><a href=1>Menu</a></div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div>"
    assert main_text(page).split("\n") == blocks
    assert main_text("<div>" * 3000 + PARA) == PARA


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{PARA}</p>")], "page_id long, url string, html string")
    rows = rows.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS lines", "4 AS `a.b`")
    assert [tuple(r) for r in extract(rows).collect()] == [(1, "u", PARA, len(PARA))]
