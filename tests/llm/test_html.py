import re
import time

import pytest

from contestkit.llm import html, queries

ARTICLE = "First paragraph, with commas, and enough words to count as prose in any article about things."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><p>{ARTICLE}</p><p>Short.</p></article><footer>c</footer>", f"{ARTICLE} Short."),
        (f"<div id=content><p>{ARTICLE}<p>one&nbsp;\n two<br>three</div><div class='sidebar'><p>{ARTICLE}</p></div>", f"{ARTICLE} one two three"),
        (f"<div class=post><p>{ARTICLE}</p></div><div id=comments><p>{ARTICLE} {ARTICLE}</p></div>", ARTICLE),
        (f"<div><p>{ARTICLE}</p><div class='ad'>Buy</div><form><p>Mail</p></form><script>if (a<b) '</p>'</script><p>a<b>b</b>c &amp;amp; &copy &am</p></div>", f"{ARTICLE} abc &amp; © &am"),
        (f"<main><h1>Title</h1><section><p>{ARTICLE}</p></section><section><p>{ARTICLE}</p></section></main><aside>x</aside>", f"Title {ARTICLE} {ARTICLE}"),
        (f"<div class=cookie-notice>We use cookies, really, many, many cookies, so many.</div><div><p>{ARTICLE}</p><!-- a <p>no</p> --></div>", ARTICLE),
        (f"<article><p>{ARTICLE}</p><ul class=x><li><a href=1>one link</a></li><li><a href=2>two link</a></li></ul><ul><li>kept item</li></ul></article>", f"{ARTICLE} one link two link kept item"),
        (f"<div class='has-sidebar wrap'><article><p>{ARTICLE}</p></article><div class='topmenu'>x</div></div><div id=usercomments><p>{ARTICLE}</p></div><div class=cookiebar>We use them</div>", ARTICLE),
        (f"<div class='page with-banner'><h1>Title</h1><p>{ARTICLE}</p><p>{ARTICLE}</p><div class=adbox>Buy</div></div>", f"Title {ARTICLE} {ARTICLE}"),
        (f"<script>if(i<n){{ // don't\n}}</script><p>It's fine, {ARTICLE}</p><p>\"Quoted\"</p>", f"It's fine, {ARTICLE} \"Quoted\""),
        (f"<article><header><p>By x</p><h1>The title</h1></header><p>{ARTICLE}</p><p class='share'>kept</p><div class=related><p>kept too</p></div><h2 class='section-header'>Kept</h2><div class=comments><p>no</p></div><footer>no</footer><p class=ad>no</p></article>", f"The title {ARTICLE} kept kept too Kept"),
        (f"<header><h1>Site</h1></header><div class=post><h1>Title</h1><p class=x\">{ARTICLE}</p><ol><li><a href=1>Reference one</a></li></ol></div>", f"Title {ARTICLE} Reference one"),
        (f"<ul><li><a href=1>Home</a></li></ul><p>{ARTICLE}</p><p>{ARTICLE}</p>", f"{ARTICLE} {ARTICLE}"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{ARTICLE}</p><template><template></template>x</template></ article></article>", f"a b c {ARTICLE}"),
        (f"<div class=para><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div class=para><p>Short end.</p></div>", f"{ARTICLE} {ARTICLE} Short end."),
        (f"<div class=top><h1>Headline of it</h1></div><div class=body><p>{ARTICLE}</p><p>{ARTICLE}</p></div>", f"Headline of it {ARTICLE} {ARTICLE}"),
        (f"<div><div class=top><h1>Headline of it</h1></div><div class=mid><div class=inner><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div class=links><a href=1>More</a></div></div></div>", f"Headline of it {ARTICLE} {ARTICLE}"),
        (f"<main><article><h2>One</h2><p>{ARTICLE}</p><p>{ARTICLE}</p></article><article><h2>Two</h2><p>Brief.</p></article><aside>x</aside></main>", f"One {ARTICLE} {ARTICLE} Two Brief."),
        (f"<article><p class='header'>Intro line.</p><p>{ARTICLE}</p><p class='reply'>He replied.</p><section class='comments-policy'><p>How to comment.</p></section><div class='comments-area'><p>no</p></div><section class='user-comments'><p>no</p></section><p class='advert'>no</p><div class='header-top'>no</div></article>", f"Intro line. {ARTICLE} He replied. How to comment."),
        (f"<h1>Title</h1><div class=body><p>{ARTICLE}</p><p>{ARTICLE}</p></div><p>Short end.</p><div class=more><a href=1>x</a></div>", f"Title {ARTICLE} {ARTICLE} Short end."),
        ("plain text only", "plain text only"),
        ("", ""),
        ("<script>x</script>", ""),
    ],
)
def test_keeps_the_article(body, text):
    assert html.extract(page(body)) == text


def test_broken_pages():
    assert html.extract(None) == "" == html.extract("")
    assert html.extract("<p") == "" and html.extract("a < b") == "a < b"
    assert "end" in html.extract("<div>" * 3000 + "<p>the end, at last</p>")
    assert html.extract('<p title="a>b">x</p><script>never closed') == "x"
    assert len(html.extract(page("<article>" + f"<p>{ARTICLE}</p>" * 5000 + "</article>"))) == 5000 * (len(ARTICLE) + 1) - 1


@pytest.mark.parametrize(
    "piece",
    ["<b>|<div>x</div>", "<b><div><i>|</b>", "<div class='a_a_", "<p>", "<li>x|</ul>", "<a href=\"", "<a b='\">", "<script>|<p", "<!--|--", "<td>|<tr>", "&lt;", "</div", "<h1 a= ", "<script>|</script ", "<textarea>|</textarea\n", "<style>|</style"],
)
def test_hostile_pages_take_linear_time(piece):
    page = "".join(p * (1_000_000 // 2 // len(p)) for p in (*piece.split("|"), piece.split("|")[-1])[:2])
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 15  # a quadratic step would take minutes


def test_query_against_the_article_element(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    import html as references

    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.DOTALL)[1]
        want = " ".join(references.unescape(re.sub(r"</?(?:b|i|em|strong|a)\b[^>]*>", "", re.sub(r"</?(?:p|h1|br|div)\b[^>]*>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "<p>x</p>")], "page_id long, html string")
    assert sorted(r["t"] for r in rows.select(html.main_text()("html").alias("t")).collect()) == ["", "", "x"]
    assert rows.limit(0).select(html.main_text()("html").alias("t")).collect() == []


def test_query_with_clashing_columns_and_repeated_rows(spark, tmp_path):
    body = page(f"<article><p>{ARTICLE}</p></article>")
    rows = [(1, "u", body, "t", 5), (1, "u", body, "t", 5), (None, None, None, None, None), (2, "v", "", "x", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.op4_html_extraction(spark, str(tmp_path)).fillna(0, ["page_id"]).fillna("").collect())
    assert got == [(0, "", "", 0), (1, "u", ARTICLE, len(ARTICLE)), (1, "u", ARTICLE, len(ARTICLE)), (2, "v", "", 0)]
