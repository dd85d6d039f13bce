import pytest

from tokenloom.llm.html_text import extract_text, main_text

ARTICLE = "A long first sentence, with commas, and words. " * 4

CASES = {
    "": "",
    "plain text &amp; more\n text": "plain text & more text",
    "<p>a<p>b": "a\nb",
    "<p>un<b>closed": "unclosed",
    "<a href='x>y'>only a link</a>": "only a link",
    "<script>var a='<p>no</p>'": "",
    "<p>a&nbsp;&nbsp;b&#233;&lt;c&gt; &copy &bogus; <br>d</p>": "a bé<c> © &bogus; d",
    "<article><h1>T</h1><p>One.</p><!-- <p>x</p> --><ul><li>i<li>j</ul><pre>  p  q </pre></article>": "T\nOne.\ni\nj\np q",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<p style='display:none'>hid</p><p hidden>den</p><p>seen</p>": "seen",
}


@pytest.mark.parametrize("source", list(CASES))
def test_small_pages(source):
    assert main_text(source) == CASES[source]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><ul><li><a href=1>Home, page</a></ul></nav>",
        "<div class='main-menu'><p>Menu words, a, b</p></div>",
        "<div id=siteHeader><p>Site header, words</p></div>",
        "<header><p>Head, er</p></header>",
        "<footer><p>&copy; us, them</p></footer>",
        "<aside><p>Side, bar</p></aside>",
        "<div class=sidebar><p>Side, bar, again</p></div>",
        "<div class='cookie-notice'><p>We use cookies, many</p></div>",
        "<div class=ad><p>Buy, buy, buy</p></div>",
        "<form><p>Your name, please</p><input><textarea>t</textarea></form>",
        "<script>document.write('<p>x, y</p>')</script><noscript><p>No</p></noscript>",
        "<div role=navigation><p>Go, there</p></div>",
        "<section class=comments><p>Great, post, I, like, it, a, lot, really</p></section>",
        "<div id='comments'><ul><li class=comment><p>Nice, one</p></ul></div>",
    ],
)
def test_noise_goes_wherever_it_stands(noise):
    wanted = "\n".join(["Title", ARTICLE.strip(), "Second one, too."])
    body = f"<p>{ARTICLE}</p><p>Second <a href=x>one</a>, too.</p>"
    assert main_text(page(f"{noise}<article><h1>Title</h1>{body}</article>{noise}")) == wanted
    assert main_text(page(f"<article><h1>Title</h1>{noise}{body}</article>")) == wanted
    # Without an article element the container with the most points is found.
    assert main_text(page(f"{noise}<div><div class=x><h1>Title</h1>{body}</div></div>{noise}")) == wanted


@pytest.mark.parametrize(
    "name", ["layout no-sidebar", "has-sidebar", "elementor-widget-container", "page-with-comments", "share-layout", "content widget"]
)
def test_a_wrapper_of_the_article_stays(name):
    wanted = "\n".join(["Title", ARTICLE.strip(), "Second one, too."])
    body = f"<h1>Title</h1><p>{ARTICLE}</p><p>Second one, too.</p>"
    ad = "<div class=ad><p>Buy, buy, buy</p></div>"
    assert main_text(page(f"{ad}<div class='{name}'>{body}{ad}</div>{ad}")) == wanted
    assert main_text(page(f"<div class='{name}'><article>{body}</article></div>{ad}")) == wanted
    # Without any heading, by its paragraphs.
    assert main_text(page(f"{ad}<div class='{name}'><p>{ARTICLE}</p><p>{ARTICLE}</p></div>")) == "\n".join([ARTICLE.strip()] * 2)


def test_a_title_in_a_marked_header_stays():
    body = f"<div class='entry-header'><h1>Title</h1></div><p>{ARTICLE}</p>"
    assert main_text(page(f"<article>{body}</article>")) == "Title\n" + ARTICLE.strip()


def test_an_article_in_parts():
    parts = f"<article>{f'<p>{ARTICLE}</p>' * 4}</article><article><p>{ARTICLE}</p></article>"
    assert main_text(page(f"<div>{parts}<article><p>Teaser</p></article></div>")) == "\n".join([ARTICLE.strip()] * 5)


def test_comments_that_are_articles_go():
    comments = f"<section class=comments>{f'<article class=comment><p>{ARTICLE}</p></article>' * 9}</section>"
    assert main_text(page(f"<article><h1>T</h1><p>{ARTICLE}</p></article>{comments}")) == "T\n" + ARTICLE.strip()


def test_container_beats_link_lists():
    links = "<div><ul>" + "<li><a href=x>One link, another, more, and more</a></li>" * 40 + "</ul></div>"
    assert main_text(page(f"{links}<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div>{links}")) == "\n".join([ARTICLE.strip()] * 2)


def test_table_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    rows = [(1, "u", "<p>é &amp; a</p>"), (1, "u", "<p>é &amp; a</p>"), (2, None, None), (None, "v", ""), (3, "w", deep), (4, "x", "<p>" + "long, " * 50_000)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], schema)
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    expected = [(1, "u", "é & a", 5)] * 2 + [(2, None, "", 0), (0, "v", "", 0), (3, "w", "deep", 4), (4, "x", ("long, " * 50_000).strip(), 299_999)]
    assert found == sorted(expected, key=str)
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


PROSE = "<p>" + "The river rose in the night, and the town woke to water. " * 3 + "</p>"
TEXT = " ".join(PROSE[3:-4].split())


@pytest.mark.parametrize(
    "page",
    [
        "<script>if(a<b){x()}</script><article>PROSE</article>",
        "<article>PROSE<script>for(i=0;i<n;i++){s+='</p>'}</script></article>",
        "<article><style>a<b{}</style>PROSE</article>",
        "<article><!-->PROSE<!----><!-- a > b --!></article>",
        "<article>PROSE<div class=ad><h1>Buy now</h1><p>Cheap, cheap, cheap</p></div></article>",
        "<div class='banner ad'><h1>Buy now</h1></div><article>PROSE</article>",
        "<article>PROSE</article><section class=comments><article class=comment-body><p>First, I say, I am first here.</p></article></section>",
        "<div class=story>PROSE<section class=comments><article class='comment'><p>I, for one, agree with it all.</p></article></section></div>",
        "<article>PROSE<article class=comment><p>Nested, but a comment all the same.</p></article></article>",
        "<div class='layout has-sidebar'><article>PROSE</article><div class=sidebar><p>Other news, and more.</p></div></div>",
        "<div class='sidebar-layout'><article>PROSE</article></div>",
    ],
)
def test_probed_pages(page):
    assert main_text(page.replace("PROSE", PROSE)) == TEXT


def test_a_header_keeps_the_only_title():
    page = f"<div class='entry-header'><h1>High water</h1></div><div class=story>{PROSE}</div>"
    assert main_text(f"<article>{page}</article>") == f"High water\n{TEXT}"


def test_many_scripts_take_linear_time():
    import time

    page = "<article>" + (PROSE + "<script>if(a<b && c>d){x('</div>')}</script><a href='x>") * 20_000 + "</article>"
    start = time.process_time()
    main_text("<article>" + (PROSE + "<script>if(a<b){x()}</script>") * 16_000 + "</article>")
    assert time.process_time() - start < 15
    assert main_text(page[:200_000]).startswith(TEXT)
