import random
import time

import pytest

from logquarry.llm.pagetext import Settings, blocks_of, extract, main_text, path_scores

LONG = "The committee met on Monday, and after a long debate it agreed to publish its report. Nobody was surprised."
ARTICLE = f"<h1>A title</h1><p>{LONG}</p><p>Short.</p><ul><li>First point of a list</li><li>Second</li></ul><p>{LONG} {LONG}</p>"
WANT = f"A title {LONG} Short. First point of a list Second {LONG} {LONG}"
AROUND = [
    '<nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav>{}<footer>&copy; 2020 All rights, reserved. Yes.</footer>',
    '<header><h2>The Daily</h2><p>News, every day. Always.</p></header>{}<aside><p>Most read, today. And more.</p></aside>',
    '<div class="cookie-notice"><p>We use cookies, as all do. Fine?</p></div>{}<div id="comments"><h3>2 comments</h3><p>' + LONG + "</p></div>",
    '<div class="ad">Buy now, pay later. Cheap!</div>{}<section class="reader-comments"><p>' + LONG * 4 + "</p></section>",
    '<div role="navigation">Menu, menu.</div>{}<form action="/s"><label>Your mail, please.</label><input><button>Go</button></form>',
    '<div><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div>{}<ul><li><a href="/4">Related one</a></li><li><a href="/5">Related two</a></li></ul>',
    '<div class="sidebar"><p>Side text, with marks. Many!</p></div>{}<div style="display: none">Hidden, quite. Really.</div>',
    '<script>if (a < b) document.write("<p>no</p>");</script>{}<noscript>Please, turn it on.</noscript><style>p > a {{ color: red }}</style>',
]
FRAMES = ["<article>{}</article>", "<main>{}</main>", '<div id="content"><div class="entry-content">{}</div></div>', '<table><tr><td>{}</td></tr></table>']


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("around", AROUND)
def test_article_is_found(frame, around):
    page = "<!DOCTYPE html><html><head><title>T, t. T</title></head><body>" + around.format(frame.format(ARTICLE)) + "</body></html>"
    assert main_text(page) == WANT


def test_path_ratios_tell_text_from_menus():
    page = "<body><div><span>Home</span><br>News<br>Sport</div><section>" + f"<p>{LONG}</p>" * 5 + "</section><div><span>Imprint</span></div></body>"
    blocks, _, _ = blocks_of(page)
    scores = {b.text[:4]: path_scores(blocks, Settings())[b.path] for b in blocks}
    assert scores["The "] > 5 * scores["Home"] and main_text(page) == " ".join([LONG] * 5)
    # a threshold of nothing makes every path content: the ratios decide
    assert main_text(page, Settings(threshold=0.0, hold=1.0)).startswith("Home")


def test_references_white_space_and_broken_markup():
    assert main_text("<p>a &amp; b &lt;i&gt; &#233;&#x41; &nbsp;\n\t c&am</p>") == "a & b <i> éA c&am"
    assert main_text("<p>one<br>two<b>th</b>ree</p><p>four") == "one two" + "three four"
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<p>1 < 2 and 3 <4 ok</p>") == "1 < 2 and 3 <4 ok"
    assert main_text('<p title="a > b">in</p>') == "in"
    assert main_text('<p title="never closed>in</p>') == "in"
    assert main_text("<p>x<!-- <p>no</p> -->y<!--> z</p>") == "xy z"
    assert main_text("<script>never closed <p>no</p>") == ""
    assert main_text("<title>never closed <p>text</p>") == "never closed text"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert main_text("<dl><dt>a<dd>b<dt>c</dl></b></p>") == "a b c"


def test_nothing_to_find():
    assert main_text("") == "" and main_text("<nav><a>Home</a></nav><div class='ad'>Ad. Ad.</div>") == ""
    assert main_text("<p><a href='/x'>only links</a></p>") == "only links"


@pytest.mark.parametrize("page", ["<div>x" * 30_000, "<b>x" * 30_000, "</b>" * 30_000 + "<i>" * 30_000 + "</b>" * 30_000, '<p a="' * 30_000,
                                  "<!--" * 30_000, "<" * 100_000, "<li>x" * 30_000, "<p>word " * 30_000, "<script>" * 30_000, "&" * 100_000])
def test_no_page_stalls(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_generated_pages(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(rng.choice(["word", "text,", "end.", "more", "any"]) for _ in range(rng.randrange(1, 80))) for _ in range(rng.randrange(1, 12))]
        body = "<h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        around = AROUND[i % len(AROUND)].format("<article>" + body + "</article>")
        rows.append((i, f"u{i}", f"<html><body>{around}</body></html>", "extra", 1))
        want[i] = "Head line " + " ".join(paragraphs)
    rows += [(None, None, None, "extra", 1), (100, "u", "", "extra", 1), (100, "u", "", "extra", 1), (101, "u", "<p>" + "long é " * 50_000, "e", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 100} == want
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got if r["page_id"] not in want) == [(0, 0), (100, 0), (100, 0), (101, 349_999)]
    assert extract(df.where("false")).collect() == []
